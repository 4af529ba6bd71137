"""Column functions: vector distances, JSON access, tokens and BM25 arithmetic."""
