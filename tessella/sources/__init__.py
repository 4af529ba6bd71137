"""Readers, and tables as immutable versions over Parquet files."""
