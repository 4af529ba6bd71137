"""SELECT statements of the dialect over streams."""
