"""Reading and writing corpora."""
