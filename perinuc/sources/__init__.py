"""Reading and writing: directory catalogues, nested JSON, result tables."""
