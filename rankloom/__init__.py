"""Session-ranking analytics on PySpark DataFrames."""
