"""Text-corpus and model-score analytics on PySpark DataFrames."""
