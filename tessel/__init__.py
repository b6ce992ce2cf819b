"""tessel: document-evidence analytics on Spark DataFrames."""
