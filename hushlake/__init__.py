"""Privacy masking and audit analytics over Spark DataFrames."""
