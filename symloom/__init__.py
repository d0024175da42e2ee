"""symloom: symbol-sequence analytics on Spark DataFrames."""
