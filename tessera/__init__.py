"""Evidence retrieval and offline evaluation analytics on Spark DataFrames."""
