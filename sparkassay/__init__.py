"""Table quality assessment, business rules and document retrieval on Spark DataFrames."""
