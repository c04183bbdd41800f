"""Range-filtered vector search and corpus preparation on Spark DataFrames."""
