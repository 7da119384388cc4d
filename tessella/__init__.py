"""tessella: document retrieval and corpus preparation as plain Spark DataFrames."""
