"""Document search, indexing and corpus preparation as Spark jobs."""
