"""Document-corpus, retrieval and query-log analytics as Spark jobs."""
