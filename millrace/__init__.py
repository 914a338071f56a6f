"""Text-corpus preparation, packing, batching and measurement as Spark jobs."""
