"""leafmill: document extraction and corpus preparation as Spark jobs."""
