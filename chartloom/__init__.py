"""Chart history and entity resolution as Spark jobs."""
