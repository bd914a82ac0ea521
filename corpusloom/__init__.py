"""corpusloom: corpus curation, hybrid retrieval and event processing as Spark DataFrame plans."""
