"""skein: retrieval, ranking, curation and engagement analytics as Spark plans."""
