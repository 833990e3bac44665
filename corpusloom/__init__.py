"""corpusloom: text-corpus curation as composable Spark DataFrame operators."""
