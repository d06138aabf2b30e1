"""corpusloom: document-corpus retrieval, evaluation and preparation as Spark DataFrame transformations."""
