"""quire: a Spark-first engine for structuring, de-duplicating and bundling documents."""
