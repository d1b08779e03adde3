"""tessella: a Spark-first engine for text matching, ranking and corpus preparation."""
