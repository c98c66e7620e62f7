"""brindle: catalog search, ranking and profiling as Spark DataFrame jobs."""
