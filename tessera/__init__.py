"""Picture analytics as chained Spark DataFrame transformations."""
