"""weir: declarative record pipelines compiled to Spark plans."""
