"""Clinical chart adjudication as Spark DataFrame jobs."""
