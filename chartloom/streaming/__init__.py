"""streaming of the chart adjudication jobs."""
