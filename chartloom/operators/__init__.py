"""operators of the chart adjudication jobs."""
