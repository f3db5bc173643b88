"""sources of the chart adjudication jobs."""
