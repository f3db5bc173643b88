"""functions of the chart adjudication jobs."""
