"""plans of the chart adjudication jobs."""
