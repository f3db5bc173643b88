"""Training-data operators: scans, deduplication, extraction, scoring and token files."""
