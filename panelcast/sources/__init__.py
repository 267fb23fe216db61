"""Sources (panel ingest) and sinks (result tables)."""
