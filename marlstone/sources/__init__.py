"""Sources and sinks: strict JSON documents, Parquet tables, the versioned store."""
