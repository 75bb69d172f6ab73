"""A document-library analytics engine on Spark: ingestion, text structure, retrieval, incremental sync."""
