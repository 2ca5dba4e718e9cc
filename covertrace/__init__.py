"""Coverage analytics on Spark: day-aligned media-footprint metrics, ledgered ingestion and data preparation."""
