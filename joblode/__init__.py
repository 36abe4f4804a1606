"""Job-listing analytics on Spark: ingest, dedupe, normalize, upsert, search, insights, matching."""
