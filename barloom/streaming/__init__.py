"""Incremental ingest and the daily predict-and-score job."""
