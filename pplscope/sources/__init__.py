"""Readers: Parquet tables and folders, model responses, result files, URL manifests."""
