"""Incremental ingestion (the analyses themselves are batch-only)."""
