"""Incremental ingestion.  The reports themselves are batch."""
