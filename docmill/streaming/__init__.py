"""Incremental ingestion and event folds."""
