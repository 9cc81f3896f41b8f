"""Spark-first analytics for tables recovered from scanned archival documents."""
