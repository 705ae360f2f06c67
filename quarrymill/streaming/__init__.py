"""Incremental and resumable runs."""
