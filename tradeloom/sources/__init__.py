"""Readers, ingestion and writers."""
