"""Micro-batch ingestion into scalable filters."""
