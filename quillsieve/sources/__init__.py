"""Readers, generators and record parsers."""
