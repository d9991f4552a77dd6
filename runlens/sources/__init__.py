"""Readers, converters and writers."""
