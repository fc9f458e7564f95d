"""Structured Streaming jobs over arriving daily files."""
