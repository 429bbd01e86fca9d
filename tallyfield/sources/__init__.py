"""Readers and writers: delimited text, nested JSON, HTML pages, typed tables."""
