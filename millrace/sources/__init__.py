"""Readers: ranges and literal rows, files and tables, topics, page snapshots."""
