"""Readers that turn transcript files into entries, issues and chunks."""
