"""Inline values, files and formats, and the wiki-dump store."""
