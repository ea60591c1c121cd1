"""Readers and writers of files, feeds, tables and streams."""
