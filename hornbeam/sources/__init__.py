"""Readers and writers of graphs, documents and fact files."""
