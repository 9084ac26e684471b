"""Readers of files and connectors to what isn't a file."""
