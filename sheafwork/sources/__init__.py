"""Catalogs, request batches and sinks."""
