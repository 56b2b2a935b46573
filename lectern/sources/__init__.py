"""Readers: fixture tables, markdown folders, reference files, layout items."""
