"""Operators over documents, headings, citations, terms, libraries and layouts."""
