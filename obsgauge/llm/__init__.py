"""Operators on text corpora: quality, safety, tokens, duplicates, mixing and layout."""
