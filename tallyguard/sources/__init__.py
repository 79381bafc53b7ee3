"""Corpus sources: files, archives, any DataFrame of texts, and live schemas."""
