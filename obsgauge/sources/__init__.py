"""Readers, backend counts and snapshot tables."""
