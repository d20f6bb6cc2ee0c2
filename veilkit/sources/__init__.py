"""Audit schema, readers, writers and the views derived from other tables."""
