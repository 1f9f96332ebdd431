"""Readers of tables and raw feeds, and writers of derived files."""
