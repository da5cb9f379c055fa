"""Readers and writers of trees, catalogues, tables and settings."""
