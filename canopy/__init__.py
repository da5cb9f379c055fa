"""Merger-forest analytics on Spark: sources, evolution, physics modules and catalogue queries as DataFrame plans."""
