"""Module pipelines and catalogue queries."""
