"""Relational operators: histograms, forests, physics transforms, quality checks."""
