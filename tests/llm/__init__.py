"""Tests of the training-data operators: a package, as another folder has a test_queries too."""
