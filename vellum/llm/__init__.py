"""Operators that prepare language-model training data. Nothing else in vellum imports this package."""
