"""Operators for preparing language-model training data, each a DataFrame -> DataFrame function."""
