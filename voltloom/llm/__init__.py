"""Operators on texts for language-model corpora. Nothing outside this package imports it."""
