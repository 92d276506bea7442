"""Scalar expressions: identifiers, values and text."""
