"""Operators for preparing training corpora. Nothing else in fragmill imports this package."""
