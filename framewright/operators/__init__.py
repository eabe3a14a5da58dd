"""Relational and array operators that the plans are built from."""
