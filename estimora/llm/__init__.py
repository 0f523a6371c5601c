"""Operators on training corpora. Nothing outside this subpackage imports it."""
