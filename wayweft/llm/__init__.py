"""Operators for training corpora. Nothing outside this subpackage imports it."""
