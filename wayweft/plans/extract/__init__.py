"""Extraction of graph facts from files, one module per family of formats."""
