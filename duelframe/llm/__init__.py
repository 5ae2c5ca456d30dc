"""Operators for preparing training data: filters, near duplicates, mixing, packing, token files, search."""
