"""Relational, window, ledger, rating, quality and model operators."""
