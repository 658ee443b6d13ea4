"""Composite models and reconciliation plans."""
