"""Relational and graph operators, registered by name."""
