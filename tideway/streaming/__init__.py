"""Vessel position streams."""
