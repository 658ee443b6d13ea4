"""Scalar functions of the domain."""
