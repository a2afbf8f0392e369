"""Operators on catalogues, pixels and models."""
