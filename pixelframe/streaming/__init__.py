"""Streams of measurements."""
