"""Operators on modalities."""
