"""Reusable DataFrame transformations the plans are composed of."""
