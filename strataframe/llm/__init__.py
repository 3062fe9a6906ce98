"""Operators for preparing training text: deduplication, filters, scoring, mixing and packing."""
