"""Operators for preparing training text: formatting, filtering, scanning,
deduplication and packing of documents."""
