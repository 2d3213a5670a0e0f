"""Operators for preparing training text at scale; nothing outside this package imports it."""
