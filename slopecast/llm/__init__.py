"""Operators for preparing training text: identify, judge, deduplicate, decontaminate, format, pack and store it."""
