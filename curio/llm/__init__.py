"""Training-data operators: dedup, decontamination, tokenising, scoring, sharding.

Nothing else in the library imports this subpackage. ``queries.py`` holds the thin registered
queries; the operators keep their own general interfaces.
"""
