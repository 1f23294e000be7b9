"""Operators for preparing training data: deduplication, language
identification, fingerprints, packing, mixing and formatting.

Nothing else in the library imports this subpackage.
"""
