"""Operators for training data: extraction, encoding, quality, duplicates, decontamination, privacy.

Nothing else in the library imports this subpackage.
"""
