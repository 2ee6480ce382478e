"""Operators of a training-data pipeline: URL rules, near-duplicates, quality,
mixing, packing and scoring.  Nothing else in the library imports this package.

Each module states how it treats nulls, empty and very long texts, ties,
repeated rows, empty tables and clashing column names.
"""
