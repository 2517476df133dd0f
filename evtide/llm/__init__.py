"""Operators for preparing text corpora: URL filter, packing, license and
secret scans, fingerprints, near-duplicate detection, quality model, piece
encoding, nearest neighbours and line dedup.

Nothing else in the library imports this subpackage.
"""
