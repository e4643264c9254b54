"""Operators for preparing training data: scoring, mixing, packing, scanning, joining and sharding.

Nothing else in the library imports this subpackage.
"""
