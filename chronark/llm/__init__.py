"""Operators for large text collections: mixing, joins on similarity, sharding, cleaning and scoring.

Nothing else in the library imports this subpackage.
"""
