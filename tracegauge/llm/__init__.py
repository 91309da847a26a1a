"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; the root entry module adds its queries only where it is present.
"""
