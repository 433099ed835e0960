"""Operators of a training-data pipeline over document tables.

Nothing outside this subpackage imports it; the driver entry adds its queries
only when it is present.
"""
