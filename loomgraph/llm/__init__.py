"""Operators of a training-data pipeline: one module per operator, `queries` registers them.

Nothing outside this subpackage imports it.
"""
