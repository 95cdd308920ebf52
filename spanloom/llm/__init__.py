"""Operators that a training-data pipeline needs, each ``DataFrame -> DataFrame``.

Nothing outside this folder imports it.
"""
