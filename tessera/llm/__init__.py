"""Operators for preparing training data at scale.

Nothing outside this folder imports it: the package may be removed and the rest still works.
"""
