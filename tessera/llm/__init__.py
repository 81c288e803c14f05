"""Operators that prepare training text: one module for each operator, queries in ``queries``.

Nothing outside this subpackage imports it, so it can be deleted as a whole.
"""
