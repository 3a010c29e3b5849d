"""State semantics as DataFrame operators.

Operators are pure: they take DataFrames and an explicit now_ms, and return what is visible, or the rows to append.
"""
