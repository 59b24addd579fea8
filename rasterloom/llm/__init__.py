"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames; `queries` binds them to the test tables.
"""
