"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames,
reads only the columns that it names and ignores all others.
"""
