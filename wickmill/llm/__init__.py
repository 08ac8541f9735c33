"""Operators that prepare training data: language, quality, duplicates, leaks, licences, privacy, mixing.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns a
DataFrame; the registered queries are thin layers in :mod:`wickmill.llm.queries`.
"""
