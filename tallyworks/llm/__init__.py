"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrames to DataFrames; :mod:`tallyworks.llm.queries` applies each one to the
standard tables.
"""
