"""Operators for training-data pipelines: documents and pages in, DataFrames out.

Nothing outside this subpackage imports it.  Every module holds one operator with a general
interface; ``queries`` derives the registered ``opN_*`` results from them.
"""
