"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; :mod:`cellspan.llm.queries` derives the registered ``opN_*`` queries from them.
"""
