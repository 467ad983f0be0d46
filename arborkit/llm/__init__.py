"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` binds them to the registered ``opN_<name>`` queries.
"""
