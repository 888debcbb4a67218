"""Operators of a large-scale training-data pipeline over text tables.

Nothing else in the library imports this subpackage.  ``queries.py`` binds the operators to the
standard tables; each operator module keeps its own general interface.
"""
