"""Operators for building training data from web-scale text.

One module per operator; :mod:`foliograph.llm.registry` binds each of them to
the tables it is meant for.  Nothing outside this subpackage imports it.
"""
