"""Operators for large training-data pipelines.

Every module holds one operator with a general interface; ``registry`` binds
them to the tables of a scale-factor directory.  Nothing outside this
subpackage imports it.
"""
