"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  ``queries.py`` lists the queries
and the SQL that this subpackage adds to ``__spark_entry__``.
"""
