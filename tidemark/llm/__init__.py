"""Operators for preparing training data.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
(``QUERIES``) and the SQL they are held against (``ORACLE_SQL``).
"""
