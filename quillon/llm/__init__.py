"""Operations for preparing training data: one module per operator.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and SQL that the entry module registers.
"""
