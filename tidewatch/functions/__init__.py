"""Expressions as SQL text, for ``selectExpr`` and ``F.expr``.

Everything here is built-in SQL, so it stays inside generated code. Text rather
than ``Column`` objects keeps the driver's share of a query small: a rule is
parsed in one call, where a chain of columns takes a call per operator.
"""
