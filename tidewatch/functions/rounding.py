"""Means rounded half-up to hundredths in decimal arithmetic.

A mean of two-decimal values often ends on an exact half, where floating-point
rounding depends on the engine. Sums of decimals do not: they are exact in six
places, for values of any size below ``LARGEST``.
"""

from __future__ import annotations

#: From here on a value counts as infinite: its hundredths fill a bigint.
LARGEST = "1e16D"


def is_finite(value: str) -> str:
    """False for NaN, which Spark orders above all numbers, as well."""
    return f"abs({value}) < {LARGEST}"


def exact(value: str) -> str:
    """The value to six places, as a decimal whose sums lose nothing."""
    return f"CAST({value} AS DECIMAL(38, 6))"


def floor_div(a: str, b: str) -> str:
    """Division towards minus infinity; ``b`` is positive."""
    return f"(({a}) - pmod({a}, {b})) DIV ({b})"


def mean_hundredths(total: str, count: str) -> str:
    """Half-up hundredths of ``total / count``, as a bigint."""
    return floor_div(f"200 * {total} + {count}", f"2 * {count}")
