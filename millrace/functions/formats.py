"""Formatting and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = "infinite"
#: Units of the formatters.
BYTE_UNITS = ("B", "kB", "MB", "GB", "TB")
RATE_UNITS = ("bit/s", "KBit/s", "MBit/s", "GBit/s", "TBit/s")
SIZE_UNITS = ("bytes", "KB", "MB", "GB", "TB")


def _one(x: Column, unit: str) -> Column:
    return F.format_string(f"%4.1f {unit}", x)


def format_seconds(c: Column) -> Column:
    """ns, us, ms or s with one decimal; '0 s' for zero, 'infinite' for infinity."""
    return (
        F.when(c == float("inf"), INFINITE)
        .when(c == 0, "0 s")
        .when(c < 1e-6, _one(c * 1e9, "ns"))
        .when(c < 1e-3, _one(c * 1e6, "us"))
        .when(c < 1, _one(c * 1e3, "ms"))
        .otherwise(_one(c, "s"))
    )


def round_up_div(value: Column, by: Column) -> Column:
    return F.call_function("div", value + by - 1, by)


def format_bytes(c: Column) -> Column:
    """Decimal units, rounded up to a whole number of the largest unit that gives at least 1."""
    out = F.concat(c.cast("string"), F.lit(f" {BYTE_UNITS[0]}"))
    expr = F.when(c < 1000, out)
    for i, unit in enumerate(BYTE_UNITS[1:], 1):
        said = F.concat(round_up_div(c, F.lit(1000**i)).cast("string"), F.lit(f" {unit}"))
        expr = expr.when(c < 1000 ** (i + 1), said) if i < len(BYTE_UNITS) - 1 else expr.otherwise(said)
    return expr


def _scaled(c: Column, base: int, units: tuple[str, ...]) -> Column:
    expr = None
    for i in range(len(units) - 1, 0, -1):
        said = F.concat(F.format_string("%.2f", c / float(base**i)), F.lit(f" {units[i]}"))
        expr = F.when(c > base**i, said) if expr is None else expr.when(c > base**i, said)
    return expr.otherwise(F.concat(F.format_string("%.2f", c.cast("double")), F.lit(f" {units[0]}")))


def size_hr(c: Column) -> Column:
    """Binary units with two decimals."""
    return _scaled(c, 1024, SIZE_UNITS)


def rate_hr(c: Column) -> Column:
    """Decimal bit rates with two decimals."""
    return _scaled(c, 1000, RATE_UNITS)


def padded_name(prefix: str, number: Column, positions: int, postfix: str) -> Column:
    """prefix, number filled up with zeros to `positions` digits (never cut), postfix."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < positions, F.lpad(digits, positions, "0")).otherwise(digits), F.lit(postfix))


def ids_to_string(ids: Column) -> Column:
    """Each id after a comma, the first one too."""
    return F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit(","), x.cast("string"))))
