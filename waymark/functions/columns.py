"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(values: Mapping[str, object], key: Column, default: object = None) -> Column:
    """Value of a fixed table for `key`; null (or `default`) when the key is unknown."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def strings(values: Sequence[str]) -> Column:
    """Literal array of strings, also when it is empty."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def position(values: Sequence[str], key: Column) -> Column:
    """0-based place of `key` in a fixed list, null when it is not in it."""
    return lookup({v: i for i, v in enumerate(values)}, key)


def any_of(column: Column, values: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def meta(key: str) -> Column:
    return F.col("metadata")[F.lit(key)]


def number(value: Column) -> Column:
    """Text to double; null for anything that is not a number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(number(value), F.lit(0.0))


def truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "false", "0", "0.0", "null"), F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(condition, 1).otherwise(0)


def micros(ts: Column | str = "timestamp") -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def hash32(text: Column) -> Column:
    """First 32 bits of the SHA-256 of a text, as a non-negative number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def bucket(text: Column, mod: int) -> Column:
    return F.pmod(hash32(text), F.lit(mod))


def share(text: Column) -> Column:
    """Stable position of a text in [0, 1]."""
    return hash32(text) / F.lit(0xFFFFFFFF)


def percent(x: Column) -> Column:
    """0.824 -> '82%'."""
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double; null when the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
