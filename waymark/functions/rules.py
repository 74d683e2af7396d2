"""Rule table to column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab
from waymark.functions.columns import lookup


def rule_flags(rules: Sequence[tuple] = vocab.RULES) -> Column:
    """Names of the rules that fire, in table order. Predicates are SQL over feature columns."""
    fired = [F.when(F.expr(predicate), F.lit(name)) for name, _, predicate, _ in rules]
    return F.array_compact(F.array(*fired))


def evaluate_rules(features: DataFrame, rules: Sequence[tuple] = vocab.RULES) -> DataFrame:
    """Add `rule_flags`. Features the frame does not have count as 0."""
    known = [*vocab.FEATURE_COLUMNS, *vocab.JOIN_COLUMNS]
    missing = [c for c in known if c not in features.columns and any(c in r[2] for r in rules)]
    filled = features.withColumns({c: F.lit(0.0) for c in missing}) if missing else features
    return filled.withColumn("rule_flags", rule_flags(rules)).drop(*missing)


def rule_frictions(flags: Column) -> Column:
    """Frictions the flags point at, first fired first."""
    return F.array_distinct(F.array_compact(F.transform(flags, lambda f: lookup(vocab.RULE_FRICTION, f))))
