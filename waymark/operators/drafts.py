"""Validation of drafted texts against the evidence they were written from, over a table of drafts.

drafts: draft_id, kind (explanation | message | reply), draft (JSON text), evidence (JSON text), friction_type,
action_ids, allowed_terms, allowed_frictions, fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import vocab
from waymark.functions.columns import strings

# --- fixed values: fields of each kind of draft and their longest text -----------------------------
KINDS = {
    "explanation": {"summary": 400, "behavior_observed": 400, "likely_business_cause": 400},
    "message": {"message": 300},
    "reply": {"reply": 700},
}
EVIDENCE_FIELD, EVIDENCE_LIMIT = "evidence_used", 12


def _fields(kind: str) -> list[str]:
    return [*KINDS[kind], *([EVIDENCE_FIELD] if kind == "explanation" else [])]


def parsed(drafts: DataFrame) -> DataFrame:
    """Add `texts`, `cited` and `schema_failures`."""
    every = sorted({f for k in KINDS for f in _fields(k)})
    schema = "struct<" + ",".join(f"{f}:{'array<string>' if f == EVIDENCE_FIELD else 'string'}" for f in every) + ">"
    keys = F.json_object_keys("draft")
    valid = F.try_parse_json("draft").isNotNull() & keys.isNotNull()
    d = drafts.withColumn("_d", F.from_json("draft", schema)).withColumn("_valid", valid).withColumn("_keys", keys)
    failures, texts = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for kind, limits in KINDS.items():
        names = _fields(kind)
        bad = [F.when(F.coalesce(~F.length(f"_d.{f}").between(1, n), F.lit(True)), F.lit(f"schema: {f}"))
               for f, n in limits.items()]
        if kind == "explanation":
            size = F.coalesce(F.size(f"_d.{EVIDENCE_FIELD}"), F.lit(-1))
            bad.append(F.when(~size.between(1, EVIDENCE_LIMIT), F.lit(f"schema: {EVIDENCE_FIELD}")))
        bad.append(F.when(F.size(F.array_except("_keys", strings(names))) > 0, F.lit("schema: extra fields")))
        here = F.col("kind") == kind
        failures = F.when(here, F.slice(F.array_compact(F.array(*bad)), 1, 5)).otherwise(failures)
        texts = F.when(here, F.array(*[F.col(f"_d.{f}") for f in limits])).otherwise(texts)
    failures = F.when(~F.col("_valid"), F.array(F.lit("schema: invalid JSON"))).otherwise(failures)
    return d.withColumns({
        "schema_failures": failures, "texts": texts, "cited": F.col(f"_d.{EVIDENCE_FIELD}"),
    }).drop("_d", "_valid", "_keys")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({vocab.NUMBER_PATTERN})"), F.lit(1))


def token_value(token: Column) -> Column:
    return F.regexp_replace(token, "[%,]", "").try_cast("double")


def evidence_numbers(evidence: Column) -> Column:
    """Numbers of a JSON text: numeric values as JSON writes them (sign and exponent too) and numbers inside texts, but not in keys."""
    values = F.regexp_replace(evidence, r'"(?:[^"\\]|\\.)*"\s*:', " ")
    text = r'"(?:[^"\\]|\\.)*"'
    inside = F.flatten(F.transform(F.regexp_extract_all(values, F.lit(f"({text})"), F.lit(1)), number_tokens))
    plain = F.regexp_extract_all(F.regexp_replace(values, text, " "), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    return F.concat(F.transform(plain, lambda t: t.try_cast("double")), F.transform(inside, token_value))


def evidence_keys(evidence: Column) -> Column:
    """Field names and text values of a JSON text."""
    quoted = F.regexp_extract_all(evidence, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_distinct(quoted)


def grounded(token: Column, numbers: Column) -> Column:
    """Is the number within 0.5 or 1 % of an evidence number, or the percent form of one?"""
    value = token_value(token)
    as_percent = F.endswith(token, F.lit("%")) | (value > 1)

    def near(n: Column) -> Column:
        return (
            (F.abs(value - n) <= 0.5) | ((n != 0) & (F.abs(value - n) <= 0.01 * F.abs(n)))
            | (as_percent & (F.abs(value / 100 - n) <= 0.005))
        )

    return F.exists(numbers, near)


def grounding_failures(texts: Column, evidence: Column, cited: Column) -> Column:
    numbers = evidence_numbers(evidence)
    tokens = F.flatten(F.transform(texts, number_tokens))
    loose = F.filter(tokens, lambda t: ~F.coalesce(grounded(t, numbers), F.lit(False)))
    wrong = F.transform(loose, lambda t: F.concat(F.lit("grounding: number '"), t, F.lit("' is not in the evidence")))
    keys = evidence_keys(evidence)
    # a path like a.b is known when all its parts are
    unknown = F.filter(F.coalesce(cited, strings([])), lambda k: ~F.array_contains(keys, k)
                       & (F.size(F.array_except(F.split(k, r"\."), keys)) > 0))
    missing = F.transform(unknown, lambda k: F.concat(F.lit("grounding: evidence key '"), k, F.lit("' is not in the packet")))
    return F.concat(wrong, missing)


def consistency_failures(blob: Column, friction: Column, action_ids: Column, allowed: Column) -> Column:
    """Mentions of another friction or of another action."""
    low = F.lower(blob)
    allowed = F.array_append(F.coalesce(allowed, strings([])), friction)
    other = []
    for f, phrases in vocab.FRICTION_PHRASES.items():
        named = low.contains(f)
        for phrase in phrases:
            named = named | low.contains(phrase)
        other.append(F.when(~F.array_contains(allowed, f) & named,
                            F.lit(f"consistency: mentions a different friction type ({f})")))
    ids = F.array_except(strings([r[2] for r in vocab.PLAYBOOK]), F.coalesce(action_ids, strings([])))
    named = F.filter(ids, lambda a: low.contains(a))
    actions = F.transform(named, lambda a: F.concat(F.lit("consistency: mentions a different action ("), a, F.lit(")")))
    return F.concat(F.array_compact(F.array(*other)), actions)


def policy_failures(blob: Column, allowed_terms: Column) -> Column:
    """Offers nobody allowed, phrases nobody may use, and personal data."""
    low = F.lower(blob)
    terms = F.transform(F.coalesce(allowed_terms, strings([])), F.lower)
    offers = F.filter(strings(vocab.OFFER_TERMS), lambda t: low.contains(t) & ~F.exists(
        terms, lambda a: a.contains(t) | t.contains(a)))
    offers = F.transform(offers, lambda t: F.concat(
        F.lit("policy: offer/money term '"), t, F.lit("' is not allowed for this action")))
    banned = F.transform(F.filter(strings(vocab.BANNED_PHRASES), lambda p: low.contains(p)),
                         lambda p: F.concat(F.lit("policy: banned phrase '"), p, F.lit("'")))
    private = F.array_compact(F.array(
        F.when(blob.rlike(vocab.EMAIL_PATTERN), "policy: contains an email address"),
        F.when(blob.rlike(vocab.PHONE_PATTERN), "policy: contains a phone number"),
        F.when(blob.rlike(vocab.ID_PATTERN), "policy: contains a customer/session/order identifier"),
        F.when(low.rlike(vocab.URL_PATTERN), "policy: contains a link")))
    return F.concat(offers, banned, private)


def validate(drafts: DataFrame) -> DataFrame:
    """Add `failures`, `ok` and `final`: the draft when all checks pass, else the fallback text."""
    d = parsed(drafts)
    blob = F.array_join("texts", " ")
    checks = F.concat(
        grounding_failures(F.col("texts"), F.col("evidence"), F.col("cited")),
        consistency_failures(blob, F.col("friction_type"), F.col("action_ids"), F.col("allowed_frictions")),
        policy_failures(blob, F.col("allowed_terms")))
    failures = F.when(F.size("schema_failures") > 0, F.col("schema_failures")).otherwise(checks)
    out = d.withColumn("failures", failures).withColumn("ok", F.size("failures") == 0)
    return out.withColumns({
        "final": F.when(F.col("ok"), F.col("draft")).otherwise(F.col("fallback")),
        "source": F.when(F.col("ok"), "draft").otherwise("fallback"),
    }).drop("schema_failures")
