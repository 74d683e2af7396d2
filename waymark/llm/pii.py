"""Personal data: base shapes as seeds, the contexts they occur in as patterns, and what those patterns find besides.

Everything is DataFrame expressions. Base spans (seeds) and lenient candidates meet in a graph of patterns and instances; each
round scores patterns by the instances they hold and instances by the patterns that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import shared_folder, stored

#: The base shapes. `\\G` and lookbehinds only keep a search from starting anew inside a run that can't match, and
#: possessive quantifiers from going back in it: neither changes what matches, both keep very long runs linear.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Lenient candidates: spelt-out addresses, or tokens with a digit or @ side by side. Token characters are listed as ranges, all
#: but white space and , ; " ' = < >, since a negated class is many times slower.
_OTHER = r"!#-&(-+./:?\[-`{-~¡-\x{10FFFF}-"
_EDGE = rf"(?<![A-Za-z0-9@{_OTHER}])"
_NAME, _DOMAIN = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_TOKEN = rf"[A-Za-z{_OTHER}]*+[0-9@][A-Za-z0-9@{_OTHER}]*+"
CANDIDATE = (rf"{_EDGE}(?:{_NAME}(?:\x20?(?:\[at\]|\(at\))\x20?{_DOMAIN}(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20){_DOMAIN})++"
             rf"|\x20at\x20{_DOMAIN}(?:\x20dot\x20{_DOMAIN})++)|{_TOKEN}(?:\x20{_TOKEN})*+)")
#: What a candidate must look like to be taken for a kind.
LENIENT = {
    "email": r"@|\[at\]|\(at\)|\x20at\x20",
    "ip": r"^(?:(?:\[?[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f.]{0,15}\]?|[0-9]{1,3}(?:(?:\[?\.\]?|\x20?\[dot\]\x20?|\x20dot\x20)[0-9]{1,3}){3})$",
    "card": r"^(?:[0-9xX*][\x20./_-]?){12,18}[0-9xX*]$",
    "phone": r"^[+(]?(?:[0-9][\x20()./-]{0,3}){6,14}[0-9]$",
}
MARK = "\x01"  # stands around matches while they are located; texts that hold it are searched with U+0002 in its place
CHUNK = 512  # matches that one running sum walks over
CONTEXT = 64  # code points on each side in which the words of a context are looked for
ROUNDS = 3
SUPPORT = 4  # seeds or found instances that a pattern needs
CONFIDENCE = 0.7
ACCEPTED = 0.7
UNKNOWN = 0.2  # weight against a pattern of an unlabelled instance that looks like the kind; any other weighs 1
SALTS = 16


def luhn(digits: Column) -> Column:
    """Whether the sum of digits, from the right every second doubled, is divisible by ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    if kind == "card":
        return F.when(count.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    return F.lit(True)


def with_matches(docs: DataFrame, name: str, text: str, pattern: str, guard: Column) -> DataFrame:
    """docs with `name`: array<struct<start, stop, match, before, after>> of all matches, in code points. before and after are
    the texts around, up to the neighbouring matches and CONTEXT code points. Texts outside the guard have none."""
    pieces, parts = f"_{name}_pieces", f"_{name}_parts"
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    cut = docs.withColumn(pieces, F.when(guard, F.split(marked, MARK, -1)))

    def part(i: Column) -> Column:
        return F.struct(F.get(pieces, 2 * i).alias("piece"), F.get(pieces, 2 * i + 1).alias("match"), F.get(pieces, 2 * i + 2).alias("next"))

    def length(total: Column, p: Column) -> Column:
        return total + F.length(p["piece"]) + F.length(p["match"])

    # every piece's text is read once; chunks keep both the running sums and the growing arrays short
    chunked = cut.withColumn(parts, F.when(F.size(pieces) > 1, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 3) / (2 * CHUNK)).cast("int")),
        lambda c: F.transform(F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.floor(F.size(pieces) / 2).cast("int")) - 1), part))))
    sizes = chunked.withColumn(f"_{name}_sizes", F.transform(parts, lambda c: F.aggregate(c, F.lit(0), length)))
    empty = F.expr("cast(array() as array<struct<start: int, stop: int, match: string, before: string, after: string>>)")

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["piece"])
        stop = start + F.length(p["match"])
        one = F.struct(start.alias("start"), stop.alias("stop"), p["match"].alias("match"),
                       F.right(p["piece"], F.lit(CONTEXT)).alias("before"), F.left(p["next"], F.lit(CONTEXT)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    def walk(chunk: Column, c: Column) -> Column:
        begin = F.aggregate(F.slice(f"_{name}_sizes", F.lit(1), c), F.lit(0), lambda a, b: a + b)
        return F.aggregate(chunk, F.struct(begin.alias("at"), empty.alias("found")), step, lambda state: state["found"])

    found = sizes.withColumn(name, F.when(F.col(parts).isNotNull(), F.flatten(F.transform(parts, walk))).otherwise(empty))
    return found.drop(pieces, parts, f"_{name}_sizes")


def contexts(before: Column, after: Column) -> Column:
    """The patterns of a span: the two words before it, the word before and the word after, the word before. A span without a word
    before it has none."""

    def words(side: Column) -> Column:
        return F.split(F.regexp_replace(F.lower(F.trim(F.regexp_replace(side, r"\s+", " "))), "[0-9]+", "9"), " ")

    left, right = words(before), words(after)
    one, two = F.element_at(left, -1), F.coalesce(F.get(left, F.size(left) - 2), F.lit(""))
    some = F.array(F.concat_ws(" ", F.lit("2:"), two, one), F.concat_ws(" ", F.lit("1+1:"), one, F.get(right, 0)), F.concat_ws(" ", F.lit("1:"), one))
    return F.when(one != "", some).otherwise(F.expr("cast(array() as array<string>)"))


def trimmed(match: Column) -> Column:
    """A candidate without closing punctuation."""
    return F.regexp_replace(match, r"[.:!?]+$", "")


def searched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, spans): base spans that pass and lenient candidates (kind null) of every document; texts stay behind."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(F.col(key).alias("key"), F.when(F.instr(raw, MARK) > 0, F.translate(raw, MARK, "\x02")).otherwise(raw).alias("text"))
    body = F.col("text")
    has_digit = body.rlike("[0-9]")
    guards = {"email": F.instr(body, "@") > 0, "ip": has_digit, "card": has_digit, "phone": F.instr(body, "+") > 0}
    for kind, pattern in BASE.items():
        df = with_matches(df, kind, "text", pattern, guards[kind])
    df = with_matches(df, "candidate", "text", CANDIDATE, F.lit(True)).drop("text")

    def spans(kind: str | None) -> Column:
        found = F.col(kind or "candidate")
        if kind:
            found = F.filter(found, lambda s: passes(kind, s["match"]))

        def span(s: Column) -> Column:
            match = s["match"] if kind else trimmed(s["match"])
            return F.struct(F.lit(KINDS.index(kind) if kind else None).cast("int").alias("kind"), s["start"].alias("start"),
                            (s["start"] + F.length(match)).alias("stop"), F.lower(match).alias("instance"),
                            contexts(s["before"], s["after"]).alias("patterns"))

        return F.transform(found, span)

    return df.select(F.monotonically_increasing_id().alias("row"), "key", F.concat(*[spans(k) for k in KINDS], spans(None)).alias("spans"))


def free_candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, candidates) of the stored documents: one row a span; candidates that overlap a base span are left out."""
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    held = spans.where("kind is not null")
    order = Window.partitionBy("row").orderBy("start", F.col("kind").asc_nulls_last())
    based = F.col("kind").isNotNull()
    past = F.max(F.when(based, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(based, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.withColumn("past", past).withColumn("ahead", ahead)
    free = marked.where("kind is null and stop > start and coalesce(past, 0) <= start and coalesce(ahead, stop) >= stop")
    looks = F.array(*[F.col("instance").rlike(LENIENT[k]) for k in KINDS])
    return held, free.drop("kind", "past", "ahead").withColumn("looks", looks)


def salted_join(many: DataFrame, few: DataFrame, on: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Join on a column whose values may be very frequent in `many`, dealt out by the columns of `spread`, and are distinct in
    `few`."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("_salt", salt).join(few.withColumn("_salt", salts), [on, "_salt"], how).drop("_salt")


def graph(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pattern, instance, looks, fixed, s0 .. s3): every pair once however often it occurs. Seeds have score 1 for their kind."""
    numbers = range(len(KINDS))
    one = seeds.select(F.explode("patterns").alias("pattern"), "instance", F.lit(None).cast("array<boolean>").alias("looks"),
                       F.lit(True).alias("fixed"), *[(F.col("kind") == k).cast("double").alias(f"s{k}") for k in numbers])
    other = candidates.select(F.explode("patterns").alias("pattern"), "instance", "looks", F.lit(False).alias("fixed"),
                              *[F.lit(0.0).alias(f"s{k}") for k in numbers])
    return one.unionByName(other).distinct()


def score_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, c0 .. c3): the confidence for each kind, 0 where it or the support is too low; patterns without any are left out.

    confidence = seeds and found instances of the kind / (those of all kinds + weight of the unlabelled + 1)
    """
    numbers = range(len(KINDS))
    best = F.greatest(*[F.col(f"s{k}") for k in numbers])
    sums = [F.sum(f"s{k}").alias(f"p{k}") for k in numbers]
    support = [F.sum((F.col(f"s{k}") >= ACCEPTED).cast("int")).alias(f"n{k}") for k in numbers]
    against = [F.sum((1 - best) * F.when(F.col("fixed"), 0.0).when(F.col("looks")[k], UNKNOWN).otherwise(1.0)).alias(f"u{k}") for k in numbers]
    total = sum((F.col(f"p{k}") for k in numbers), F.lit(1.0))
    confidence = [F.col(f"p{k}") / (total + F.col(f"u{k}")) for k in numbers]
    kept = [F.when((F.col(f"n{k}") >= SUPPORT) & (confidence[k] >= CONFIDENCE), confidence[k]).otherwise(0.0).alias(f"c{k}") for k in numbers]
    return edges.groupBy("pattern").agg(*sums, *support, *against).select("pattern", *kept).where("greatest(c0, c1, c2, c3) > 0")


def score_instances(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(instance, t0 .. t3): 1 - product of (1 - confidence) over the patterns that hold an unlabelled instance, where it looks like
    the kind."""
    numbers = range(len(KINDS))
    met = salted_join(edges.where("not fixed").select("pattern", "instance", "looks"), patterns, "pattern", ["instance"])
    missed = [F.sum(F.when(F.col("looks")[k], F.log(1 - F.col(f"c{k}"))).otherwise(0.0)) for k in numbers]
    scores = [F.greatest(F.lit(0.0), 1 - F.exp(m)).alias(f"t{k}") for k, m in zip(numbers, missed, strict=True)]
    return met.groupBy("instance").agg(*scores).where("greatest(t0, t1, t2, t3) > 0")


@dataclass(frozen=True)
class Found:
    """documents: (key, base, added), arrays of (kind, start, stop) in code points by kind, then start. patterns: (pattern, c0 ..
    c3). instances: (instance, kind, score) of the identifiers found besides the base ones."""

    documents: DataFrame
    patterns: DataFrame
    instances: DataFrame


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Found:
    """Base spans of every document, and the spans of unseen identifiers that confident patterns find.

    A candidate never overlaps a base span. An instance is accepted for its best kind at a score of ACCEPTED and then marked
    wherever it occurs. Null and empty texts have no spans; every row keeps a row of its own, repeated and null keys included;
    an empty table gives no rows; columns other than key and text are not read.
    """
    folder = shared_folder(docs.sparkSession)
    numbers = range(len(KINDS))
    found = stored(searched(docs, key, text), f"{folder}/found")
    seeds, candidates = free_candidates(found)
    candidates = stored(candidates, f"{folder}/candidates")
    edges = stored(graph(seeds, candidates), f"{folder}/edges0")
    for step in range(1, rounds + 1):
        patterns = stored(score_patterns(edges), f"{folder}/patterns{step}")
        instances = stored(score_instances(edges, patterns), f"{folder}/instances{step}")
        if step == rounds or instances.isEmpty():
            break
        free = salted_join(edges.where("not fixed").drop(*[f"s{k}" for k in numbers]), instances, "instance", ["pattern"], "left")
        free = free.select("pattern", "instance", "looks", "fixed", *[F.coalesce(f"t{k}", F.lit(0.0)).alias(f"s{k}") for k in numbers])
        edges = stored(edges.where("fixed").unionByName(free), f"{folder}/edges{step}")
    best = F.greatest(*[F.col(f"t{k}") for k in numbers])
    kind = F.coalesce(*[F.when(F.col(f"t{k}") == best, k) for k in numbers])
    accepted = instances.where(best >= ACCEPTED).select("instance", kind.alias("kind"), best.alias("score"))
    spans = (salted_join(candidates.select("row", "start", "stop", "instance"), accepted.select("instance", "kind"), "instance", ["row", "start"])
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("added")))
    based = F.filter("spans", lambda s: s["kind"].isNotNull())
    based = F.array_sort(F.transform(based, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    none = F.expr("cast(array() as array<struct<kind: int, start: int, stop: int>>)")
    documents = (found.select("row", "key", based.alias("base")).join(spans, "row", "left")
                 .select(F.col("key").alias(key), "base", F.coalesce("added", none).alias("added")))
    return Found(documents, patterns, accepted)


def described(spans: Column) -> Column:
    """`kind:start:end` of every span, by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
