"""Secret scans: three fixed patterns, and windows of high entropy inside candidate strings.

Column expressions over one row only. A candidate is a maximal run of token characters; a window
slides over it, and its entropy follows from the counts of its characters, which change by one
entering and one leaving character per step. Counts are five bits each, twelve in a number, so a step
changes six numbers whatever the candidate's length. Sums are whole numbers of 2^-20 bits, so they do
not drift. Windows over the threshold of the candidate's character class merge into spans. The allow-list
judges each span by its own text; only a UUID must be the whole candidate, and a path is allowed only if every
segment of it is made of words and short numbers.

Defined cases: a null or empty text has no spans (the digest is that of the empty string).
Spans may overlap across kinds, never within one. Repeated rows give equal results. Extra
columns stay; working columns start with ``_s_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.base import table, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"   # a run of fewer characters fails whole, so the length can stand in the pattern
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 6

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Bits a character, by class: hexadecimal digits, letters of one case with digits, anything else.
THRESHOLDS = {"hex": 3.0, "single": 3.6, "mixed": 3.8}
# Strings that look random and are not secrets; the first of a whole candidate, the others of a span.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_PIECE = r"([A-Z]?[a-z]+([A-Z][a-z]+)*|[A-Z]*)[0-9]{0,4}"
_SEGMENT = rf"{_PIECE}([-_=]+{_PIECE})*"
ALLOWED = (
    r"(?i)example|placeholder|dummy|changeme|your[_-]",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    rf"^{_SEGMENT}(/{_SEGMENT}){{3,}}[A-Z]?$",  # the end may cut a word
)
PER_NUMBER = 12          # counts in a number, of five bits each
BLOCK = 256              # matches whose places are added up together
UNIT = 1 << 20
_SPANS = "array<struct<start:int,end:int>>"


def _weights() -> list[int]:
    """c * log2(c) for each possible count, in units."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 2)]


def _bound(threshold: float) -> int:
    """Entropy is log2(W) - sum / W, so a high entropy is a small sum."""
    return math.floor(WINDOW * (math.log2(WINDOW) - threshold) * UNIT)


def located(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Adds the matches of a pattern in ``_s_text`` as (start, end, hit), in code points.

    Lengths add up inside blocks of matches, then over the blocks, so that no list is copied for each match.
    """
    df = df.withColumn("_s_hits", F.regexp_extract_all("_s_text", F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split("_s_text", pattern, -1), F.char_length)
    df = df.withColumn("_s_gaps", F.when(F.size("_s_hits") > 0, F.zip_with(gaps, "_s_hits", lambda g, h: F.struct(g.alias("g"), h.alias("h")))))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.coalesce(F.char_length(x["h"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("hit")))
        return F.struct(end.alias("at"), F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    def after(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["hit"].alias("hit")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    block_starts = F.sequence(F.lit(1), F.size("_s_gaps"), F.lit(BLOCK))
    blocks = F.transform(block_starts, lambda at: F.aggregate(
        F.slice("_s_gaps", at, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,hit:string>>>").alias("out"))
    found = F.flatten(F.aggregate(blocks, zero, after, lambda acc: acc["out"]))
    return df.withColumn(name, F.when(F.col("_s_gaps").isNotNull(), found).otherwise(none)).drop("_s_hits", "_s_gaps")


def high_entropy(candidate: Column, bound: Column) -> Column:
    """Merged spans of the windows of a candidate whose weighted counts sum to at most the bound."""
    weights = F.array(*[F.lit(w).cast("long") for w in _weights()])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.call_function("locate", ch, F.lit(ALPHABET)) - 1)

    def one(code: Column) -> Column:
        """A character's count: in which number it is, how far up, and a one at its place."""
        shift = (code % PER_NUMBER) * 5
        return F.struct(F.floor(code / PER_NUMBER).cast("int").alias("at"), shift.alias("shift"), F.call_function(
            "shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    none = F.lit(None).cast("struct<at:int,shift:int,one:bigint>")
    # the list is bound to a name, so that it is made once and not for every character
    steps = F.flatten(F.transform(F.array(F.transform(codes, one)), lambda c: F.transform(
        c, lambda x, i: F.struct(x.alias("new"), F.when(i >= WINDOW, F.get(c, i - WINDOW)).otherwise(none).alias("old"), i.alias("i")))))
    nothing = F.lit(None).cast("int")
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_NUMBER)).alias("counts"), F.lit(0).cast("long").alias("total"),
        bound.alias("bound"), nothing.alias("start"), nothing.alias("end"), F.array().cast(_SPANS).alias("spans"))

    def count(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, x["at"]), x["shift"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        counts, new, old = acc["counts"], x["new"], x["old"]
        k = count(counts, new)
        grown = F.get(weights, k + 1) - F.get(weights, k)
        gone = count(counts, old) + F.when((old["at"] == new["at"]) & (old["shift"] == new["shift"]), 1).otherwise(0)
        total = acc["total"] + grown + F.coalesce(F.get(weights, gone - 1) - F.get(weights, gone), F.lit(0).cast("long"))
        zero_ = F.lit(0).cast("long")
        after = F.transform(counts, lambda c, j: c + F.when(j == new["at"], new["one"]).otherwise(zero_) - F.when(j == old["at"], old["one"]).otherwise(zero_))
        start, end = x["i"] - (WINDOW - 1), x["i"] + 1
        hot = (start >= 0) & (total <= acc["bound"])
        fresh = hot & F.coalesce(acc["end"] < start, F.lit(True))
        closed = F.when(fresh & acc["end"].isNotNull(), F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"])
        return F.struct(after.alias("counts"), total.alias("total"), acc["bound"].alias("bound"), F.when(fresh, start).otherwise(acc["start"]).alias("start"),
                        F.when(hot, end).otherwise(acc["end"]).alias("end"), closed.alias("spans"))

    return F.aggregate(steps, zero, step, lambda acc: F.when(acc["end"].isNull(), acc["spans"]).otherwise(
        F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))))


def _class_bound(hit: Column) -> Column:
    single = F.rlike(hit, F.lit("^([^A-Z]*|[^a-z]*)$"))
    return (F.when(F.rlike(hit, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), _bound(THRESHOLDS["hex"]))
            .when(single, _bound(THRESHOLDS["single"])).otherwise(_bound(THRESHOLDS["mixed"])).cast("long"))


def _suspect(hit: Column) -> Column:
    return F.rlike(hit, F.lit("[0-9]")) & F.rlike(hit, F.lit("[A-Za-z]")) & ~F.rlike(hit, F.lit(UUID))


def _not_allowed(hit: Column, span: Column) -> Column:
    part = F.substring(hit, span["start"] + 1, span["end"] - span["start"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(part, F.lit(pattern))
    return ~allowed


def _tagged(spans: Column | str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: spans (start, rank, kind, end) in code points, by start and kind."""
    df = docs.withColumn("_s_text", text_or_empty(text))
    df = located(df, ASSIGN, "_s_pairs")
    df = df.withColumn("_s_assign", F.filter("_s_pairs", lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= MIN_VALUE))
    df = located(located(df, ACCESS, "_s_access"), HEX, "_s_hex")
    df = located(df, CANDIDATE, "_s_runs")
    df = df.withColumn("_s_runs", F.filter("_s_runs", lambda x: _suspect(x["hit"])))
    hot = lambda x: F.filter(high_entropy(x["hit"], _class_bound(x["hit"])), lambda s: _not_allowed(x["hit"], s))
    shifted = F.flatten(F.transform("_s_runs", lambda x: F.transform(hot(x), lambda s: F.struct(
        (s["start"] + x["start"]).alias("start"), (s["end"] + x["start"]).alias("end")))))
    df = df.withColumn("_s_entropy", F.when(F.size("_s_runs") > 0, shifted).otherwise(F.array().cast(_SPANS)))
    everything = F.concat(*[_tagged(f"_s_{kind}", kind) for kind in KINDS])
    df = df.withColumn("secrets", F.array_sort(everything))
    return df.drop("_s_text", "_s_pairs", "_s_runs", *[f"_s_{kind}" for kind in KINDS])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _if_kind(kind: str):
    return lambda x: F.when(x["kind"] == kind, 1)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    counts = [F.array_size(F.array_compact(F.transform("secrets", _if_kind(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def _sql_spans(pattern: str) -> str:
    """Matches of a pattern in ``text`` as (start, end, hit): the lengths of what lies before, summed anew for each."""
    p = pattern.replace("'", "''")
    gaps, hits = f"string_split_regex(text, '{p}')", f"regexp_extract_all(text, '{p}')"
    return (f"list_transform(range(1, len({hits}) + 1), lambda i: {{'start': CAST(list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) "
            f"+ coalesce(list_sum(list_transform(({hits})[1:i - 1], lambda h: length(h))), 0) AS BIGINT), 'hit': ({hits})[i]}})")


_ALLOWED_SQL = " OR ".join(f"regexp_matches(part, '{a}')" for a in ALLOWED)
# Every window's sum from its own counts, and islands of windows that overlap or touch.
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, 0 AS rank, 'assign' AS kind, unnest({_sql_spans(ASSIGN)}) AS s FROM d
  UNION ALL SELECT rid, 1, 'access', unnest({_sql_spans(ACCESS)}) FROM d UNION ALL SELECT rid, 2, 'hex', unnest({_sql_spans(HEX)}) FROM d
  UNION ALL SELECT rid, 3, 'run', unnest({_sql_spans(CANDIDATE)}) FROM d),
f AS (SELECT rid, rank, kind, s.start AS a, s.start + length(s.hit) AS z, s.hit AS hit FROM m),
base AS (SELECT rid, rank, kind, a, z FROM f WHERE rank < 3 AND (rank > 0 OR length(regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2)) >= {MIN_VALUE})),
c AS (SELECT rid, a, hit, CASE WHEN regexp_matches(hit, '^([0-9a-f]+|[0-9A-F]+)$') THEN {_bound(THRESHOLDS['hex'])}
        WHEN regexp_matches(hit, '^([^A-Z]*|[^a-z]*)$') THEN {_bound(THRESHOLDS['single'])} ELSE {_bound(THRESHOLDS['mixed'])} END AS bound
      FROM f WHERE rank = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{UUID}')),
w AS (SELECT rid, a, hit, bound, i, string_split(substring(hit, i + 1, {WINDOW}), '') AS chars FROM (SELECT *, unnest(range(length(hit) - {WINDOW - 1})) AS i FROM c)),
hot AS (SELECT rid, a, hit, i FROM w WHERE list_sum(list_transform(list_distinct(chars), lambda x:
        {[0] + _weights()[1:]}[1 + len(list_filter(chars, lambda y: y = x))])) <= bound),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, a ORDER BY i) AS island FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid, a ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot)),
e AS (SELECT rid, a + min(i) AS a, a + max(i) + {WINDOW} AS z, substring(any_value(hit), min(i) + 1, max(i) - min(i) + {WINDOW}) AS part FROM g GROUP BY rid, g.a, island),
spans AS (SELECT * FROM base UNION ALL SELECT rid, 3, 'entropy', a, z FROM e WHERE NOT ({_ALLOWED_SQL})),
t AS (SELECT rid, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base,
        count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2 FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)"""
