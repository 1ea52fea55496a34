"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

Everything is a column expression over one row: no shuffle, no Python.

Defined cases: a null or empty text has no words, fails the base rule and is not kept, and its
cleaned text is empty. A null line cannot occur. Repeated rows are judged alike. Extra columns
stay; working columns start with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.base import SPACE_CLASS, SPACES, table, text_or_empty, words

# Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "subscribe to our newsletter", "click here to", "lorem ipsum", "skip to content", "back to top",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50          # of a document's word characters
NAVIGATION_ITEMS = 4           # items between separators
MAX_SYMBOL_PERCENT = 10        # of a line's word characters
UNPUNCTUATED_WORDS = 12        # a line this long needs a sentence mark
MAX_SHOUTS = 3                 # runs of two or more exclamation marks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "kept", "clean_text")

NAVIGATION = r"[\x20\t][|»›·•][\x20\t]"
SENTENCE_MARK = r"[.!?:;…。！？]"
SHOUT = r"!!+"
BOILERPLATE_PATTERN = "(?i)" + "|".join(BOILERPLATE)


def _word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACE_CLASS + "+", ""))


def _items(text: Column, pattern: str) -> Column:
    """Matches of a pattern, as the characters that are left when it alone is kept apart."""
    return F.size(F.split(text, pattern)) - 1


def line_fails(line: Column, chars: Column | None = None) -> Column:
    """A line with words fails by navigation, boilerplate, or missing, excessive or symbolic punctuation.

    ``chars``: its number of word characters, where that is known. White space at its ends is no word.
    """
    chars = _word_chars(line) if chars is None else chars
    navigation = _items(line, NAVIGATION) >= NAVIGATION_ITEMS - 1
    symbols = F.char_length(F.regexp_replace(line, r"[^#*$%&|<>]+", "")) * 100 > chars * MAX_SYMBOL_PERCENT
    unpunctuated = ~F.rlike(line, F.lit(SENTENCE_MARK)) & (_items(F.btrim(line, F.lit(SPACES)), SPACE_CLASS + "+") + 1 >= UNPUNCTUATED_WORDS)
    shouting = F.contains(line, F.lit("!!")) & (_items(line, SHOUT) >= MAX_SHOUTS)
    return (chars > 0) & (unpunctuated | symbols | navigation | shouting | F.rlike(line, F.lit(BOILERPLATE_PATTERN)))


def repeated_words(df: DataFrame, array: str, name: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window found at least twice in the array.

    The windows are sorted with their positions; equal neighbours are repeats; the covered words are
    summed over the gaps between repeated positions. n log n in the words of one document.
    """
    w, n = F.col(array), F.size(array)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i")))
    df = df.withColumn("_q_sorted", F.when(n >= 3, F.sort_array(windows)))
    s = F.col("_q_sorted")
    places = F.filter(F.transform(s, lambda x, j: F.when(
        (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_q_places", F.sort_array(places))
    p = F.col("_q_places")
    covered = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), b - a))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn(name, F.coalesce(total, F.lit(0).cast("long"))).drop("_q_sorted", "_q_places")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of MEASURES; input columns of those names are replaced."""
    docs = docs.drop(*MEASURES)
    df = docs.withColumn("_q_text", text_or_empty(text))
    df = df.withColumn("_q_words", words(F.col("_q_text"))).withColumn("_q_lines", F.split(F.col("_q_text"), "\n"))
    df = repeated_words(df, "_q_words", "n_repeat_words")
    measured = F.transform("_q_lines", lambda x: F.struct(x.alias("line"), _word_chars(x).alias("chars")))
    # A second pass over the structs, so that a line's characters are counted once and its verdict is stored.
    judged = F.transform(measured, lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), line_fails(x["line"], x["chars"]).alias("fails")))
    df = df.withColumn("_q_judged", judged)
    df = df.withColumn("_q_full", F.filter("_q_judged", lambda x: x["chars"] > 0)["line"])
    df = df.withColumn("_q_good", F.filter("_q_judged", lambda x: ~x["fails"]))
    df = df.withColumn("clean_text", F.array_join(F.col("_q_good")["line"], "\n"))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    df = df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": total(F.col("_q_judged")),
        "n_symbols": F.char_length(F.regexp_replace("_q_text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_q_full") - F.size(F.array_distinct("_q_full"))).cast("long"),
        "kept_chars": total(F.col("_q_good")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * MAX_LOST_PERCENT
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)
    # One generated row for each row: a filter on a verdict then stays above it, else the optimiser would
    # push it down and write every expression out anew inside the condition.
    df = df.withColumn("_q_row", F.explode(F.array(F.struct(*MEASURES))))
    return df.select(*docs.columns, *[F.col("_q_row")[m].alias(m) for m in MEASURES])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their cleaned text and the same columns; n_chars follows where it is there."""
    judged = judge(docs, text).filter("kept")
    changed = {c: {text: F.col("clean_text"), "n_chars": F.char_length("clean_text").cast(docs.schema[c].dataType)}.get(c, F.col(c)) for c in docs.columns}
    return judged.select(*[e.alias(c) for c, e in changed.items()])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(ls) AS l FROM w),
bad AS (SELECT rid, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS wc,
          (len(string_split_regex(l, '[\x20\t][|»›·•][\x20\t]')) >= {NAVIGATION_ITEMS}
           OR regexp_matches(l, '(?i){"|".join(BOILERPLATE)}')
           OR length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) * 100 > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) * {MAX_SYMBOL_PERCENT}
           OR (NOT regexp_matches(l, '[.!?:;…。！？]') AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= {UNPUNCTUATED_WORDS})
           OR len(string_split_regex(l, '!!+')) >= {MAX_SHOUTS + 1}) AS fails
        FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lost AS (SELECT rid, sum(wc) FILTER (WHERE NOT fails) AS kept_chars, count(*) - count(DISTINCT l) AS dup FROM bad GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
         AND NOT ((word_chars - kept_chars) * 100 > word_chars * {MAX_LOST_PERCENT}) AS kept, kept_chars
FROM f"""
