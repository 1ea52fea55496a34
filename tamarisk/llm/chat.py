"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
its reply is trainable. The formatted turns of a conversation are stored once as a stream; an
example is one row that names how much of the stream is its context and which part is its reply.
The prefixes of a conversation nest, so the output stays linear in the input where written-out
prefixes would grow with the square of the turns; ``example_texts`` writes them out on demand.

Template: ``### role: text</turn>`` and a line feed. Inside roles and texts each ``#``, ``<`` and
``\\`` (in roles ``:`` too) is followed by an added ``\\``, so no marker can arise in them, and
removing it gives the original back.

Defined cases: turns go by (turn, role, text), nulls first; repeated rows stay; a null text or role
is empty; a null conversation id is a conversation; a conversation without an assistant turn has a
stream and no example. Extra columns are left out. Working columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.ordered import running_totals
from tamarisk.llm.base import table
from tamarisk.session import materialise

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
TRAINED_ROLE = "assistant"
_IN_TEXT, _IN_ROLE = r"([#<\\])", r"([#<\\:])"


def escape(text: Column, marks: str = _IN_TEXT) -> Column:
    return F.regexp_replace(text, marks, r"$1\\")


def unescape(text: Column, marks: str = _IN_TEXT) -> Column:
    return F.regexp_replace(text, marks + r"\\", "$1")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, start, reply_start, reply_end, trained, segment: the stream by turn, offsets in code points.

    Offsets are running sums that no single task orders alone, however long a conversation is.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), _IN_ROLE), F.lit(MIDDLE))
    segment = F.concat(head, escape(F.col("text")), F.lit(TAIL))
    turns = turns.withColumn("head_chars", F.char_length(head).cast("long")).withColumn("segment", segment)
    turns = turns.withColumn("chars", F.char_length("segment").cast("long"))
    placed = running_totals(turns, ["conv_id"], ["turn", "role", "text"], {"_end": F.col("chars"), "_number": F.lit(1).cast("long")})
    return placed.select(
        "conv_id", (F.col("_number") - 1).alias("number"), (F.col("_end") - F.col("chars")).alias("start"),
        (F.col("_end") - F.col("chars") + F.col("head_chars")).alias("reply_start"),
        (F.col("_end") - len(TAIL)).alias("reply_end"), (F.col("role") == TRAINED_ROLE).alias("trained"), "segment")


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn: its context is the stream before ``context_chars``, its loss mask [loss_start, loss_end)."""
    return turns.filter("trained").select(
        "conv_id", F.col("number").alias("target"), F.col("reply_start").alias("context_chars"),
        F.col("reply_start").alias("loss_start"), F.col("reply_end").alias("loss_end"))


def example_texts(turns: DataFrame) -> DataFrame:
    """conv_id, target, text, loss_start, loss_end with each example's prefix written out.

    The size is the sum of all prefixes; write it only for conversations of a bounded length.
    """
    ends = examples(turns).withColumnRenamed("conv_id", "_conv")
    inside = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("number") <= F.col("target")))
    parts = inside.groupBy("conv_id", "target", "loss_start", "loss_end").agg(
        F.array_sort(F.collect_list(F.struct("number", "segment"))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["segment"]), "")
    return parts.select("conv_id", "target", text.alias("text"), "loss_start", "loss_end")


def read_streams(turns: DataFrame, masks: DataFrame) -> DataFrame:
    """conv_id, stream and its loss masks in order, put together from the written rows."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "segment"))).alias("_parts"))
    masked = masks.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("loss_start", "loss_end"))).alias("masks"))
    joined = whole.join(masked, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", F.array_join(F.transform("_parts", lambda p: p["segment"]), "").alias("stream"), "masks")


def parsed(streams: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``losses`` (the trained texts), unescaped."""
    bodies = F.split("stream", TAIL, -1)

    def turn(body: Column) -> Column:
        role = F.substring_index(body, MIDDLE, 1)
        return F.struct(
            unescape(F.substring(role, len(HEAD) + 1, F.char_length(role)), _IN_ROLE).alias("role"),
            unescape(F.substring(body, F.char_length(role) + len(MIDDLE) + 1, F.char_length(body))).alias("text"))

    turns = F.transform(F.slice(bodies, F.lit(1), F.size(bodies) - 1), turn)
    losses = F.transform("masks", lambda m: unescape(F.substring(
        F.col("stream"), (m["loss_start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int"))))
    return streams.withColumn("turns", turns).withColumn("losses", F.coalesce(losses, F.array().cast("array<string>")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the written streams and examples. One conversation's stream is one value here, as its digest asks."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    test = spark.sql(r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS INT) AS turn, role, '\\### Assistant: </turn> ok' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    turns = materialise(formatted_turns(given.unionByName(test)))
    read = parsed(read_streams(turns, materialise(examples(turns))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("stream").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 4 + length(regexp_replace(role, '([#<\\:])', '\1+', 'g')) + 2 + length(regexp_replace(text, '([#<\\])', '\1+', 'g')) + 8 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
