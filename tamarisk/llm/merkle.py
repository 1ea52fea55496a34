"""A Merkle manifest of a dataset, kept as a postorder append log with proofs for every row.

A row becomes a leaf: the SHA-256 of its fields. The leaves of a tree (here: of a source) are numbered in
key order; every 16 consecutive nodes become their digest, and so on until one is left. The trees' roots,
in order of their names, are the leaves of a last tree, whose root stands for the dataset.

Builders are aligned: one takes the 4,096 leaves of a whole subtree and writes its nodes in the order in which
they complete, children before their parent. Nothing is exchanged between builders. In such a log a node's
position follows from sizes alone: of a node whose leaves end at e, every level up to its own has completed
ceil(e / 16^m) nodes and every level above floor((e - 1) / 16^m). So any sibling is addressed in closed form, both
in the whole log of a tree and in the log of one builder. Roots of builders are the leaves of the next tier of
builders, until a tree has one root; there are as many tiers as the depth of the largest tree over three.

A proof is the siblings of a leaf, level by level to the last root. A builder's leaves share the part of it
above their builder, which comes down tier by tier as one row for each builder; the part inside is read from
the builder's log. So no row is joined with its siblings, and a tree of any size is spread over its builders.

Log: tree, tier, segment (which builder), leaves, digests (64 hex characters for each node, in completion order).

Defined cases: a null field is ``-``; the query tampers with no null id; a null source is a tree of its own, the first; null ids come first;
repeated ids are ordered by leaf; an empty table has no rows and no root. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tamarisk.functions.ordered import BUCKET, range_bucketed
from tamarisk.llm.base import rows_of, table
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 16
BUILDER_LEVELS = 3  # a builder has FANOUT ** BUILDER_LEVELS leaves
HEX = 64
ALL = "all"         # the name of the tree over the trees' roots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOG = "tree string, tier int, segment long, leaves long, digests string"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` or its number of UTF-8 bytes, ``:`` and its text."""
    framed = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def digest(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def depth_of(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    depth = 0
    while FANOUT ** depth < leaves:
        depth += 1
    return depth


def positions(level: int, leaves: int, depth: int) -> np.ndarray:
    """The place in completion order of every node of a level, from the number of leaves alone."""
    size = FANOUT ** level
    ends = np.minimum((np.arange(-(-leaves // size)) + 1) * size, leaves)
    return sum(-(-ends // FANOUT ** m) if m <= level else (ends - 1) // FANOUT ** m for m in range(depth + 1)) - 1


def completion_log(leaves: list[str], depth: int) -> list[str]:
    """All nodes over the leaves, each written when its last child is there."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(depth + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        open_[level].append(node)
        if level < depth and len(open_[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        add(level + 1, digest("".join(children)))

    for leaf in leaves:
        add(0, leaf)
    for level in range(depth):
        if open_[level]:
            close(level)
    return log


def numbered_leaves(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds at (0-based, in the order) and total to the rows of each ``tree``; a tree of any size is cut by range."""
    cut = range_bucketed(rows, ["tree"], order)
    per = cut.groupBy("tree", BUCKET).agg(F.count("*").alias("_n"))
    by_tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(by_tree.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(per.select("tree", BUCKET, before.alias("_before"), F.sum("_n").over(by_tree).alias("total")))  # a row for each tree and bucket
    inside = F.row_number().over(W.partitionBy("tree", BUCKET).orderBy(*order))
    return (cut.withColumn("_inside", inside).join(starts, ["tree", BUCKET])
            .select(*rows.columns, (F.col("_before") + F.col("_inside") - 1).alias("at"), "total"))


def _built(leaves: DataFrame, tier: int, levels: int) -> DataFrame:
    """One tier of builders over (tree, at, total, digest): a log row for each."""
    whole = FANOUT ** levels
    out = pa.schema([("tree", pa.string()), ("tier", pa.int32()), ("segment", pa.int64()), ("leaves", pa.int64()), ("digests", pa.string())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def row():
            log = completion_log(held, levels if key[2] > whole else depth_of(key[2]))
            return pa.RecordBatch.from_pylist([dict(tree=key[0], tier=tier, segment=key[1], leaves=len(held), digests="".join(log))], schema=out)

        for tree, segment, total, node in rows_of(batches, 4096):
            if (tree, segment, total) != key:
                if held:
                    yield row()
                held, key = [], (tree, segment, total)
            held.append(node)
        if held:
            yield row()

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = leaves.select("tree", F.floor(F.col("at") / whole).alias("segment"), "total", "digest", "at")
    dealt = placed.repartition(parts, "tree", "segment").sortWithinPartitions("tree", "segment", "at")
    return dealt.select("tree", "segment", "total", "digest").mapInArrow(build, LOG)


def build(leaves: DataFrame, levels: int = BUILDER_LEVELS) -> DataFrame:
    """The log of all trees over numbered leaves (tree, at, total, digest)."""
    whole, tiers, tier = FANOUT ** levels, [], 0
    while True:
        log = materialise(_built(leaves, tier, levels))
        tiers.append(log)
        # a tree is done when it has one builder; the roots of the others are the next tier's leaves
        tops = log.select("tree", F.col("segment").alias("at"), F.right("digests", F.lit(HEX)).alias("digest"))
        counts = tops.groupBy("tree").agg(F.count("*").alias("total")).filter("total > 1")
        leaves, tier = materialise(tops.join(counts, "tree")), tier + 1
        if leaves.isEmpty():
            return reduce(DataFrame.unionAll, tiers)


def roots(log: DataFrame) -> DataFrame:
    """tree, root: what the last builder of each tree wrote last."""
    tops = log.groupBy("tree").agg(F.max("tier").alias("tier"))
    return log.join(tops, ["tree", "tier"]).select("tree", F.right("digests", F.lit(HEX)).alias("root"))


def nodes(log: DataFrame, levels: int = BUILDER_LEVELS) -> DataFrame:
    """tree, position, level, index, digest: the log written out, positions counted over the whole tree."""
    sizes = log.filter("tier = 0").groupBy("tree").agg(F.sum("leaves").alias("size"))
    out = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, tier, segment, leaves, digests, size in rows_of(batches, 4):
            depth, inner = depth_of(size), levels if FANOUT ** (levels * (tier + 1)) < size else depth_of(leaves)
            for level in range(1 if tier else 0, inner + 1):
                place, above = positions(level, leaves, inner), level + tier * levels
                index = segment * FANOUT ** (levels - level) + np.arange(len(place))
                ends = np.minimum((index + 1) * FANOUT ** above, size)
                whole = sum(-(-ends // FANOUT ** m) if m <= above else (ends - 1) // FANOUT ** m for m in range(depth + 1)) - 1
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(place)), pa.array(whole), pa.array([above] * len(place), pa.int32()), pa.array(index),
                                                  pa.array([digests[HEX * p:HEX * p + HEX] for p in place])], schema=out)

    return log.join(sizes, "tree").select("tree", "tier", "segment", "leaves", "digests", "size").mapInArrow(
        run, "tree string, position long, level int, index long, digest string")


def runs_of(digests: str, leaves: int, depth: int) -> list[list[str]]:
    """For each level the joined digests of every run of siblings, read from a builder's log by position."""
    out = []
    for level in range(depth):
        nodes_ = [digests[HEX * p:HEX * p + HEX] for p in positions(level, leaves, depth)]
        out.append(["".join(nodes_[k:k + FANOUT]) for k in range(0, len(nodes_), FANOUT)])
    return out


def _with_paths(leaves: DataFrame, log: DataFrame, levels: int, carried: list[str]) -> DataFrame:
    """Numbered leaves (tree, at, *carried) with root, places and siblings: from their builder's log, then from its own path.

    ``log`` is one tier's rows with the root of their tree and the path (places, siblings) of each builder's own.
    """
    whole = FANOUT ** levels
    # a builder's log comes before its leaves
    logs = log.select("tree", "segment", F.lit(-1).cast("long").alias("at"), "leaves", "lone", "digests", "root", "places", "siblings",
                      *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in carried])
    rows = leaves.select("tree", F.floor(F.col("at") / whole).alias("segment"), "at", F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("boolean").alias("lone"),
                         F.lit(None).cast("string").alias("digests"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("array<int>").alias("places"),
                         F.lit(None).cast("array<string>").alias("siblings"), *carried)
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = logs.unionAll(rows).repartition(parts, "tree", "segment").sortWithinPartitions("tree", "segment", "at")
    shape = both.select("tree", "at", *carried, "root", "places", "siblings").schema
    out = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, up, top, made = [], ([], []), None, []
        for tree, segment, at, leaves_, lone, digests, root, places, siblings, *rest in rows_of(batches, 1024):
            if at < 0:
                runs, up = runs_of(digests, leaves_, depth_of(leaves_) if lone else levels), (places, siblings)
                top = root
                continue
            k, own = at - segment * whole, ([], [])
            for level in runs:
                run_, place = divmod(k, FANOUT)
                own[0].append(place)
                own[1].append(level[run_][:HEX * place] + level[run_][HEX * (place + 1):])
                k = run_
            made.append((tree, at, *rest, top, own[0] + up[0], own[1] + up[1]))
            if len(made) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return both.mapInArrow(run, shape)


def proofs(leaves: DataFrame, log: DataFrame, above: DataFrame, carried: list[str], levels: int = BUILDER_LEVELS) -> DataFrame:
    """Numbered leaves (tree, at, *carried) with their tree's root and whole proofs: places and siblings of each level.

    ``above``: tree, root, places, siblings of each tree's root in the tree over it (empty for the last tree).
    """
    tiers = (log.agg(F.max("tier")).first()[0] or 0) + 1
    last = log.groupBy("tree").agg(F.max("tier").alias("top"))
    log = log.join(last, "tree").withColumn("lone", F.col("tier") == F.col("top"))
    paths = None  # of the builders' roots in the tier above
    for tier in range(tiers - 1, -1, -1):
        here = log.filter(F.col("tier") == tier)
        ends = here.filter("lone").join(above, "tree").select("tree", "segment", "leaves", "lone", "digests", "root", "places", "siblings")
        if paths is not None:
            inner = here.filter("NOT lone").join(paths.withColumnRenamed("at", "segment"), ["tree", "segment"])
            ends = ends.unionAll(inner.select(*ends.columns))
        of_tier = leaves if tier == 0 else log.filter(F.col("tier") == tier - 1).filter("NOT lone").select("tree", F.col("segment").alias("at"))
        paths = _with_paths(of_tier, ends, levels, carried if tier == 0 else [])
        if tier:
            paths = materialise(paths)
    return paths


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf leads to with a proof."""
    step = lambda h, s: F.sha2(F.concat(F.left(s["siblings"], s["places"] * HEX), h, F.substr(s["siblings"], s["places"] * HEX + 1)).cast("binary"), 256)
    return F.aggregate(F.arrays_zip(places.alias("places"), siblings.alias("siblings")), leaf, step)


def manifest(rows: DataFrame, tree: Column, key: str, carried: list[str], levels: int = BUILDER_LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proofs of all rows (tree, at, *carried, subroot, places, siblings), the log of the trees, and that of the tree over their roots.

    ``rows`` has the leaf as ``digest``; trees are ordered by the bytes of their name, the null one first.
    """
    named = rows.select(F.coalesce(F.concat(F.lit("s"), tree.cast("string")), F.lit("")).alias("tree"), key, "digest", *[c for c in carried if c not in (key, "digest")])
    leaves = materialise(numbered_leaves(named, [key, "digest"]))
    log = build(leaves, levels)
    tops = materialise(roots(log))
    upper = materialise(numbered_leaves(tops.select(F.lit(ALL).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"]))
    upper_log = build(upper, levels)
    nothing = roots(upper_log).select("tree", "root", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"))
    above = materialise(proofs(upper, upper_log, nothing, ["name", "digest"], levels))
    inherited = above.select(F.col("name").alias("tree"), F.col("digest").alias("root"), "places", "siblings")
    return proofs(leaves, log, inherited, carried, levels).withColumnRenamed("root", "subroot"), log, upper_log


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(touched, leaf(F.translate("text", UPPER, LOWER)))  # null where nothing was touched
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), changed.alias("tampered"))
    proved, _, upper = manifest(rows, F.col("source"), "doc_id", ["doc_id", "digest", "tampered"])
    root = next((r.root for r in roots(upper).collect()), None)  # one tree, one row
    out = proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("places"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Common tables of a tree over leaves (g, i, h): nodes of each level, runs, and the root of each g."""
    steps = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        steps.append(f"{name}r{k} AS (SELECT g, i // {FANOUT} AS i, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        steps.append(f"{name}{k + 1} AS (SELECT g, i, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY g) AS n FROM {name}r{k})")
    steps.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    return ",\n".join(steps)


def _fold_sql(name: str, start: str, levels: int) -> str:
    """Common tables that fold h of (rid, g, i, h, proof) up a tree; the last one has (rid, h, proof)."""
    steps, last = [], start
    for k in range(levels):
        own = "CAST(w.i % 16 AS INTEGER)"
        steps.append(f"""{name}{k} AS (SELECT rid, w.g, w.i // {FANOUT} AS i,
  CASE WHEN hs IS NULL THEN w.h ELSE sha256(array_to_string(list_concat(hs[1:{own}], [w.h], hs[{own} + 2:]), '')) END AS h,
  proof || CASE WHEN hs IS NULL THEN '' ELSE array_to_string(list_concat(hs[1:{own}], hs[{own} + 2:]), '') END AS proof
  FROM {last} AS w LEFT JOIN {start[0]}r{k} AS r ON r.g = w.g AND r.i = w.i // {FANOUT})""")
        last = f"{name}{k}"
    return ",\n".join(steps)


def _leaf_sql(text: str) -> str:
    framed = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [ord(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384::BIGINT) ELSE xor(c, x) >> 1 END), 4294967295::BIGINT)"""
SQL_LEVELS, SQL_TREE_LEVELS = 6, 4  # 16 ** 6 documents of a source, 16 ** 4 sources
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
tl AS (SELECT g, i, leaf AS h FROM l),
{_tree_sql("t", "tl", SQL_LEVELS)},
ul AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, g AS name, h FROM t_root),
{_tree_sql("u", "ul", SQL_TREE_LEVELS)},
t AS (SELECT rid, g, i, coalesce(other, leaf) AS h, '' AS proof FROM l),
{_fold_sql("f", "t", SQL_LEVELS)},
u AS (SELECT rid, 0 AS g, ul.i, f.h, f.proof FROM f{SQL_LEVELS - 1} AS f JOIN ul ON ul.name = f.g),
{_fold_sql("v", "u", SQL_TREE_LEVELS)}
SELECT doc_id, leaf, t_root.h AS subroot, u_root.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = u_root.h AS verified
FROM v{SQL_TREE_LEVELS - 1} AS v JOIN l USING (rid) JOIN t_root ON t_root.g = l.g, u_root
"""
