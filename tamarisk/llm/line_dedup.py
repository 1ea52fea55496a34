"""Line dedup by sharded minimal perfect hashing.

Every document gives the 128-bit hashes of its distinct long lines. Counting them yields, for each
distinct line, how many documents hold it and the largest document id. The distinct hashes are dealt
to shards of a bounded number of keys; a shard becomes one minimal perfect hash (a cascade of bit
arrays) that indexes three compact arrays: fingerprints, saturated counts, and the document that
keeps the line. Documents' hashes are sent to the shards and probe the arrays; what comes back is
only the lines to drop.

A line that very many documents hold would send a third of all rows to one shard, so the lines above
``1 / (4 * partitions)`` of all rows go into a shard of their own: fewer than four per partition can
exist, which bounds its size, and it is probed where the documents' hashes are read.

Defined cases: a null or empty text is one empty line; short lines always stay; a document is a row,
so repeated rows count each and all rows of the largest id keep the line; a null id is below any
other. An empty table gives no rows. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm.base import SPACE_BYTES, over_rows, table
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 100_000
GAMMA = 2           # bits for each key of a level
NO_ID = -(1 << 63)  # stands for a null id among the ids
STEP = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes | None:
    """The line without outer white space, A-Z in lower case; None when it is too short to be dropped."""
    key = line.strip(SPACE_BYTES).lower()  # of bytes: ASCII letters only
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return key


def key_hashes(text: str | None) -> list[tuple[int, int]]:
    """Two signed 64-bit hashes for each distinct long line."""
    keys = {k for k in map(line_key, (text or "").encode().split(b"\n")) if k is not None}
    out = []
    for k in keys:
        h = xxhash.xxh3_128_digest(k)
        out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
    return out


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2: a row for each distinct long line of each document."""
    def batch(ids, texts):
        rows = [(i, a, b) for i, t in zip(ids, texts) for a, b in key_hashes(t)]
        return list(zip(*rows)) if rows else ([], [], [])
    return over_rows(docs.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, h1 long, h2 long")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit keys that differs by seed."""
    x = keys ^ np.uint64(STEP * (seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places at a level depend on both halves, so two keys that meet at one level part at another."""
    both = _mixed(h1.view(np.uint64), 2 * level) + _mixed(h2.view(np.uint64), 2 * level + 1)
    return (both % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A cascade of bit arrays: a key's place is the first level at which it falls on a set bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(bits.sum()) for bits in levels]])
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """The keys (h1, h2) are distinct."""
        levels: list[np.ndarray] = []
        while len(h1):
            size = GAMMA * len(h1)
            place = _places(h1, h2, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = ~alone[place]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key's index below the number of keys; -1 or any index for a foreign key."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, bits in enumerate(self.levels):
            place = _places(h1[left], h2[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = self.before[level] + self.ranks[level][place[hit]]
            left = left[~hit]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            width = -(-n // 8)
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, width, at), count=n).astype(bool))
            at += width
        return cls(levels)


class LineIndex:
    """The arrays of one shard."""

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.perfect, self.prints, self.counts, self.keepers = perfect, prints, counts, keepers

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineIndex:
        perfect = PerfectHash.build(h1, h2)
        at = perfect.index(h1, h2)
        prints, sums, kept = np.empty(len(h1), np.int64), np.empty(len(h1), np.uint8), np.empty(len(h1), np.int64)
        prints[at], sums[at], kept[at] = h2, np.minimum(counts, 255), keepers
        return cls(perfect, prints, sums, kept)

    def known(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's index, and whether the fingerprint there is its own."""
        at = self.perfect.index(h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        return at, known

    def dropped(self, doc_ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True for lines that enough documents hold and another document keeps."""
        at, known = self.known(h1, h2)
        out = np.zeros(len(h1), bool)
        out[known] = (self.counts[at[known]] >= MIN_DOCS) & (self.keepers[at[known]] != doc_ids[known])
        return out

    def row(self) -> list:
        sizes, bits = self.perfect.pack()
        return [sizes, bits, self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()]

    @classmethod
    def from_row(cls, sizes, bits, prints, counts, keepers) -> LineIndex:
        return cls(PerfectHash.unpack(sizes, bits), np.frombuffer(prints, np.int64), np.frombuffer(counts, np.uint8), np.frombuffer(keepers, np.int64))


_ARRAYS = "levels array<int>, bits binary, prints binary, counts binary, keepers binary"


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.ascontiguousarray(t.column(n).to_numpy()) for n in names]


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """shard and its arrays, from rows of (h1, h2, n, keeper)."""
    def build(group: pa.Table) -> pa.Table:
        index = LineIndex.build(*_columns(group, "h1", "h2", "n", "keeper"))
        row = [group.column("shard")[0].as_py(), *index.row()]
        kinds = [pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4]
        names = ["shard", "levels", "bits", "prints", "counts", "keepers"]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds)})

    return counts.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, f"shard int, {_ARRAYS}")


def lines_to_drop(hashes: DataFrame) -> DataFrame:
    """doc_id, drop (16 bytes): the line hashes each document has to drop. ``hashes`` is a written table."""
    spark = hashes.sparkSession
    ids = F.coalesce("doc_id", F.lit(NO_ID))
    counts = materialise(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(ids).alias("keeper")))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot_from = max(MIN_DOCS, -(-total // (4 * partitions)))
    common = counts.filter(F.col("n") >= hot_from).toArrow()  # 4 * partitions rows at most
    hot = LineIndex.build(*_columns(common, "h1", "h2", "n", "keeper"))
    hot_row = hot.row()

    def probe(index: LineIndex, t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return index.dropped(*_columns(t, "doc", "h1", "h2"))

    def drops(t, flags: np.ndarray) -> dict:
        both = np.column_stack([t.column("h1").to_numpy()[flags], t.column("h2").to_numpy()[flags]])
        return {"doc": t.column("doc").filter(pa.array(flags)), "drop": pa.array([r.tobytes() for r in both], pa.binary())}

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.from_row(*hot_row)
        for b in batches:
            t = pa.Table.from_batches([b])
            yield from pa.table(drops(t, probe(index, t))).to_batches()

    rows = hashes.select(ids.alias("doc"), "h1", "h2")
    first = rows.mapInArrow(in_place, "doc long, drop binary")
    # Lines of fewer documents than MIN_DOCS are in the arrays; lines above hot_from have been answered.
    rest = counts.filter(F.col("n") < hot_from)
    shards = max(1, -(-distinct // SHARD_KEYS), -(-total // (4 * SHARD_KEYS)))
    arrays = build_shards(rest, shards)

    def at_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "drop": pa.array([], pa.binary())})
        index = LineIndex.from_row(*[right.column(n)[0].as_py() for n in ("levels", "bits", "prints", "counts", "keepers")])
        return pa.table(drops(left, probe(index, left)))

    def not_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.from_row(*hot_row)
        for b in batches:
            t = pa.Table.from_batches([b])
            _, known = index.known(*_columns(t, "h1", "h2"))
            yield from t.filter(pa.array(~known)).to_batches()

    others = rows.mapInArrow(not_hot, "doc long, h1 long, h2 long").withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    second = others.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(at_shard, "doc long, drop binary")
    return first.unionAll(second).withColumn("doc_id", F.nullif(F.col("doc"), F.lit(NO_ID))).drop("doc")


def without_lines(text: str | None, drop: set[bytes]) -> tuple[str, int, int]:
    """The text without the lines of the given hashes, its number of lines, and the number dropped."""
    lines = (text or "").encode().split(b"\n")
    if not drop:
        return text or "", len(lines), 0
    kept = []
    for line in lines:
        key = line_key(line)
        if key is None or xxhash.xxh3_128_digest(key) not in drop:
            kept.append(line)
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Adds kept_text, n_lines and n_dropped; columns of those names are replaced."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    hashes = materialise(line_hashes(docs))
    drops = lines_to_drop(hashes).groupBy(F.col("doc_id").alias("_d_id")).agg(F.collect_set("drop").alias("_d_drop"))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_d_id")), "left").drop("_d_id")
    schema = T.StructType([*docs.schema.fields, *T.StructType().add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [without_lines(t, set(d or ())) for t, d in zip(b.column("text").to_pylist(), b.column("_d_drop").to_pylist())]
            t = pa.Table.from_batches([b]).drop_columns(["_d_drop"])
            for k, (name, kind) in enumerate((("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()))):
                t = t.append_column(name, pa.array([d[k] for d in done], kind))
            yield from t.to_batches()

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}),
m AS (SELECT rid, k.doc_id, i, line, c.key IS NOT NULL AND c.keeper IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id"""
