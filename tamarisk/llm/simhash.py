"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Equal
fingerprints collapse first. Two fingerprints that differ in at most k bits agree in one of k + 1
parts of their bits, so each is sent to k + 1 groups named by (mask, bits under the mask). A group
that is still too large is split again by parts of the bits its mask leaves free: all differences lie
there, so nothing is lost, and the free bits run out before a group can stay large.

Inside a group the fingerprints are sorted by Gray rank, which puts those that share bits side by
side. Runs of them become nodes; the bits that all children share are kept once, in the upper node,
and a child keeps only what is new. A query goes down from the root, adds up the differences that it
has met, and drops a whole subtree as soon as they exceed k. Groups return stars, not pairs; the stars
become components by rounds of contraction on tables.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any
other; a text of fewer words than a shingle has one shingle, itself. Repeated rows link like copies. A
null id is never the smallest id of a component that has another. Extra columns are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.base import join_names, over_rows, table, with_row_numbers
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
GROUP_ROWS = 20_000    # a larger group is split, never cut
FANOUT = 16
SMALL_GROUP = 32       # compared by neighbour distance
QUERY_ROWS = 64        # queries that go down the index together; in a dense group their frontier is as many times the group
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[min(shingle_words, len(ends)) - 1:]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, HASH_CHUNK):
        hashes = [digest(joined[a:b - 1], HASH_SEED) for a, b in zip(starts[at:at + HASH_CHUNK], last[at:at + HASH_CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id, fp for every row."""
    return over_rows(docs.select(F.col(key).cast("long"), "text"),
                     lambda ids, texts: [ids, [fingerprint(t, shingle_words) for t in texts]], "id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order; each node holds the bits shared below it that its parent lacks."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: mask, pattern
        masks, patterns = np.full(len(fps), ~np.uint64(0)), self.fps
        while True:
            cuts = np.arange(0, len(masks), FANOUT)
            all_set, any_set = np.bitwise_and.reduceat(patterns, cuts), np.bitwise_or.reduceat(patterns, cuts)
            shared = np.bitwise_and.reduceat(masks, cuts) & ~(all_set ^ any_set)
            masks, patterns = shared, all_set & shared
            self.levels.append((masks, patterns))
            if len(masks) == 1:
                break

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places, the first below the second, of fingerprints that differ in at most max_bits."""
        for at in range(0, len(self.fps), QUERY_ROWS):
            queries = self.fps[at:at + QUERY_ROWS]
            who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
            mask, pattern = self.levels[-1]
            met = np.bitwise_count((queries ^ pattern[0]) & mask[0]).astype(np.int64)
            above = mask
            for masks, patterns in [*self.levels[-2::-1], (np.full(len(self.fps), ~np.uint64(0)), self.fps)]:
                near = met <= max_bits
                who, node, met = who[near], node[near], met[near]
                parent = np.repeat(node, FANOUT)
                child = parent * FANOUT + np.tile(np.arange(FANOUT), len(node))
                real = child < len(masks)
                who, met, parent, child = np.repeat(who, FANOUT)[real], np.repeat(met, FANOUT)[real], parent[real], child[real]
                new_bits = masks[child] & ~above[parent]
                met = met + np.bitwise_count((queries[who] ^ patterns[child]) & new_bits)
                node, above = child, masks
            close = (met <= max_bits) & (node > who + at)
            yield who[close] + at, node[close]


def smallest_reachable(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels lowered along the links until none changes."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        if np.array_equal(before, labels):
            return labels


class Roots:
    """Components of places under links that come in runs; a run is forgotten once its components are joined."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        new = a != b
        if new.any():
            ends = np.unique(np.column_stack([a[new], b[new]]), axis=0)
            joined = np.unique(ends)
            to = smallest_reachable(joined.copy(), np.searchsorted(joined, ends[:, 0]), np.searchsorted(joined, ends[:, 1]))
            moved = np.arange(len(self.root))
            moved[joined] = to
            self.root = moved[self.root]


def small_group_links(group: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal group number, by distance between neighbours."""
    left, right = [], []
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero(group[:-d] == group[d:]) if len(group) > d else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
        left.append(i), right.append(i + d)
    none = np.empty(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def group_stars(mask: np.ndarray, value: np.ndarray, fps: np.ndarray, checks: np.ndarray, nodes: np.ndarray,
                max_bits: int, max_check_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller linked node) for rows sorted by group, whole groups only."""
    starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
    sizes = np.diff(np.r_[starts, len(fps)])
    group = np.repeat(np.arange(len(starts)), sizes)
    bits, checks = fps.view(np.uint64), checks.view(np.uint64)

    def checked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.bitwise_count(checks[i] ^ checks[j]) <= max_check_bits
        return i[good], j[good]

    small = sizes[group] <= SMALL_GROUP
    roots = Roots(len(fps))
    roots.join(*checked(*small_group_links(np.where(small, group, -1 - np.arange(len(group))), bits, max_bits)))
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        index = GrayIndex(bits[starts[g]:starts[g] + sizes[g]])
        places, own = starts[g] + index.order, Roots(sizes[g])
        for i, j in index.links(max_bits):
            good = np.bitwise_count(checks[places[i]] ^ checks[places[j]]) <= max_check_bits
            own.join(i[good], j[good])
        roots.join(places, places[own.root])
    least = nodes.copy()
    np.minimum.at(least, roots.root, nodes)
    labels = least[roots.root]
    linked = labels != nodes
    return nodes[linked], labels[linked]


def _parts(free: int, count: int) -> list[int]:
    """The set bits of a mask, dealt to ``count`` masks in runs."""
    places = [b for b in range(64) if free >> b & 1]
    cuts = [len(places) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in places[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS, max_check_bits: int = 64) -> DataFrame:
    """a, b: stars whose components are those of all links between the rows (node, fp, check).

    A link has at most max_bits between the fingerprints ``fp`` and max_check_bits between ``check``, a
    second fingerprint that is not routed by.
    """
    everything = (1 << 64) - 1
    masks, routed, stars = {0}, distinct.select(F.lit(0).cast("long").alias("mask"), "fp", "check", "node"), []
    while True:
        finer = {m: [m | p for p in _parts(everything & ~m, max_bits + 1)] for m in masks}
        options = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        masks = {s for subs in finer.values() for s in subs}
        routed = routed.select("fp", "check", "node", F.explode(options[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if len(finer) > 1:
            routed = routed.distinct()  # the same bits can be fixed in either order
        routed = materialise(routed)
        sizes = routed.groupBy("mask", "value").agg(F.count("*").alias("rows")).filter("rows > 1")
        sized = materialise(routed.join(sizes, ["mask", "value"]))
        fits = F.col("rows") <= group_rows
        # a group whose free bits cannot be dealt out again is bounded by them
        smallest = min(64 - m.bit_count() for m in masks)
        stars.append(_searched(sized.filter(fits) if smallest > max_bits else sized, max_bits, max_check_bits))
        routed = sized.filter(~fits).select("mask", "fp", "check", "node")
        if smallest <= max_bits or routed.isEmpty():
            break
    out = stars[0]
    for s in stars[1:]:
        out = out.unionAll(s)
    return out


def _searched(groups: DataFrame, max_bits: int, max_check_bits: int) -> DataFrame:
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            if rest is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(rest, rows)]
            mask, value = rows[:2]
            last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            rest = [x[cut:] for x in rows]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in group_stars(*[x[:cut].copy() for x in rows], max_bits, max_check_bits)], schema=out)
        if rest is not None and len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in group_stars(*[x.copy() for x in rest], max_bits, max_check_bits)], schema=out)

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("mask", "value", "fp", "check", "node").repartition(parts, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the same for all nodes of a component) for every node of the edges (a, b).

    A round points every node at its smallest neighbour, follows the pointers once more, and rewrites
    the edges between the nodes pointed at; edges shrink from round to round.
    """
    edges = materialise(edges.filter("a <> b").distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        jump = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        to = materialise(to.join(jump, "to").select("node", F.col("further").alias("to")))
        rounds.append(to)
        left, right = (to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = materialise(moved.filter("a <> b").distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].withColumnRenamed("to", "root")
    for to in rounds[1:]:
        step = to.select(F.col("node").alias("root"), F.col("to").alias("_next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """id, fp, component_id (the smallest id that links reach) for every row."""
    rows = materialise(fingerprints(docs, key, shingle_words))
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    roots = materialise(components(links(distinct.select("fp", F.lit(0).cast("long").alias("check"), F.col("fp").alias("node")), max_bits)))
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    known = linked.join(smallest, "root").select("fp", "least")
    names = materialise(distinct.join(known, "fp", "left").select("fp", "copies", F.coalesce("least", "first").alias("component_id")))
    return join_names(rows, names, ["fp"], rows.count()).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, scanned: bool = False) -> DataFrame:
    """The first document of every component; the columns stay. ``scanned`` as in with_row_numbers."""
    numbered = with_row_numbers(docs, "_n_row", scanned)
    found = near_duplicates(numbered, "_n_row", shingle_words, max_bits)
    gone = materialise(found.filter("id <> component_id").select(F.col("id").alias("_n_row")))
    return numbered.join(gone, "_n_row", "left_anti").drop("_n_row")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
