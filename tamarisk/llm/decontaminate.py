"""Benchmark decontamination: documents that hold a benchmark item up to a share of edits.

Texts become sequences of words (A-Z in lower case, ASCII punctuation removed). The CGK embedding
walks over a sequence with random bits that depend on step and word: at each step it writes the word it
stands on and moves on by one or stays. Two sequences a few edits apart fall into step again, so their
embeddings differ in few places: edit distance has become Hamming distance. Bit-sampling LSH compares a
few sampled places of the embeddings. All windows of a text walk at once, and only windows whose
samples so far agree with some item's walk on, so most of them stop at their first word.

Items of fewer than ``WALK_WORDS`` words leave the repetitions too few different words to read. They are
cut into one piece more than they may have edits, so one piece at least stands unchanged in any leak, and
every window that begins with a piece is a candidate: no leak of theirs is missed.

One repetition misses an item when an edit falls on the words it reads. Repetitions have random bits
and samples of their own and start further and further into the item, and their number follows from
the target recall. Every candidate is verified by the exact edit distance, in words, between the item and
the best stretch around the window, so nothing that is too far away is reported.

The items travel to the tasks in parts of a checked size; each part is one pass over the documents.
Documents are never shuffled.

Defined cases: null or empty texts hold nothing; items without words are not looked for;
shorter ones than five words are found without edits; repeated items each report; repeated rows each report. A null document
or item id stays null. Extra columns stay in ``without_leaks``.
"""

from __future__ import annotations

import math
import string
import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.base import table, worker_object

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_EDIT_SHARE = 0.2      # of the item's words
TARGET_RECALL = 0.99
SAMPLES = 4               # sampled places of an embedding: the first step, and one of each run of GAP steps after it
GAP = 3                   # a walk that stays half of the time has seldom stood still for so long
STEPS = 2 + (SAMPLES - 1) * GAP  # steps of a walk, about half as many words
MIN_WORDS = 12           # the last start of a walk is so many words before an item's end, no fewer than STEPS
WALK_WORDS = 30          # shorter items are found by unchanged pieces, without loss
PART_BYTES = 32 << 20     # item text in one pass
CHUNK_WORDS = 1 << 18
PUNCTUATION = string.punctuation.encode()
SEED = 20


def repetitions(edit_share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL) -> int:
    """A repetition is clean when none of the words it reads is edited."""
    clean = (1 - edit_share) ** (STEPS / 2 + 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - clean))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(None, PUNCTUATION).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class Repetition:
    """One embedding: an odd multiplier for each step gives the random bits; ``steps`` are the sampled places."""

    def __init__(self, number: int):
        rng = np.random.default_rng([SEED, number])
        self.multipliers = rng.integers(0, 1 << 31, STEPS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.steps = [0, *(2 + GAP * np.arange(SAMPLES - 1) + rng.integers(0, GAP, SAMPLES - 1)).tolist()]

    def moves(self, step: int, words: np.ndarray) -> np.ndarray:
        return (words * self.multipliers[step]) >> np.uint32(31)


class Pieces:
    """A walk that reads every word of a piece of ``size`` words."""

    def __init__(self, size: int):
        self.steps = list(range(size))

    def moves(self, step: int, words: np.ndarray) -> np.ndarray:
        return np.ones(len(words), np.uint32)


def _combined(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = (keys ^ words.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class ItemIndex:
    """The items' sampled embeddings for each repetition, as sorted keys of each number of samples."""

    def __init__(self, ids: list, texts: list, edit_share: float, recall: float):
        found = [(i, w) for i, w in ((i, plain_words(t)) for i, t in zip(ids, texts)) if w]
        self.ids, self.words = [i for i, _ in found], [w for _, w in found]
        self.hashes = [word_hashes(w) for w in self.words]
        self.allowed = [int(len(w) * edit_share) for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array(self.allowed, np.int64)
        self.bag = np.unique(np.concatenate([h.astype(np.uint64) | np.uint64(k << 32) for k, h in enumerate(self.hashes)])) if found else np.empty(0, np.uint64)
        long = [i for i, n in enumerate(self.sizes) if n >= WALK_WORDS]
        of = repetitions(edit_share, recall)
        self.tables = [self._table(Repetition(r), [(i, (len(self.hashes[i]) - MIN_WORDS) * r // max(1, of - 1)) for i in long]) for r in range(of)] if long else []
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            if n < WALK_WORDS:
                size = n // (self.allowed[i] + 1)
                pieces.setdefault(size, []).extend((i, size * k) for k in range(self.allowed[i] + 1))
        self.tables += [self._table(Pieces(size), starts) for size, starts in sorted(pieces.items())]

    def _table(self, rep: Repetition | Pieces, starts: list[tuple[int, int]]) -> tuple:
        keys, items, offsets = [[] for _ in rep.steps], [], []
        for item, start in starts:
            hashes = self.hashes[item]
            at, key, path = start, np.zeros(1, np.uint64), []
            for step in range(rep.steps[-1] + 1):
                word = hashes[at:at + 1]
                if step in rep.steps:
                    key = _combined(key, word)
                    path.append(key[0])
                at += int(rep.moves(step, word)[0])
            for k, p in zip(keys, path):
                k.append(p)
            items.append(item), offsets.append(start)
        order = np.argsort(np.array(keys[-1], np.uint64), kind="stable")
        first = np.zeros(1 << 16, bool)
        first[[int(self.hashes[i][o]) & 0xFFFF for i, o in zip(items, offsets)]] = True
        prefixes = [np.unique(np.array(k, np.uint64)) for k in keys[:-1]]
        return rep, first, prefixes, np.array(keys[-1], np.uint64)[order], np.array(items)[order], np.array(offsets)[order]

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct rows (window start, item); a window may start before the first word or end behind the last one."""
        padded = np.concatenate([words, np.zeros(STEPS, np.uint32)])
        low = words & np.uint32(0xFFFF)
        out = []
        for rep, first, prefixes, keys, items, offsets in self.tables:
            start = np.flatnonzero(first[low])
            at, key, sample = start, np.zeros(len(start), np.uint64), 0
            for step in range(rep.steps[-1] + 1):
                word = padded[at]
                if step == rep.steps[sample]:
                    key = _combined(key, word)
                    if sample < len(prefixes):
                        go = _contains(prefixes[sample], key)
                        start, at, key, word = start[go], at[go], key[go], word[go]
                    sample += 1
                if not len(at):
                    break
                at = at + rep.moves(step, word)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.column_stack([np.repeat(start, n) - offsets[entry], items[entry]]))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def _contains(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def best_edits(item: list[bytes], region: list[bytes]) -> tuple[int, int]:
    """The fewest word edits between the item and any stretch of the region, and the end of the first such stretch."""
    codes: dict[bytes, int] = {}
    b = np.array([codes.setdefault(w, len(codes)) for w in region], np.int64)
    ramp = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for k, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (b != codes.get(w, -1)), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


def plausible(index: ItemIndex, whole: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Regions [lo, hi) with enough words of their item: an item word that the region lacks costs an edit."""
    out = np.zeros(len(lo), bool)
    for at in range(0, len(lo), 1 << 14):
        part = slice(at, at + (1 << 14))
        n = np.maximum(hi[part] - lo[part], 0)
        first = np.cumsum(n) - n
        word = whole[np.repeat(lo[part] - first, n) + np.arange(n.sum())].astype(np.uint64)
        known = _contains(index.bag, word | np.repeat(item[part].astype(np.uint64) << np.uint64(32), n))
        shared = np.concatenate([[0], np.cumsum(known)])
        out[part] = shared[first + n] - shared[first] >= (index.sizes - index.slack)[item[part]]
    return out


def leaks_in(index: ItemIndex, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, edits, first word, end word) for a run of documents, the best window of each pair."""
    hashes = [word_hashes(d) for d in docs]
    sizes = np.array([len(h) for h in hashes], np.int64)
    bases = np.cumsum(sizes) - sizes
    whole = np.concatenate(hashes) if hashes else np.empty(0, np.uint32)
    start, item = index.candidates(whole).T
    if not len(start):
        return
    # the document that holds the middle of the window; the region is cut to it
    n, slack = index.sizes[item], index.slack[item]
    doc = np.searchsorted(bases, np.clip(start + n // 2, 0, len(whole) - 1), "right") - 1
    lo, hi = np.maximum(start - slack, bases[doc]), np.minimum(start + n + slack, bases[doc] + sizes[doc])
    good = plausible(index, whole, lo, hi, item)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s, i, d, a, z in zip(*[x[good].tolist() for x in (start, item, doc, lo, hi)]):
        if best.get((d, i), (1,))[0] == 0:
            continue
        base = int(bases[d])
        edits, end = best_edits(index.words[i], docs[d][a - base:z - base])
        if edits <= index.allowed[i]:
            found = (edits, max(s - base, 0), a - base + end)
            best[d, i] = min(best.get((d, i), found), found)
    for (d, i), (edits, first, end) in sorted(best.items()):
        yield d, i, edits, first, end


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("edits", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[tuple[list, list]]:
    """The items (ids, texts) in parts of about part_bytes, dealt by a hash of the whole row."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    for p in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toArrow().to_pylist()
        ordered = sorted(part, key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
        yield [r["item_id"] for r in ordered], [r["text"] for r in ordered]


def _found(index: ItemIndex, texts: Iterator) -> Iterator[tuple]:
    """(place of the text, item, edits, first word, end word), a bounded number of words at once."""
    held, size = [], 0
    for k, text in enumerate(texts):
        words = plain_words(text)
        held.append((k, words))
        size += len(words)
        if size >= CHUNK_WORDS:
            yield from ((held[d][0], *rest) for d, *rest in leaks_in(index, [w for _, w in held]))
            held, size = [], 0
    yield from ((held[d][0], *rest) for d, *rest in leaks_in(index, [w for _, w in held]))


def _index_of(docs: DataFrame, ids: list, texts: list, edit_share: float, recall: float):
    """A function that gives a task its worker's index of the items."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
    name = ("items", uuid.uuid4().hex)
    return lambda: worker_object(name, lambda: ItemIndex(*shared.value, edit_share, recall))


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document and item that it holds, with the fewest edits and where."""
    def one_pass(make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = make()
            for b in batches:
                doc_ids = b.column(0).to_pylist()
                rows = [(doc_ids[k], index.ids[item], len(index.words[item]), *rest) for k, item, *rest in _found(index, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, item_words int, edits int, first_word long, end_word long")

    passes = [one_pass(_index_of(docs, *part, edit_share, recall)) for part in _parts(benchmark, part_bytes)]
    return reduce(DataFrame.unionAll, passes)


def without_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that hold no item, filtered where they are read; the columns stay."""
    def one_pass(left: DataFrame, make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = make()
            for b in batches:
                held = {k for k, *_ in _found(index, b.column("text").to_pylist())}
                yield b.filter(pa.array([k not in held for k in range(b.num_rows)], pa.bool_()))

        return left.mapInArrow(run, left.schema)

    for part in _parts(benchmark, part_bytes):
        docs = one_pass(docs, _index_of(docs, *part, edit_share, recall))
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
