"""Token ids as binary files: one zstandard frame for each document, with a shared dictionary.

A document's text becomes the ids of a public vocabulary and one end id. Frames are compressed one by
one with a dictionary that was trained on serialised id arrays, so a short document can be read
without its neighbours. Documents are in ascending id order, or in that of a column given: ranges are shards, a shard is cut
into blocks, and a block is one Parquet row: the frames joined (payload), where each starts (offsets),
the document ids and lengths, the ids before it in its shard, and the dictionary's hash. Reading only
the index touches no payload; reading one document touches the blocks whose id range holds it.

A text is cut at spaces and line feeds, which the vocabulary's own rules drop before they split
anything, and each piece is encoded once per worker; the memo is bounded and never changes an id.

The dictionary is trained on a sample of at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters, chosen by a hash of the id over all rows. It bears on size alone.

Defined cases: a null or empty text is its end id alone; a null id comes first; repeated ids lie side
by side, ordered by length and a hash of the frame, so that any number of them is spread over shards; with too few rows for a trained dictionary the sample itself is
the dictionary, with none there is no dictionary. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tamarisk.llm.base import over_rows, release, table, worker_object
from tamarisk.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 2
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
BLOCK_BYTES = 1 << 20
MEMO_PIECES = 400_000
MEMO_PARTS = 200_000


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# A word of Latin letters with ASCII marks behind it: its rules are known, so the vocabulary's merges can be asked directly.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Each character from 128 to 255 as the letters that stand for its UTF-8 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class Encoder:
    """Ids of whole texts as little-endian bytes, piece by piece with bounded memos.

    ``latin_words``: the vocabulary lower-cases, parts letters from marks and merges bytes, so that a
    word of Latin letters can go to its merges without the general rules; off for other vocabularies.
    """

    def __init__(self, vocabulary: str, latin_words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.pieces: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()
        self.merges = self.tokenizer.model
        self.latin_words = latin_words
        self.end = array(self.kind, [END_ID]).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a run of lower-case Latin letters, or of ASCII marks."""
        ids = self.parts.get(part)
        if ids is None:
            ids = array(self.kind, [t.id for t in self.merges.tokenize(part.translate(self.letters))]).tobytes()
            if len(self.parts) < MEMO_PARTS:
                self.parts[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        plain = PLAIN.fullmatch(piece) if self.latin_words else None
        if plain:
            return self._part(plain[1].lower()) + self._part(plain[2])
        return array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(self.pieces.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = ids = self._piece(pieces[k])
                    if len(self.pieces) < MEMO_PIECES:
                        self.pieces[pieces[k]] = ids
        found.append(self.end)
        return b"".join(found)


def encoder(vocabulary: str) -> Encoder:
    return worker_object(("encoder", vocabulary), lambda: Encoder(vocabulary))


class Frames:
    """Compression of single documents with the shared dictionary."""

    def __init__(self, dictionary: bytes):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.hash = hashlib.sha256(dictionary).hexdigest()
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, frame: bytes, width: int) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(frame), f"<u{width}").astype("<u4")


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """A dictionary from the id arrays of a bounded sample of documents."""
    n = docs.count()
    range_ = 1 << 40
    share = range_ if n <= SAMPLE_DOCS else range_ * SAMPLE_DOCS // n
    chosen = docs.filter((F.char_length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id"), F.lit(range_)) < share))
    rows = over_rows(chosen.select("text").limit(2 * SAMPLE_DOCS), lambda texts: [[encoder(vocabulary).encode(t) for t in texts]], "ids binary", keeps="encoder")
    samples = sorted(bytes(r.ids) for r in rows.toLocalIterator())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write(docs: DataFrame, path: str, vocabulary: str, order: str = "doc_id") -> None:
    """Writes ``path/blocks`` and ``path/dictionary``; the texts are encoded once, into ``path/frames``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col(order).cast("long").alias("place"), "text")
    dictionary = train_dictionary(docs, vocabulary)
    dict_hash = Frames(dictionary).hash
    spark.createDataFrame([(dict_hash, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def batch(ids, places, texts):
        enc = encoder(vocabulary)
        frames = Frames(dictionary)
        raw_sizes, packed = [], []
        for text in texts:
            raw = enc.encode(text or "")
            raw_sizes.append(len(raw) // enc.width)
            packed.append(frames.packer.compress(raw))
        return ids, places, raw_sizes, [enc.width] * len(ids), packed

    over_rows(docs, batch, "doc_id long, place long, n_tokens long, id_bytes int, frame binary", keeps="encoder").write.parquet(f"{path}/frames")
    frames = spark.read.parquet(f"{path}/frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col("place"), F.col("n_tokens"), F.xxhash64("frame")]
    ranged = frames.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered, "frame").drop("place").withColumn("shard", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # all texts are encoded
        block, start, ids, lengths, offsets, payload = 0, 0, [], [], [0], []

        def row(shard: int, width: int) -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            values = [shard, block, min(known, default=None), max(known, default=None), start, ids, lengths, offsets, width, dict_hash, b"".join(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out)], schema=out)

        for b in batches:
            for doc, n, width, frame, shard in zip(*[c.to_pylist() for c in b.columns]):
                ids.append(doc), lengths.append(n), payload.append(frame), offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= BLOCK_BYTES:
                    yield row(shard, width)
                    block, start, ids, lengths, offsets, payload = block + 1, start + sum(lengths), [], [], [0], []
        if ids:
            yield row(shard, width)

    schema = ("shard int, block int, first_doc long, last_doc long, start long, doc_ids array<long>, n_tokens array<long>, "
              "offsets array<long>, id_bytes int, dict_hash string, payload binary")
    out = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("id_bytes", pa.int32()),
        ("dict_hash", pa.string()), ("payload", pa.binary())])
    ranged.mapInArrow(pack, schema).write.parquet(f"{path}/blocks")


def _documents(blocks: DataFrame, spark: SparkSession, path: str, with_ids: bool, only: frozenset | None) -> DataFrame:
    dict_hash, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    if Frames(bytes(dictionary)).hash != dict_hash:
        raise ValueError(f"the dictionary in {path} is not the one that was written")
    dictionary = bytes(dictionary)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frames = Frames(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != frames.hash:
                    raise ValueError(f"block {r['shard']}/{r['block']} was written with dictionary {r['dict_hash']}")
                start, rows = r["base"] + r["start"], []
                for k, (doc, n) in enumerate(zip(r["doc_ids"], r["n_tokens"])):
                    if only is None or doc in only:
                        ids = frames.ids(r["payload"][r["offsets"][k]:r["offsets"][k + 1]], r["id_bytes"])
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                    start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def _placed(blocks: DataFrame) -> DataFrame:
    """Adds ``base``, the ids of all earlier shards; one row for each shard is ordered."""
    per = blocks.groupBy(F.col("shard").alias("_shard")).agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("_n"))
    earlier = W.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    bases = per.select("_shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("base"))
    return blocks.join(bases, F.col("shard") == F.col("_shard")).drop("_shard")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document."""
    return _documents(_placed(spark.read.parquet(f"{path}/blocks")), spark, path, with_ids, None)


def read_some(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same for a few documents: only blocks whose range holds one of the ids are read, and only their frames unpacked."""
    blocks = _placed(spark.read.parquet(f"{path}/blocks"))
    hit = F.lit(False)
    for d in doc_ids:
        hit = hit | F.coalesce(F.lit(d).between(F.col("first_doc"), F.col("last_doc")), F.lit(False))  # a block of null ids has no range
    return _documents(blocks.filter(hit), spark, path, True, frozenset(doc_ids))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_vocabulary())
    return read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
