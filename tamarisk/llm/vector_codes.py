"""Product-quantised vector codes, exact in whole numbers.

A component x becomes floor(256 * x), and a vector is cut into equal parts. Each part place has a codebook
that starts as that part of the first vectors by id; a round sends every part to its nearest entry and moves
each entry to the floored mean of its parts.

Nearest entries are found on Walsh-Hadamard coefficients. Part and entry are padded with zeros to a power of
two, D, and transformed by the +1/-1 matrix whose rows are in order of their sign changes. The squared
differences of all D coefficients add up to D times the squared distance, so a sum over the first few of them is a
lower bound in the same scale. The entry that is nearest by the first coefficient gives the bound to beat;
the others go as soon as their sum is above it, and an entry as far as the best one stays, so that ties end at the
lower index. Everything is 64-bit whole numbers; vectors whose numbers could leave them are refused.

A pass over the vectors is one stage without a shuffle of vectors: a task returns a count and sums for each
(part, entry) it used, so codebooks of parts * entries rows are all that reaches the driver, whatever the
input's size or the share of one vector.

Defined cases: a null vector, or one with null or non-finite components, is left out; ids may be null (last) or
repeat (ordered by vector); vectors of different lengths are padded with zeros to the longest, and that to a
multiple of the parts; fewer vectors than entries make a smaller codebook; an empty table gives no rows.
Extra columns stay in ``encode`` if asked for, and are left out of the query.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tamarisk.llm.base import join_names, table
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
CHUNK = 2048  # vectors compared with a codebook at once
NUMBERS = "_v_numbers"


def sequency_matrix(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def coefficients(rows: np.ndarray) -> np.ndarray:
    width = rows.shape[1]
    size = 1 << max(width - 1, 0).bit_length()
    return np.pad(rows, ((0, 0), (0, size - width))) @ sequency_matrix(size).T


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest entry, ties to the lower one, and its squared distance."""
    x, e = coefficients(rows), coefficients(entries)
    first = (x[:, :1] - e[None, :, 0]) ** 2
    likely = e[first.argmin(axis=1)]
    bound = ((x - likely) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    met = first[row, entry]
    for k in range(1, x.shape[1]):
        met = met + (x[row, k] - e[entry, k]) ** 2
        stays = met <= bound[row]
        row, entry, met = row[stays], entry[stays], met[stays]
    starts = np.searchsorted(row, np.arange(len(x)))  # every row keeps the entry of its bound
    least = np.minimum.reduceat(met, starts)
    ties = np.where(met == least[row], entry, len(e))
    return np.minimum.reduceat(ties, starts), least // x.shape[1]


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part, and the squared distance added up over the parts."""
    parts, _, width = books.shape
    codes, error = np.empty((len(vectors), parts), np.int32), np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), CHUNK):
        cut = vectors[at:at + CHUNK].reshape(-1, parts, width)
        for p in range(parts):
            codes[at:at + CHUNK, p], distance = nearest(cut[:, p], books[p])
            error[at:at + CHUNK] += distance
    return codes, error


def whole_numbers(rows: DataFrame, vector: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows whose vectors are kept, with whole-number components as the last column, and their width."""
    usable = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # NaN is above infinity
    kept = rows.filter(F.col(vector).isNotNull() & F.forall(vector, usable))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    seen = kept.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"),
                    F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("largest")).first()
    width = -(-(seen["most"] or 0) // parts) * parts
    part = max(width // parts, 1)
    if (2 * SCALE * ((seen["largest"] or 0) + 1) * (1 << (part - 1).bit_length())) ** 2 >= 1 << 62:
        raise ValueError("components are too large for exact 64-bit distances")
    if seen["least"] is not None and seen["least"] < width:
        numbers = F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))
    return kept.withColumn(NUMBERS, numbers), width


def first_books(kept: DataFrame, width: int, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, part width): the vectors of the smallest ids."""
    first = kept.orderBy(F.asc_nulls_last(key), NUMBERS).select(NUMBERS).limit(entries).collect()
    vectors = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width // parts)
    return np.ascontiguousarray(vectors.transpose(1, 0, 2))


def _numbers_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def moved_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            vectors = _numbers_of(b.column(0), parts * width)
            codes, _ = assigned(vectors, books)
            for p in range(parts):
                np.add.at(n[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], vectors[:, p * width:(p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
                                          pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    used = kept.select(NUMBERS).mapInArrow(sums, "part int, entry int, n long, total array<long>")
    merged = used.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    moved = books.copy()
    for r in merged.collect():  # parts * entries rows at most
        moved[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return moved


def train(kept: DataFrame, width: int, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(kept, width, key, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved_books(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, codes (an entry for each part) and error."""
    schema = StructType([*kept.select(*keep).schema, StructField("codes", ArrayType(IntegerType())), StructField("error", LongType())])
    out = to_arrow_schema(schema)
    width = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = assigned(_numbers_of(b.column(b.num_columns - 1), width), books)
            ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            listed = pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], listed, pa.array(error)], schema=out)

    return kept.select(*keep, NUMBERS).mapInArrow(run, schema)


def books_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, width = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    books = train(kept, width)
    if not books.size:  # no vectors, or none with a component: nothing to tell apart
        books = np.zeros((PARTS, 1, 0), np.int64)
    coded = materialise(encode(kept, books, ["vec_id", "label"]).select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error",
        F.struct("label").alias("by_label")))
    labels = materialise(coded.groupBy("by_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies")))
    return join_names(coded, labels, ["by_label"], coded.count()).select(
        "vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(ceil(max(len(v)) / {PARTS}) AS BIGINT) AS w FROM k),
x AS (SELECT rid, p, list_transform(range(p * w + 1, p * w + w + 1), lambda i: coalesce(v[i], 0)) AS x FROM k, w, range({PARTS}) AS t(p)),
o AS (SELECT rid, e FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(range(1, {PARTS} * w + 1), lambda i: coalesce(v[i], 0))) - 1 AS e FROM k, w) WHERE e < {ENTRIES}),
b0 AS (SELECT p, e, x AS c FROM x JOIN o USING (rid)),
""" + "".join(f"""
a{r} AS MATERIALIZED (SELECT rid, x.p, min({{'d': CAST(list_sum(list_transform(range(1, len(c) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), 'e': e}}) AS near
   FROM x JOIN b{r} ON x.p = b{r}.p GROUP BY rid, x.p),
""" + (f"""s{r} AS (SELECT x.p, near.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} ON x.rid = a{r}.rid AND x.p = a{r}.p, w, range(1, w + 1) AS t(i) GROUP BY ALL),
m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} AS b LEFT JOIN m{r} AS m ON m.p = b.p AND m.e = b.e),
""" if r < ROUNDS else "") for r in range(ROUNDS + 1)) + f"""
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}),
f AS (SELECT rid, string_agg(lpad(lower(hex(near.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN f USING (rid), h
"""
