"""Vector codes, Merkle manifest and WARC captures against plain readings."""

import base64
import gzip
import hashlib
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F
from tamarisk.llm import catalog, merkle, vector_codes, warc


# ---- vector codes ----

@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 7, 8, 12])
def test_nearest_is_exact_with_ties_to_the_lower_entry(width):
    rng = np.random.default_rng(width)
    for reach in (2, 300, 1 << 20):
        rows, entries = rng.integers(-reach, reach, (400, width)), rng.integers(-reach, reach, (30, width))
        entries[20:25] = entries[3:8]
        distances = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        found, least = vector_codes.nearest(rows, entries)
        assert np.array_equal(found, distances.argmin(axis=1)) and np.array_equal(least, distances.min(axis=1))


def test_sequency_matrix():
    for size in (1, 2, 4, 8, 16):
        h = vector_codes.sequency_matrix(size)
        assert np.array_equal(h @ h.T, size * np.eye(size, dtype=int)) and [(r[1:] != r[:-1]).sum() for r in h] == list(range(size))


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * w - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w:p * w + w] for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(v[p * w:p * w + w], books[p])[1], []).append(v[p * w:p * w + w])
            for e, m in members.items():
                books[p][e] = [sum(c) // len(m) for c in zip(*m)]
    out = []
    for i, v, lab in kept:
        best = [near(v[p * w:p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
    by_label = Counter()
    for r in out:
        by_label[r[3]] += r[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, code, err, by_label[lab], sha) for i, code, err, lab in out)


def test_vector_codes_by_plain_reading(spark, awkward):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{awkward}/embeddings.parquet").to_pylist()]
    found = catalog.queries()["op11_vector_codes"](spark, awkward).collect()
    assert Counter(map(tuple, found)) == plain_codes(rows, 16, 64, 2)


def test_vectors_beyond_exact_numbers_are_refused(spark):
    with pytest.raises(ValueError):
        vector_codes.whole_numbers(spark.createDataFrame([([1e30] * 16,)], "embedding array<float>"))


# ---- Merkle manifest ----

@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 31, 256, 257, 300, 4097])
def test_closed_form_positions_are_the_completion_order(leaves):
    depth = merkle.depth_of(leaves)
    log = merkle.completion_log([merkle.digest(str(k)) for k in range(leaves)], depth)
    level = [merkle.digest(str(k)) for k in range(leaves)]
    seen = []
    for k in range(depth + 1):
        place = merkle.positions(k, leaves, depth)
        assert [log[p] for p in place] == level
        seen += place.tolist()
        level = [merkle.digest("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    assert sorted(seen) == list(range(len(log)))


def plain_tree(leaves):
    """Root, and (place, siblings) by level for each leaf."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 16 * 16:a // 16 * 16 + 16]
            paths[k].append((a % 16, run[:a % 16] + run[a % 16 + 1:]))
            at[k] = a // 16
        level = [merkle.digest("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_builders_of_any_size_make_the_same_trees(spark, levels):
    sizes = {None: 1, "a": 5, "é": 16, "b": 17, "hot": 700, **{f"s{k}": 1 for k in range(20)}}
    data = [(s, k, merkle.digest(f"{s}{k}")) for s, n in sizes.items() for k in range(n)]
    random.Random(3).shuffle(data)
    rows = spark.createDataFrame(data, "source string, id long, digest string")
    proved, log, upper = merkle.manifest(rows, F.col("source"), "id", ["id", "digest"], levels)
    got = {(r.tree, r.id): r for r in proved.collect()}
    names = sorted(sizes, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([merkle.digest(f"{s}{k}") for k in range(sizes[s])]) for s in names]
    root, above = plain_tree([t[0] for t in trees])
    assert [r.root for r in merkle.roots(upper).collect()] == [root]
    for s, (subroot, paths), up in zip(names, trees, above):
        for k, path in enumerate(paths):
            r = got["" if s is None else "s" + s, k]
            assert r.subroot == subroot and list(zip(r.places, r.siblings)) == [(p, "".join(o)) for p, o in path + up]
    assert len(got) == len(data)
    hot = merkle.nodes(log, levels).filter("tree = 'shot'").orderBy("position").collect()
    assert [r.digest for r in hot] == merkle.completion_log([merkle.digest(f"hot{k}") for k in range(700)], merkle.depth_of(700))


def test_tampering_is_found(spark, awkward):
    found = catalog.queries()["op12_merkle_manifest"](spark, awkward).collect()
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{awkward}/documents.parquet").to_pylist()}
    for r in found:
        if r.doc_id in (None, 4):
            continue
        touched = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified == (not touched)


# ---- WARC ----

def test_captures_read_back(spark, awkward, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.read.parquet(f"{awkward}/pages.parquet"), path)
    rows = warc.captures(warc.read(spark, path)).collect()
    pages = pq.read_table(f"{awkward}/pages.parquet").to_pylist()
    assert len(rows) == len(pages) and all(len(r.requests) == len(r.metadata) == 1 for r in rows)
    payloads = Counter((p["html"] or "").encode() for p in pages)
    assert Counter(bytes(r.response.payload) for r in rows if r.response.kind == "response") == dict.fromkeys(payloads, 1)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert Counter(r.response.payload_digest for r in rows) == Counter({digest(b): n for b, n in payloads.items()})
    for r in rows:
        assert r.response.target == r.requests[0].target and not set("\r\n é") & set(r.response.target or "")
    by_id = {r.record_id: r for r in rows}
    assert all(by_id[r.response.refers_to].response.payload_digest == r.response.payload_digest for r in rows if r.response.kind == "revisit")


def test_small_payloads_are_all_responses(spark, awkward, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.read.parquet(f"{awkward}/pages.parquet"), path, least_bytes=10)
    kinds = Counter((r.kind, r.payload_bytes >= 10) for r in warc.read(spark, path).filter("kind IN ('response', 'revisit')").collect())
    assert kinds["revisit", False] == 0 and kinds["revisit", True] == 30


def link(kind, name, to=(), payload=b"x"):
    id_ = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    more = [("WARC-Concurrent-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, t)}>") for t in to]
    return warc.record(kind, id_, "http://a.example/", "text/plain", payload, *more) + warc.END


def test_links_in_any_direction_and_gzip(spark, tmp_path):
    archive = [link("warcinfo", "i"), link("request", "q1"), link("response", "r1", ["q1"]), link("metadata", "m1", ["r1"]), link("metadata", "n1", ["m1"]),
               link("response", "r2"), link("request", "q3", ["gone"]), link("response", "r4", ["q4"], warc.END + warc.VERSION + b"x"), link("request", "q4", ["r4"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, archive)))
    (tmp_path / "b.warc").write_bytes(b"".join(archive).replace(b"WARC/1.1\r\nWARC-Type", b"WARC/1.0\r\nWARC-Type").replace(b"<urn:uuid:", b"<urn:uuid:b"))
    rows = warc.captures(warc.read(spark, str(tmp_path))).collect()
    assert Counter((r.response.kind if r.response else None, len(r.requests), len(r.metadata)) for r in rows) == {
        ("response", 1, 2): 2, ("response", 0, 0): 2, (None, 1, 0): 2, ("response", 1, 0): 2}


def test_broken_archives_are_errors(spark, tmp_path):
    good = warc.capture_records(1, 7, "http://a.example/", b"payload", None)
    for k, bad in enumerate([good[1] + b"\r\n\r\n"[:2], good[1].replace(b"payload", b"payloud") + warc.END, b"no archive"]):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x.warc").write_bytes(bad)
        with pytest.raises(Exception, match="WARC|digest"):
            warc.read(spark, str(tmp_path / f"{k}")).collect()


def test_an_end_at_the_end_of_a_buffer_does_not_read_the_file_whole(spark, tmp_path, monkeypatch):
    """Spark's reader misses ends across its 64 KB buffers; the pieces are still read apart, and odd files without a row of their own."""
    archive = b"".join(r + warc.END for k in range(6000) for r in warc.capture_records(k, k, f"http://a.example/{k}", bytes([97 + k % 26]) * (k % 97), None))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(archive)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "b.warc").write_bytes(archive + link("response", "r", [], warc.END + warc.VERSION + b"x" + warc.END) + archive.replace(b"WARC/1.1", b"WARC/1.0"))
    (tmp_path / "odd" / "c").write_bytes(gzip.compress(archive))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        for name, records in (("plain", 18_000), ("odd", 54_001)):
            rows = warc.read(spark, str(tmp_path / name))
            assert "binaryFile" not in rows._jdf.queryExecution().toString() and rows.count() == records
            found = Counter((r.record_id, r.payload_bytes) for r in rows.filter("kind = 'response'").select("record_id", "payload_bytes").collect())
            want = Counter({(warc.record_id(k, "response"), k % 97): 1 if name == "plain" else 3 for k in range(6000)})
            assert sum((found - want).values()) == (name == "odd") and not want - found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
