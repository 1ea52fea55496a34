"""Parts of the corpus operators against plain readings of what they promise."""

import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from tamarisk.llm import chat, decontaminate, line_dedup, lm_score, mixing, private_data, quality, secrets, simhash, token_files


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789..--  ++@@aZ_()%1255é", max_size=60))
def test_private_base_patterns(text):
    want = sorted((private_data.KINDS.index(k), a, b) for k, a, b in brute.private_spans(text))
    assert [s for s in private_data.find(text) if s[0] < private_data.BASE_KINDS] == want


def test_private_identifiers():
    text = "iban GB82 WEST 1234 5698 7654 32 IBAN GB83WEST12345698765432 account: 123456 ssn 666-12-1234 SSN: 123-45-6789 ftp://u:p@h"
    kinds = [(private_data.KINDS[k], text[a:b]) for k, a, b in private_data.find(text)]
    assert kinds == [("iban", "GB82 WEST 1234 5698 7654 32"), ("account", "123456"), ("ssn", "123-45-6789"), ("userinfo", "u:p")]
    spans = [{"kind": private_data.KINDS[k], "start": a, "end": b} for k, a, b in private_data.find(text)]
    assert private_data.redacted(text, spans).startswith("iban [iban] IBAN GB83") and private_data.redacted(None, []) is None


def test_redact_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd", "x"), (2, None, "y")], "doc_id long, text string, private string")
    assert {r.doc_id: r.text for r in private_data.redact(docs).collect()} == {1: "write to [email]", 2: None}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aéßÿİŉ'st,.<|endofx>\n\t ", max_size=30), max_size=6))
def test_encoder_equals_whole_text(texts):
    encoder = token_files.encoder(token_files.public_vocabulary())
    for t in texts:
        whole = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == [*whole, token_files.END_ID], unicodedata.normalize("NFD", t)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-2**63, 2**63, 20_000, dtype=np.int64) for _ in range(2))
    h1[:500] = h1[500:1000]  # equal first halves
    index = line_dedup.LineIndex.build(h1, h2, np.full(len(h1), 300), np.arange(len(h1)))
    index = line_dedup.LineIndex.from_row(*index.row())
    at, known = index.known(h1, h2)
    assert known.all() and sorted(at) == list(range(len(h1)))
    assert not index.known(h1, h2 + 1)[1].any()
    assert (index.dropped(np.arange(len(h1)), h1, h2) == False).all() and index.dropped(np.full(len(h1), -5), h1, h2).all()  # noqa: E712


def test_line_dedup_with_hot_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    common = "a line that every document of the table holds"
    texts = [(k, "\n".join([common, f"a line of its own with number {k:05d}", f"a line that four share {k // 4:05d} ", "short"])) for k in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.kept_text.split("\n") for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(common in lines for lines in found.values()) == 1 and common in found[899]
    assert all(len(lines) == 2 + (k % 4 == 3) + (k == 899) for k, lines in found.items())


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 17, 300, 2500):
        centres = rng.integers(0, 2**64, max(1, n // 30), dtype=np.uint64)
        fps = centres[rng.integers(0, len(centres), n)]
        for _ in range(4):
            fps = fps ^ (rng.random(n) < 0.6).astype(np.uint64) * (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        fps = np.unique(fps)
        index = simhash.GrayIndex(fps)
        for bits in (0, 2, 3):
            found = {frozenset((int(x), int(y))) for a, b in index.links(bits) for x, y in zip(index.fps[a], index.fps[b])}
            i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
            assert found == {frozenset((int(fps[x]), int(fps[y]))) for x, y in zip(i, j)}


def test_large_groups_are_split_without_losing_links(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64)}
    while len(fps) < 1500:
        fps.add(rng.choice(sorted(fps)[-40:]) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ (rng.random() < 0.3) << rng.randrange(64))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    distinct = spark.createDataFrame([(f, 0, f) for f in fps], "fp long, check long, node long")
    root = {r.node: r.root for r in simhash.components(simhash.links(distinct, 2, group_rows=40)).collect()}
    want = brute.components({f: f & (1 << 64) - 1 for f in fps})
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(root.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_second_fingerprints_part_chance_neighbours(spark):
    rows = spark.createDataFrame([(1, 0, 10), (3, 0, 11), (1, -1, 12)], "fp long, check long, node long")
    assert {(r.a, r.b) for r in simhash.links(rows, 2, max_check_bits=10).collect()} == {(11, 10)}


def test_one_document_of_each_component_stays(spark):
    text = " ".join(f"word{k}" for k in range(3000))
    near = text.replace("word77 ", "changed ")
    apart = (simhash.fingerprint(text) ^ simhash.fingerprint(near)) & (1 << 64) - 1
    assert 0 <= apart.bit_count() <= 2
    docs = spark.createDataFrame([(9, text, "x"), (3, near, "y"), (5, "another text", "z"), (5, text.upper(), "w"), (None, "another  text", None), (6, "", "e"), (7, None, "e")], "doc_id long, text string, id string")
    kept = simhash.one_of_each(docs).collect()
    assert simhash.one_of_each(docs).columns == docs.columns and len(kept) == 3
    assert {bool(r.text) for r in kept} == {True, False} and len([r for r in kept if r.text and r.text.startswith("word")]) <= 1


def test_long_chains_become_one_component(spark):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_recall_of_edited_items():
    rng = random.Random(6)
    vocabulary = [f"w{k}".encode() for k in range(300)] + [b"the", b"of"] * 60
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 60))] for _ in range(150)]
    index = decontaminate.ItemIndex(list(range(150)), [b" ".join(i).decode() for i in items], 0.2, 0.99)
    hits = 0
    for k, item in enumerate(items):
        changed = list(item)
        for _ in range(len(item) // 5):
            p = rng.randrange(len(changed))
            changed[p:p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        doc = [rng.choice(vocabulary) for _ in range(80)] + changed + [rng.choice(vocabulary) for _ in range(80)]
        hits += any(i == k for _, i, *_ in decontaminate.leaks_in(index, [[], doc, []]))
    assert hits >= 0.95 * len(items)


def recall_at(size, trials=200):
    """The share of items of one size found with as many substituted words as they may have."""
    rng = random.Random(size)
    items = [[f"i{k}x{j}".encode() for j in range(size)] for k in range(trials)]
    index = decontaminate.ItemIndex(list(range(trials)), [b" ".join(i).decode() for i in items], 0.2, 0.99)
    docs = []
    for item in items:
        changed = list(item)
        for p in rng.sample(range(size), int(size * 0.2)):
            changed[p] = b"changed%d" % p
        docs.append([b"before"] * 40 + changed + [b"after"] * 40)
    return len({(d, i) for d, i, *_ in decontaminate.leaks_in(index, docs) if d == i}) / trials


def test_recall_of_each_item_length():
    for size in range(12, decontaminate.WALK_WORDS):
        assert recall_at(size, 60) == 1.0, size
    for size in (30, 34, 40, 50, 60):
        assert recall_at(size) >= 0.97, size  # 0.99 is promised; 200 trials


def test_short_items_equal_every_window():
    """Items of 1 to 29 words against the exact distance to any stretch, at the edges of texts too."""
    rng = random.Random(9)
    letters = [b"%c" % c for c in b"abcdefghijkl"]
    items = [[rng.choice(letters) for _ in range(n)] for n in range(1, 30)] + [[b"q%d" % k for k in range(n)] for n in (4, 5, 9, 10, 11)]
    docs = [[rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[b"q0"]]
    for item in items:
        for _ in range(8):
            changed = list(item)
            for _ in range(rng.randint(0, len(item) // 5 + 1)):
                p = rng.randrange(len(changed) + 1)
                changed[p:p + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
            docs.append([b"x"] * rng.randint(0, 2) + changed + [b"y"] * rng.randint(0, 2))
    index = decontaminate.ItemIndex(list(range(len(items) + 1)), [*(b" ".join(i).decode() for i in items), " .,"], 0.2, 0.99)
    found = {(d, i): e for d, i, e, *_ in decontaminate.leaks_in(index, docs)}
    want = {(d, i): e for d, doc in enumerate(docs) for i, item in enumerate(items) if (e := decontaminate.best_edits(item, doc)[0]) <= len(item) // 5}
    assert found == want and {len(items[i]) for _, i in want} == set(range(1, 30))


def test_items_in_parts_give_the_same(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(decontaminate.leaks(docs, items).collect())
    assert whole and whole == sorted(decontaminate.leaks(docs, items, part_bytes=1500).collect())


def test_codes_are_a_distribution():
    codes = lm_score.Codes([50, 20, 20, 5, 1], 30)
    assert abs(sum(2.0 ** -int(d) for d in codes.depth) - 1) < 1e-12
    token, node, bit = codes.events(np.array([0, 5, 1]))
    assert len(node) == codes.depth[[0, 5, 1]].sum() and set(token) == {0, 1, 2}
    assert len(lm_score.Codes([], 0).events(np.array([0, 0]))[0]) == 0


def test_score_sums_to_one_over_the_next_token():
    """With the weights of the first block, the probabilities of all tokens after a context sum to 1."""
    counts = {b"": 40, b"the": 30, b"of": 9, b"cat": 2, b"dog": 1}
    frequent = sorted(counts, key=lambda t: (-counts[t], t))
    tables = np.random.default_rng(2).integers(0, 9, 4 << lm_score.table_bits(sum(counts.values())))
    model = lm_score.Model(frequent, [counts[t] for t in frequent], sum(counts.values()), len(counts), tables)
    total = 0.0
    for t in range(len(frequent)):
        index = np.array([0, 1, t])
        before = lm_score.mixed_log(model, index[:2], np.array([2]))[0]
        total += np.exp(lm_score.mixed_log(model, index, np.array([3]))[0] - before)
    escape = np.array([0, 1, -1])
    total += np.exp(lm_score.mixed_log(model, escape, np.array([3]))[0] - lm_score.mixed_log(model, escape[:2], np.array([2]))[0])
    assert abs(total - 1) < 1e-5


def test_inverse_demand(spark):
    for knots in mixing.SCHEDULES:
        df = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn("t", mixing.inverse_demand(F.col("share"), knots))
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        for r in df.collect():
            done = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                span = min(max(r.t - t0, 0), t1 - t0)
                done += span * (w0 + w0 + (w1 - w0) * span / (t1 - t0)) / 2
            assert abs(done / whole - r.share) < 1e-9 and 0 <= r.t <= 1


def test_targets_stop_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1665) < 1e-9 and got[None] == 200 and abs(got["b"] - 1445) < 1e-9


def test_mixed_is_in_training_order(spark):
    docs = spark.createDataFrame([(k, "word " * 10, "s", k) for k in range(40)] + [(7, "word " * 10, "s", 7)], "doc_id long, text string, source string, size long")
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and abs(rows.count() - 61) <= 1


def test_mixing_query_reads_the_written_order(spark, awkward, monkeypatch):
    """The query takes what the written mix holds: rows missing there are not taken, and its positions ascend."""
    order, seen = mixing.training_order, []

    def half(placed):
        written = order(placed)
        seen.extend(r["_m_position"] for k in sorted(written.inputFiles()) for r in spark.read.parquet(k).collect())
        return written.where("_m_row % 2 = 0")

    monkeypatch.setattr(mixing, "training_order", half)
    found = [r for r in mixing.op4_source_mixing(spark, awkward).collect() if r["doc_id"] not in (None, 4)]
    assert seen == sorted(seen) and len(seen) > 60
    assert all(r["taken"] == 0 and r["position_1"] is None for r in found if r["doc_id"] % 2) and sum(r["taken"] for r in found) > 0


def test_prefixes_written_out(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn int, role string, text string")
    made = sorted(chat.example_texts(chat.formatted_turns(turns)).collect())
    assert [(r.target, r.text[r.loss_start:r.loss_end]) for r in made] == [(1, "b"), (3, "d")]
    assert made[1].text.startswith(made[0].text) and made[0].text == "### user: a</turn>\n### assistant: b</turn>\n"


def test_escapes_round_trip(spark):
    texts = ["\\", "#\\", "<\\</turn>", "\\\\##", "### x: y", "", ":"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for marks in (chat._IN_TEXT, chat._IN_ROLE):
        for r in df.select("t", chat.escape(F.col("t"), marks).alias("e"), chat.unescape(chat.escape(F.col("t"), marks), marks).alias("u")).collect():
            assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e


def test_filters_on_verdicts_do_not_rewrite_the_measures(spark):
    """A filter above the verdict must not copy the expressions into a condition below."""
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.judge(docs).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 4


def test_entropy_counts_follow_the_window(spark):
    text = "aaaaaaaaaa0000000000" + "Zx8Qw3nT7vLk2Rb9Yc4Hd6Jf1Mg5Ps0A" + "b" * 40 + " Zx8Qw3nT7vLk2Rb9Yc4H" + " 550e8400-e29b-41d4-a716-446655440000 example" + "Zx8Qw3nT7vLk2Rb9Yc4H"
    row = secrets.scan(spark.createDataFrame([(text, 1)], "text string, secrets int")).first()
    got = [(s.start, s.end) for s in row.secrets if s.kind == "entropy"]
    assert got == brute.entropy_spans(text, secrets.WINDOW, secrets.THRESHOLDS, secrets.UUID, secrets.ALLOWED) and len(got) == 2


def spans_of(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = secrets.scan(docs).select("doc_id", F.filter("secrets", lambda x: x["kind"] == "entropy").alias("s"))
    return {r.doc_id: [(x["start"], x["end"]) for x in r.s] for r in found.collect()}


def test_allow_list_judges_spans(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.sample(letters, 40))
    parts = ["".join(rng.sample(letters, 20)) for _ in range(3)]
    long = "".join(rng.choices(letters + "+/", k=344))
    texts = [f"key /api/v1/keys/{key} end", "see " + "/".join(parts), long, "open /usr/share/PythonTools/site_packages2/MyModule/index_2024-01/readMe now",
             "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 is", f"{key[:20]}{'=' * 30}my-example-{key[:6]}{'-' * 30}"]
    found = spans_of(spark, texts)
    assert any(a <= texts[0].index(key) and b >= texts[0].index(key) + 40 for a, b in found[0])
    assert all(any(a <= texts[1].index(p) and b >= texts[1].index(p) + 20 for a, b in found[1]) for p in parts)
    assert found[2] and not found[3] and not found[4] and found[5]
    for k, t in enumerate(texts):
        assert found[k] == brute.entropy_spans(t, secrets.WINDOW, secrets.THRESHOLDS, secrets.UUID, secrets.ALLOWED)


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000))
    turns = "".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=22)) + "a" * 25 for _ in range(400))
    many = " ".join(f"token={k:06d} AKIA{k:016d}" for k in range(10_000))
    found = spans_of(spark, [long, turns])
    for k, t in enumerate((long, turns)):
        assert found[k] == brute.entropy_spans(t, secrets.WINDOW, secrets.THRESHOLDS, secrets.UUID, secrets.ALLOWED)
    row = secrets.scan(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in row.secrets if s["kind"] != "entropy"] == brute.secret_base(many)


def test_white_space_at_line_ends_is_no_word(spark):
    line = "eleven words without any mark stand in this line right here"
    assert len(line.split()) == 11
    lines = [line, f"\t{line}", f"{line}\r", f"{line} more", f" {line} more\r"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, text string").select("k", quality.line_fails(F.col("text")).alias("fails"))
    assert {r.k: r.fails for r in found.collect()} == {0: False, 1: False, 2: False, 3: True, 4: True}
    text = "\r\n".join([f"{line}."] * 2 + [line] * 6)
    one, crlf = (quality.judge(spark.createDataFrame([(t,)], "text string")).first() for t in (text.replace("\r", ""), text))
    assert one.kept_chars == crlf.kept_chars == one.word_chars and one.kept == crlf.kept


def test_plan_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], 5 + k, "x", "y", "z", 1) for k in range(20)], "doc_id long, source string, size long, target string, source_size string, positions string, rank int")
    found = mixing.plan(docs)
    assert found.columns == ["doc_id", "source", "size", "source_size", "target", "positions"] and found.count() == 20


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(k, "abc"[k % 3], 10) for k in range(3000)], "doc_id long, source string, size long")
    places = {s: sorted(p for r in rows for p in r.positions) for s, rows in _by_source(mixing.plan(docs).collect()).items()}
    means = {s: sum(p) / len(p) for s, p in places.items()}
    assert all(0 <= p[0] and p[-1] <= 1 for p in places.values())
    # the first third by the early curve, whose mean time is 5/12; the steady one 1/2; the late one 5/8
    assert abs(means["a"] - 5 / 12) < 0.01 and abs(means["b"] - 0.5) < 0.01 and abs(means["c"] - 5 / 8) < 0.01


def _by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def test_context_tables_grow_with_the_corpus():
    assert [lm_score.table_bits(n) for n in (0, 10**5, 10**6, 10**7)] == [12, 13, 16, 20]


def test_an_unlikely_bit_costs_a_finite_score():
    counts = {b"": 40, b"the": 30, b"of": 9}
    frequent = sorted(counts, key=lambda t: (-counts[t], t))
    tables = np.zeros(4 << lm_score.table_bits(79), np.int64)
    tables[::2] = 10**9
    model = lm_score.Model(frequent, [counts[t] for t in frequent], 79, 3, tables)
    assert np.isfinite(lm_score.mixed_log(model, np.array([2, 1] * 5000), np.array([10_000]))).all()
