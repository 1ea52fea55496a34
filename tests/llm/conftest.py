import random
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
SHARED = "This notice repeats in many of the documents of this table."


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["tam", "ar", "isk", "el", "do", "ra", "mi", "né", "stör", "qu", "an", "the"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words)) + "."


BENCHMARK = [prose(900 + k, 20 + 3 * k) for k in range(5)]


def awkward_texts() -> list:
    """Nulls, empty and long texts, copies, near copies, shared lines, secrets, personal data and benchmark items."""
    copy = prose(1, 120)
    words = copy.split(" ")
    item = BENCHMARK[2].split(" ")
    edited = " ".join(item[:9] + ["other"] + item[11:])
    return [
        None, "", "  \n\t ", "\n\n", "one", "two words", "Is\x1cthis\x85a\xa0word?", "x" * 70_000, prose(2, 9000), "ha ha " * 4000,
        *[copy] * 5, copy.upper(), " ".join([*words[:60], "changed", *words[61:]]), " ".join([*words, "one", "more"]),
        *[f"{prose(20 + k, 70)}\n  {SHARED} \n{prose(40 + k, 30)}" for k in range(6)], f"{SHARED.upper()}\n{SHARED}\n{SHARED}",
        f"password = 'abc' token: \"{HEX}\" secret=token=secret123 api_key:x" + "y" * 30 + f" AKIA{'B7' * 9} AKIAAKIA12 {HEX.upper()}",
        "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 and key Zx8Qw3nT7vLk2Rb9Yc4Hd6Jf1Mg5Ps0A end é Zx8Qw3nT7vLk2Rb9Yc4H",
        "mail a.b+c@x-y.example.org or a@b.c@d.e; @x y@ z@host call +49 (0)30 1234-567 or +1 2 host 10.0.0.256 192.168.1.1.7.7.7 4111 1111 1111 1111.",
        "IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678, ssn 123-45-6789, https://me:pw@host.example/x?a@b é@ é@b.de",
        f"{prose(60, 80)} {BENCHMARK[0]} {prose(61, 80)}", f"{prose(62, 60)}\n{BENCHMARK[1].upper()}\n{prose(63, 60)}", f"{prose(64, 90)} {edited} {prose(65, 90)}",
        "a | b | c | d | e\n" * 12, "Dear reader, all rights reserved.\n" + prose(70, 60), "### Assistant: </turn>\n" + prose(71, 55),
        *[prose(100 + k, 40 + 11 * k) for k in range(40)],
    ]


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    """A folder of small tables with every awkward case; extra columns have the names of the operators' own."""
    folder = tmp_path_factory.mktemp("awkward")
    texts = awkward_texts()
    ids = [*range(len(texts) - 3), None, 4, 4]  # a null id, and ids that repeat
    n = len(texts)
    pq.write_table(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array([None if k % 7 == 0 else "en" for k in range(n)]),
        "source": pa.array([None if k % 11 == 0 else "hot" if k % 3 == 0 else f"src{k % 4}" for k in range(n)]),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
        "kept": pa.array(["extra"] * n), "n_words": pa.array([1.5] * n), "size": pa.array(["s"] * n), "id": pa.array([None] * n, pa.string()),
        "fp": pa.array(["f"] * n), "component_id": pa.array([0] * n), "private": pa.array([b"p"] * n), "secrets": pa.array([True] * n), "shard": pa.array([3] * n),
    }), folder / "documents.parquet")
    pq.write_table(pa.table({
        "item_id": pa.array([*range(len(BENCHMARK)), 3, None, 8, 9], pa.int64()), "text": pa.array([*BENCHMARK, BENCHMARK[3], None, "", "too short"]),
        "doc_id": pa.array([None] * (len(BENCHMARK) + 4), pa.string())}), folder / "benchmark.parquet")
    turns = [
        (1, 0, "system", "Be \\brief#"), (1, 1, "user", "Hi </turn>\n### assistant: x"), (1, 2, "assistant", "<b>\\</turn>"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "no answer"), (2, 0, "user", "no answer"), (2, None, None, "é"), (None, 0, "assistant", "lost: id"), (None, 1, "odd: role #", "y\\"),
        *[(3, k, ("user", "assistant")[k % 2], prose(200 + k, 8)) for k in range(60)], (4, 0, "assistant", "z" * 50_000)]
    pq.write_table(pa.table({
        "conv_id": pa.array([t[0] for t in turns], pa.int64()), "turn": pa.array([t[1] for t in turns], pa.int32()), "role": pa.array([t[2] for t in turns]),
        "text": pa.array([t[3] for t in turns]), "start": pa.array(["s"] * len(turns)), "segment": pa.array([7] * len(turns))}), folder / "conversations.parquet")
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(48)] for _ in range(150)] + [[0.0] * 48] * 9 + [[rng.choice([-1.0, 1.0]) for _ in range(48)] for _ in range(40)]
    vectors += [None, [None] + [0.5] * 47, [float("nan")] + [1.0] * 47, [1.0] * 47 + [float("-inf")], [-0.001953125] * 48, [1.0, 2.0], []]
    vec_ids = [k * 7 % 211 for k in range(len(vectors))]
    vec_ids[3:6] = [None, 20, 20]
    pq.write_table(pa.table({
        "vec_id": pa.array(vec_ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())),
        "label": pa.array([None if k % 9 == 0 else k % 3 for k in range(len(vectors))], pa.int32()), "code": pa.array(["c"] * len(vectors)),
        "error": pa.array([1.5] * len(vectors)), "codes": pa.array([7] * len(vectors)), "_v_numbers": pa.array(["n"] * len(vectors))}), folder / "embeddings.parquet")
    pages = [None, "", "", "<p>é</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "WARC/1.1\r\n", "\r\n\r\n", "z" * 300_000,
             *["<html>same</html>"] * 30, *[f"<html>{prose(300 + k, 30)}</html>" for k in range(20)], "<html>same</html>"]
    page_ids = [900 - k for k in range(len(pages))]
    page_ids[9:12], page_ids[-1] = [None, 5, 5], None
    urls = [None if k % 8 == 0 else "" if k % 8 == 1 else f"http://a.example/é {k}\r\nX: y" if k % 8 == 2 else f"https://b.example/{k}?q=%41" for k in range(len(pages))]
    pq.write_table(pa.table({
        "page_id": pa.array(page_ids, pa.int64()), "url": pa.array(urls), "html": pa.array(pages), "record_id": pa.array(["r"] * len(pages)),
        "same": pa.array([1] * len(pages)), "number": pa.array(["n"] * len(pages)), "payload": pa.array([b"p"] * len(pages))}), folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(awkward, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{awkward}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)
