"""Personal data by anchor expansion.

One Aho-Corasick automaton passes over a text and stops at anchors: at-signs, a digit before or after
the marks of numbers, plus signs, schemes, and cue words of identifiers. A parser of its own starts at
each anchor, expands to both sides, finds the boundaries and validates what it found. Texts without an
anchor cost one pass and nothing else.

Kinds: email, ip, card, phone as fixed patterns, leftmost and without overlap inside a kind; and, by
cue words, iban (check digits), account (digits after an account cue), ssn (three groups that can be
issued) and userinfo (name and password before the host of a URL).

Defined cases: a null or empty text has no spans. Spans are in code points, end exclusive; kinds may
overlap each other, spans of one kind do not. Repeated rows give equal results. Extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm.base import over_rows, table, worker_object

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone", "iban", "account", "ssn", "userinfo")
BASE_KINDS = 4
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
ALNUM = frozenset(string.ascii_letters + string.digits)
PHONE_INNER = frozenset(string.digits + " ().-")
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)
# Cue words, in lower case; a cue counts where no letter or digit touches it.
CUES = {
    "iban": ("iban",),
    "account": ("account number", "account no", "account", "acct", "konto", "kontonummer", "compte", "cuenta"),
    "ssn": ("ssn", "social security number", "social security"),
}
CUE_GAP = 12           # characters of space and marks between a cue and its identifier
ACCOUNT_DIGITS = (6, 18)
GAP = frozenset(" \t:#=.-'\"()")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in string.digits:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def passes_iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and set(code[2:4]) <= DIGITS and set(code) <= ALNUM):
        return False
    return int("".join(str(int(c, 36)) for c in (code[4:] + code[:4]).upper())) % 97 == 1


def run_end(text: str, at: int, members: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in members:
        at += 1
    return at


class Parsers:
    """The boundaries of each kind in one text; each kind remembers where its last match ended."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, int]] = []
        self.email_from = self.phone_from = self.numbers_from = self.octets_from = 0
        self.last = dict.fromkeys(KINDS, 0)

    def keep(self, kind: str, start: int, end: int) -> None:
        self.spans.append((KINDS.index(kind), start, end))

    def at(self, i: int) -> None:
        """An at-sign: local characters to the left, dotted labels to the right."""
        text, start = self.text, i
        while start > self.email_from and text[start - 1] in LOCAL:
            start -= 1
        end = run_end(text, i + 1, LABEL)
        if start == i or end == i + 1:
            return
        first = end
        while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
            end = run_end(text, end + 1, LABEL)
        if end > first:
            self.keep("email", start, end)
            self.email_from = end

    def digit(self, i: int) -> None:
        if i >= self.octets_from:
            self.octets(i)
        if i >= self.numbers_from:
            self.number(i)

    def octets(self, i: int) -> None:
        """A chain of digit runs joined by single dots; four parts at a time are an address."""
        text, parts, at = self.text, [], i
        while True:
            end = run_end(text, at, DIGITS)
            parts.append((at, end))
            if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
                break
            at = end + 1
        self.octets_from = parts[-1][1]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            if all(octet_value(text[a:b]) for a, b in four):
                self.keep("ip", four[0][0], four[3][1])

    def number(self, i: int) -> None:
        """Digits with at most one blank or hyphen between two of them."""
        text, end, n = self.text, i + 1, len(self.text)
        while end < n:
            if text[end] in DIGITS:
                end += 1
            elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
                end += 2
            else:
                break
        self.numbers_from = end
        if CARD_DIGITS[0] <= end - i:
            digits = "".join(c for c in text[i:end] if c in DIGITS)
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and passes_luhn(digits):
                self.keep("card", i, end)

    def plus(self, i: int) -> None:
        """A plus sign and a digit, then digits and marks up to the last digit of the run."""
        text = self.text
        if i < self.phone_from or i + 1 >= len(text) or text[i + 1] not in DIGITS:
            return
        end = run_end(text, i + 2, PHONE_INNER)
        while end > i + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end < i + 4:  # a sign, a digit, one inner character and a digit at least
            return
        self.phone_from = end
        if PHONE_DIGITS[0] <= sum(c in DIGITS for c in text[i:end]) <= PHONE_DIGITS[1]:
            self.keep("phone", i, end)

    def scheme(self, i: int) -> None:
        """``://`` and name:password before an at-sign, inside the URL's authority."""
        text, at = self.text, i
        while at < len(text) and text[at] not in " \t\n\r\x0b\x0c/?#\"'<>":
            at += 1
        user, sign, _ = text[i:at].rpartition("@")
        if sign and ":" in user and user.strip(":"):
            self.keep("userinfo", i, i + len(user))

    def cue(self, kind: str, start: int, end: int) -> None:
        """An identifier at most a gap behind its cue word."""
        text = self.text
        if (start and text[start - 1] in ALNUM) or (end < len(text) and text[end] in ALNUM):
            return
        at = end
        while at < len(text) and at - end < CUE_GAP and text[at] in GAP:
            at += 1
        if at == end or at < self.last[kind]:
            return
        found = {"iban": self.iban, "account": self.account, "ssn": self.ssn}[kind](at)
        if found:
            self.keep(kind, at, found)
            self.last[kind] = found

    def iban(self, at: int) -> int:
        """Groups of letters and digits, blanks between them allowed; the longest valid code counts."""
        text, code, best, end = self.text, "", 0, at
        while end < len(text) and len(code) < 34:
            if text[end] in ALNUM:
                code += text[end]
            elif text[end] != " " or not code or text[end - 1] == " ":
                break
            end += 1
            if len(code) >= 15 and text[end - 1] in ALNUM and not (end < len(text) and text[end] in ALNUM) and passes_iban(code):
                best = end
        return best

    def account(self, at: int) -> int:
        text, end = self.text, at
        while end < len(text) and (text[end] in DIGITS or (text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS)):
            end += 1
        digits = sum(c in DIGITS for c in text[at:end])
        whole = end == len(text) or text[end] not in ALNUM
        return end if whole and ACCOUNT_DIGITS[0] <= digits <= ACCOUNT_DIGITS[1] and text[at] in DIGITS else 0

    def ssn(self, at: int) -> int:
        m = re.compile(r"(?!000|666|9)[0-9]{3}([ -])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])").match(self.text, at)
        return m.end() if m else 0


def octet_value(part: str) -> bool:
    """At most 255, whatever the number of leading zeros."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    if not text:
        return []
    found = Parsers(text)
    anchors: Iterator = worker_object(("anchors",), _automaton).iter(text)
    for end, (anchor, length) in anchors:
        if anchor == "digit":
            found.digit(end)
        elif anchor == "at":
            found.at(end)
        elif anchor == "plus":
            found.plus(end)
        elif anchor == "scheme":
            found.scheme(end + 1)
        else:
            found.cue(anchor, end + 1 - length, end + 1)
    return sorted(found.spans)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``private``: spans (kind, start, end) by kind and start; a column of that name is replaced."""
    docs = docs.drop("private")
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    schema = T.StructType([*docs.schema.fields, T.StructField("private", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in find(t)] for t in b.column("text").to_pylist()]
            yield from pa.Table.from_batches([b]).append_column("private", pa.array(found, kind)).to_batches()

    return docs.mapInArrow(run, schema)


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    at, parts = 0, []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            parts += [text[at:s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents without their personal data, in the same columns."""
    found = scan(docs)
    schema = found.drop("private").schema
    position = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("private").to_pylist())]
            t = pa.Table.from_batches([b]).drop_columns(["private"])
            yield from t.set_column(position, "text", pa.array(texts, pa.string())).to_batches()

    return found.mapInArrow(run, schema)


def digest(ids: list, texts: list) -> list[list]:
    """The columns of the registered query."""
    rows = []
    for i, t in zip(ids, texts):
        spans = find(t)
        base = [s for s in spans if s[0] < BASE_KINDS]
        counts = [sum(s[0] == k for s in base) for k in range(BASE_KINDS)]
        rows.append((i, *counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans)))
    return [list(c) for c in zip(*rows)] if rows else [[]] * 7


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return over_rows(docs, digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", keeps="anchors")
