"""Plain readings of what the operators promise, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re

import regex

SPACE = "\x20\x09-\x0d"


def words(text: str | None) -> list[str]:
    return re.findall(rf"[^{SPACE}]+", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def private_spans(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def secret_base(text: str | None) -> list[tuple[int, int, str, int]]:
    text, out = text or "", []
    assign = regex.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for rank, (kind, pattern, good) in enumerate((
            ("assign", assign, lambda m: len(m[2]) >= 6),
            ("access", regex.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", regex.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if good(m)]
    return sorted(out)


def entropy_spans(text: str | None, window: int, thresholds: dict, uuid: str, allowed: tuple) -> list[tuple[int, int]]:
    """Every window's entropy from its own counts; the allow-list judges each span by its own text."""
    out: list[list[int]] = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{window},}}", text or ""):
        run = m[0]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or re.search(uuid, run):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) else "single" if not (re.search("[A-Z]", run) and re.search("[a-z]", run)) else "mixed"
        spans: list[list[int]] = []
        for i in range(len(run) - window + 1):
            part = run[i:i + window]
            h = -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part))
            if h >= thresholds[kind] - 1e-9:
                if spans and spans[-1][1] >= i + m.start():
                    spans[-1][1] = i + window + m.start()
                else:
                    spans.append([i + m.start(), i + window + m.start()])
        out += [s for s in spans if not any(re.search(a, text[s[0]:s[1]]) for a in allowed)]
    return [tuple(s) for s in out]


def simhash(text: str | None, k: int = 3) -> int:
    import xxhash

    ws = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], max_bits: int = 2) -> dict[int, int]:
    """id -> smallest id reachable over links of at most max_bits, by all pairs."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def lm_scores(rows: list[tuple[int | None, str | None]], L) -> list[float]:
    """The scores bit by bit with plain numbers; ``L`` gives the code tree and the parameters."""
    from collections import Counter

    texts = [[*(w.encode().lower() for w in words(t)), b""] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, texts) if not L.held_out(i) for w in ws)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:L.CODED]
    total, symbol = sum(counts.values()), {w: k + 1 for k, w in enumerate(frequent)}
    rest = total - sum(counts[w] for w in frequent)
    codes, bits = L.Codes([counts[w] for w in frequent], rest), L.table_bits(total)

    def slot(context, node, order):
        x = ((context << 12 | node) * (0x9E3779B97F4A7C15 + 2 * order)) % 2**64
        return order, ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> 64 - bits

    def events(text):
        """(place, node, bit, slots) of every bit."""
        seen = []  # places of coded tokens
        for at, w in enumerate(text):
            s = symbol.get(w, 0)
            one, two = (symbol[text[p]] for p in (seen[-1:] * 2 if len(seen) == 1 else seen[-2:][::-1])) if seen else (0, 0)
            two = two if len(seen) > 1 else 0
            near = int(bool(seen) and seen[-1] == at - 1)
            for k in range(codes.start[s], codes.start[s] + codes.depth[s]):
                node, bit = int(codes.nodes[k]), int(codes.bits[k])
                yield at, node, bit, [slot(one * 2 + near, node, 0), slot((one * (L.CODED + 1) + two) * 2 + near, node, 1)]
            if s:
                seen.append(at)

    tables = Counter()
    for (i, _), text in zip(rows, texts):
        if not L.held_out(i):
            for _, _, bit, slots in events(text):
                for x in slots:
                    tables[x, bit] += 1
    out = []
    for text in texts:
        score = sum(math.log10((counts[w] + L.ALPHA) / (rest + L.ALPHA * (len(counts) - len(frequent) + 1))) for w in text if w not in symbol)
        weights = [list(w) for w in L._first_weights()]
        ends, pending, upto = [*L.BLOCKS], {}, L.BLOCKS[0]
        for at, node, bit, slots in events(text):
            while at >= upto:
                for g, (n, sums) in pending.items():
                    weights[g] = [w + L.RATE * s / (n + 32) for w, s in zip(weights[g], sums)]
                pending = {}
                upto = next((e for e in ends if e > upto), upto + L.BLOCKS[-1])
            seen = [(tables[x, 0], tables[x, 1]) for x in slots]
            inputs = [float(codes.share[node]), *(min(max(math.log((b + L.PRIOR) / (a + L.PRIOR)), -8), 8) for a, b in seen), L.CONSTANT]
            level = [sum(a + b >= e for e in L.EVIDENCE) for a, b in seen]
            g = level[0] * 3 + level[1]
            p = 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights[g], inputs))))
            score += math.log10(p if bit else 1 - p)
            n, sums = pending.get(g, (0, [0.0] * L.INPUTS))
            pending[g] = n + 1, [s + (bit - p) * x for s, x in zip(sums, inputs)]
        out.append(score)
    return out
