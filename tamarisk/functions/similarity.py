"""Order-insensitive name similarity: 100 * 2 * LCS / (len a + len b) on sorted tokens."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SLICE = 16384
NAMES_AT_ONCE = 4096
LONG_NAME = 256   # a longer name is compared by itself, so that no array is padded to it

# Python workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sorted_tokens(c: Column) -> Column:
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(words), " ")


def code_points(names) -> tuple[np.ndarray, np.ndarray]:
    """(names x longest) code points padded with 0, and lengths."""
    lengths = np.fromiter((len(n) for n in names), np.int32, len(names))
    out = np.zeros((len(names), max(int(lengths.max(initial=0)), 1)), np.int32)
    for row, name in zip(out, names):
        row[: len(name)] = np.frombuffer(name.encode("utf-32-le"), np.int32)
    return out, lengths


def lcs_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS of each left row with the right row beside it (or of one left row with all)."""
    n, width = right.shape
    best = np.zeros((n, width + 1), np.int32)
    for i in range(left.shape[1]):
        ch = left[:, i : i + 1]
        hit = (ch == right) & (ch != 0)
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + hit), axis=1)
    return best[:, -1]


def lcs_of_long(a: str, b: str) -> int:
    """LCS with one bit of a number for each character of the longer name."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    whole = (1 << len(a)) - 1
    state = whole
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_of_long(a, b) / (len(a) + len(b))


def lowest_with_long(names: list[str], others: list[str] | None) -> float:
    """Smallest ratio of the pairs that have a long name in them."""
    lowest, right = 100.0, names if others is None else others
    long_right = [n for n in right if len(n) > LONG_NAME]
    for i, a in enumerate(names):
        for b in (right[i + 1:] if others is None else right) if len(a) > LONG_NAME else long_right:
            if a is not b and lowest > 0.0:
                lowest = min(lowest, ratio(a, b))
    return lowest


def ratios(lcs: np.ndarray, total_length: np.ndarray) -> np.ndarray:
    return np.where(total_length == 0, 100.0, 200.0 * lcs / np.maximum(total_length, 1))


def _symbols(*codes: np.ndarray) -> list[np.ndarray]:
    """The same names over a dense alphabet; padding gets the last number."""
    alphabet = np.unique(np.concatenate([c.ravel() for c in codes]))
    alphabet = alphabet[alphabet != 0]
    return [np.where(c == 0, len(alphabet), np.searchsorted(alphabet, c)).astype(np.intp) for c in codes]


def _bit_lcs(name: np.ndarray, others: np.ndarray, symbols: int) -> np.ndarray:
    """LCS of one name of at most 64 symbols with many (one column each): a bit per position."""
    where = np.zeros(symbols + 1, np.uint64)
    for i, symbol in enumerate(name):
        where[symbol] |= np.uint64(1 << i)
    state = np.full(others.shape[1], ~np.uint64(0))
    for column in others:
        hit = state & where[column]
        state = (state + hit) | (state - hit)
    used = np.uint64((1 << len(name)) - 1)
    return np.bitwise_count(~state & used).astype(np.int64)


def min_cross_ratio(left: list[str], right: list[str] | None) -> float:
    """Smallest ratio between two lists of names, or inside one list when right is None."""
    lowest = lowest_with_long(left, right)
    left = [n for n in left if len(n) <= LONG_NAME]
    right = None if right is None else [n for n in right if len(n) <= LONG_NAME]
    if not left or right == []:
        return lowest
    a, la = code_points(left)
    b, lb = (a, la) if right is None else code_points(right)
    dense_a, dense_b = _symbols(a, b)
    symbols = int(max(dense_a.max(initial=0), dense_b.max(initial=0)))
    columns = np.ascontiguousarray(dense_b.T)
    for i in range(len(a)):
        start = i + 1 if right is None else 0
        if start >= len(b) or lowest == 0.0:
            break
        if la[i] <= 64:
            lcs = _bit_lcs(dense_a[i, : la[i]], columns[:, start:], symbols)
        else:
            lcs = lcs_lengths(a[i : i + 1, : la[i]], b[start:])
        lowest = min(lowest, float(ratios(lcs, la[i] + lb[start:]).min()))
    return lowest


def _pair_lcs(dense: np.ndarray, masks: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS of name i with name j for arrays of pairs; ``masks`` has the places of each symbol in a name of at most 64 as bits."""
    state = np.full(len(i), ~np.uint64(0))
    for column in range(int(lengths[j].max(initial=0))):
        hit = state & masks[i, dense[j, column]]
        state = (state + hit) | (state - hit)
    used = np.where(lengths[i] > 0, ~np.uint64(0) >> (64 - np.maximum(lengths[i], 1)).astype(np.uint64), np.uint64(0))
    return np.bitwise_count(~state & used).astype(np.int64)


def _lowest_in(blocks: list[list[str]]) -> np.ndarray:
    """Smallest pairwise ratio inside each list of names; pairs of lists of one size are scored together."""
    lowest = np.full(len(blocks), 100.0)
    sizes = np.fromiter((len(b) for b in blocks), np.int64, len(blocks))
    first = np.cumsum(sizes) - sizes
    codes, lengths = code_points([n for b in blocks for n in b])
    dense, = _symbols(codes)
    masks = np.zeros((len(codes), int(dense.max(initial=0)) + 1), np.uint64)
    for place in range(min(codes.shape[1], 64)):
        rows = np.flatnonzero(lengths > place)
        masks[rows, dense[rows, place]] |= np.uint64(1 << place)
    for size in np.unique(sizes[sizes > 1]):
        rows = np.flatnonzero(sizes == size)
        p, q = np.triu_indices(size, 1)
        step = max(PAIR_SLICE // len(p), 1)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            i, j = (first[some][:, None] + p).ravel(), (first[some][:, None] + q).ravel()
            i, j = np.where(lengths[i] <= lengths[j], i, j), np.where(lengths[i] <= lengths[j], j, i)
            short = lengths[i] <= 64
            lcs = np.zeros(len(i), np.int64)
            lcs[short] = _pair_lcs(dense, masks, lengths, i[short], j[short])
            long = np.flatnonzero(~short)
            for k in range(0, len(long), 1024):
                part = long[k : k + 1024]
                lcs[part] = lcs_lengths(codes[i[part]], codes[j[part]])
            scores = ratios(lcs, lengths[i] + lengths[j])
            lowest[some] = np.minimum(lowest[some], scores.reshape(len(some), len(p)).min(axis=1))
    return lowest


@F.pandas_udf(T.DoubleType())
def min_ratio_in(blocks: pd.Series) -> pd.Series:
    """Smallest pairwise ratio inside each short list of names; some lists are scored at once."""
    lowest = np.array([lowest_with_long(list(b), None) if any(len(n) > LONG_NAME for n in b) else 100.0 for b in blocks], np.float64)
    blocks = [[n for n in b if len(n) <= LONG_NAME] for b in blocks]
    run = np.cumsum([len(b) for b in blocks]) // NAMES_AT_ONCE if blocks else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(blocks)]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            lowest[begin:end] = np.minimum(lowest[begin:end], _lowest_in(blocks[begin:end]))
    return pd.Series(lowest)


def lowest_to(names: list[str], pivots: list[str]) -> np.ndarray:
    """For each name its smallest ratio with the pivots, itself left out."""
    lowest = np.full(len(names), 100.0)
    short = np.array([k for k, n in enumerate(names) if len(n) <= LONG_NAME], np.int64)
    if len(short):
        codes, lengths = code_points([names[k] for k in short])
        for p in pivots:
            if len(p) > 64:
                continue
            dense, own = _symbols(codes, code_points([p])[0])
            lcs = _bit_lcs(own[0, :len(p)], np.ascontiguousarray(dense.T), int(max(dense.max(initial=0), own.max(initial=0))))
            same = np.array([names[k] == p for k in short])
            lowest[short] = np.minimum(lowest[short], np.where(same, 100.0, ratios(lcs, lengths + len(p))))
    for p in pivots:
        for k, n in enumerate(names):
            if n != p and (len(p) > 64 or len(n) > LONG_NAME):
                lowest[k] = min(lowest[k], ratio(n, p))
    return lowest


@F.pandas_udf(T.DoubleType())
def min_ratio_to(names: pd.Series, pivots: pd.Series) -> pd.Series:
    """Smallest ratio of each name with the pivots beside it; names with the same pivots are scored together."""
    out = np.full(len(names), 100.0)
    groups: dict[tuple, list[int]] = {}
    for k, ps in enumerate(pivots):
        groups.setdefault(tuple(ps), []).append(k)
    values = names.tolist()
    for ps, rows in groups.items():
        out[rows] = lowest_to([values[k] for k in rows], list(ps))
    return pd.Series(out)


def common_at_least(shared: int, words_a, m1_a, m2_a, words_b, m1_b, m2_b) -> np.ndarray:
    """Characters that two names surely share in order, from the letters of their first words and of the rest."""
    several = 1 + ((m1_a & m1_b) != 0).astype(np.int64) + ((m2_a & m2_b) != 0)
    return shared + np.where(words_a & words_b, several, ((m1_a | m2_a) & (m1_b | m2_b)) != 0)


def least_total(sure: np.ndarray, score: float) -> np.ndarray:
    """The smallest length of both names together with which a ratio of this many common characters is below the score.

    Ratios are divisions of whole numbers, so equal ones are equal as numbers: a pair that can only reach the score is left out.
    """
    total = np.maximum(np.floor(200.0 * sure / score).astype(np.int64) - 1, 1)
    for _ in range(3):
        total = np.where(200.0 * sure / total < score, total, total + 1)
    return total


def groups_to_meet(part: pd.DataFrame, letters: int) -> pd.DataFrame:
    """Pairs of a block's groups whose names could be below its score, with the lengths that would take.

    One row with group -1 when that is over half of all pairs of names.
    """
    part = part.sort_values("grp")
    grp, n, longest = (part[c].to_numpy(np.int64) for c in ("grp", "n", "longest"))
    score, shared = float(part["score"].iloc[0]), int(part["shared"].iloc[0])
    some = (1 << letters) - 1
    words, m1, m2 = grp >> 2 * letters == 1, grp >> letters & some, grp & some
    head = {"dataset": part["dataset"].iloc[0], "dob": part["dob"].iloc[0]}
    left, right, least, other, pairs = [], [], [], [], 0
    for i in range(len(grp)):
        sure = common_at_least(shared, words[i], m1[i], m2[i], words[i:], m1[i:], m2[i:])
        total = least_total(sure, score)
        j = np.flatnonzero(longest[i] + longest[i:] >= total)
        left.append(np.full(len(j), grp[i])), right.append(grp[i:][j])
        least.append(total[j] - longest[i:][j]), other.append(total[j] - longest[i])
        pairs += int(n[i] * n[i:][j].sum())
        if pairs > n.sum() ** 2 // 4:
            return pd.DataFrame([{**head, "grp": -1, "other": -1, "least": 0, "other_least": 0, "n": 0, "others": 0}])
    left, right = np.concatenate(left), np.concatenate(right)
    size = dict(zip(grp.tolist(), n.tolist()))
    return pd.DataFrame({"dataset": head["dataset"], "dob": head["dob"], "grp": left, "other": right, "least": np.concatenate(least), "other_least": np.concatenate(other),
                         "n": [size[g] for g in left.tolist()], "others": [size[g] for g in right.tolist()]})


def _kinds(words: np.ndarray, m1: np.ndarray, m2: np.ndarray, lengths: np.ndarray) -> tuple:
    """The distinct signatures with their longest length, and the signature of each name."""
    kinds, of = np.unique(np.stack([words.astype(np.int64), m1, m2], axis=1), axis=0, return_inverse=True)
    longest = np.zeros(len(kinds), np.int64)
    np.maximum.at(longest, of.ravel(), lengths)
    return kinds[:, 0] == 1, kinds[:, 1], kinds[:, 2], longest, of.ravel()


def score_cell(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the block's score so far, or a smaller ratio of a name of its own with one of the others.

    Names alike in their letters are bounded together, by the longest of them.
    """
    head = part.iloc[0]
    best, shared = float(head["score"]), int(head["shared"])
    own = part["own"].to_numpy(bool)
    sides = []
    for rows in (part[own], part[~own]):
        sides.append((rows["sorted_name"].tolist(), rows["len"].to_numpy(np.int64), rows["words"].to_numpy(bool), rows["m1"].to_numpy(np.int64), rows["m2"].to_numpy(np.int64)))
    (a, la, wa, a1, a2), (b, lb, wb, b1, b2) = sides
    if a and b:
        wk, k1, k2, lk, kind_a = _kinds(wa, a1, a2, la)
        wo, o1, o2, lo, kind_b = _kinds(wb, b1, b2, lb)
        kind_bound = lambda k: 200.0 * common_at_least(shared, wk[k], k1[k], k2[k], wo, o1, o2) / np.maximum(lk[k] + lo, 1)
        lowest = np.array([kind_bound(k).min() for k in range(len(lk))])
        order = [k for k in np.argsort(lowest, kind="stable") if lowest[k] < best]
        if order:
            plain = np.array([len(x) <= LONG_NAME for x in b])
            codes_a, _ = code_points([x if len(x) <= 64 else "" for x in a])
            codes_b, _ = code_points([x if p else "" for x, p in zip(b, plain)])
            dense_a, dense_b = _symbols(codes_a, codes_b)
            symbols, columns = int(max(dense_a.max(initial=0), dense_b.max(initial=0))), np.ascontiguousarray(dense_b.T)
        for k in order:
            if lowest[k] >= best:
                break
            some = np.flatnonzero((kind_bound(k) < best)[kind_b])
            sure = common_at_least(shared, wk[k], k1[k], k2[k], wb[some], b1[some], b2[some])
            mine = np.flatnonzero(kind_a == k)
            for i in mine[np.argsort(-la[mine], kind="stable")]:
                near = some[200.0 * sure / np.maximum(la[i] + lb[some], 1) < best]
                if not len(near):
                    break  # the names that follow are no longer
                fast = near[plain[near]] if len(a[i]) <= 64 else near[:0]
                if len(fast):
                    lcs = _bit_lcs(dense_a[i, :len(a[i])], columns[:, fast], symbols)
                    found = ratios(lcs, la[i] + lb[fast])
                    found[[n for n, j in enumerate(fast) if b[j] == a[i]]] = 100.0
                    best = min(best, float(found.min()))
                for j in near if not len(fast) else near[~plain[near]]:
                    if a[i] != b[j]:
                        best = min(best, ratio(a[i], b[j]))
    return pd.DataFrame({"dataset": [head["dataset"]], "dob": [head["dob"]], "score": [best]})


def score_probe(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the score so far of a block, or a smaller ratio of two of these names."""
    return score_cell(pd.concat([part.assign(own=True), part.assign(own=False)], ignore_index=True))


def score_chunk_pair(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the smallest ratio between the two chunks of names (ci, cj) of a block."""
    head = part.iloc[0]
    left = part.loc[part["chunk"] == head["ci"], "sorted_name"].tolist()
    right = None if head["ci"] == head["cj"] else part.loc[part["chunk"] == head["cj"], "sorted_name"].tolist()
    return pd.DataFrame({"dataset": [head["dataset"]], "dob": [head["dob"]], "score": [min_cross_ratio(left, right)]})
