"""Periodic runs: maximal stretches of words that repeat with a period, found by block convolution.

A run with least period q has ``REPEATS`` times q words at least. For a dyadic scale s and s <= q < 2s it holds an aligned
block of s words whole, together with the block's copy q words further on. So at each scale:

1. The words are cut into blocks of s. For each block, the sums of squared differences between its words' numbers and
   those of the following window are computed for all distances s to 2s - 1 at once: by number-theoretic transforms modulo as
   many primes as make the sums exact (directly at small scales, where that is cheaper). A sum of zero is an occurrence.
2. The distance of an occurrence seeds an extension to both sides, as far as words q apart are identical. A stretch long enough is
   a run of that period, or of a smaller one, which an earlier scale has found.

Two exact tests spare transforms. In a run every word comes again within q words, so a block can be skipped if one of its
words doesn't come again within 2s - 1. And a block whose whole window lies in a run of smaller period has only occurrences at
multiples of that period, which seed nothing new.

Texts of a batch are numbered together, each with numbers of its own, so no run crosses texts.

Edge cases: a null or empty text has no words and no run; repeated documents each return a row; a null id leaves the text as
it is where ids decide (see ``edited``); an empty table gives an empty result; memory follows the longest text or some
hundred thousand words. Of runs with equal exponents the first comes first, then the one of lesser period. Only the named
columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A run has so many periods, and so many words, at least.
REPEATS, LEAST = 4, 6
#: Scales below this are summed directly.
DIRECT = 32
#: NTT primes (p, generator): p - 1 is divisible by 2**23 and more.
PRIMES = ((998244353, 3), (2013265921, 31), (469762049, 3))
_BATCH = 1 << 18
_ROOTS: dict[tuple[int, int, bool], np.ndarray] = {}


def _roots(p: int, g: int, size: int, back: bool) -> np.ndarray:
    """Powers 0 to size / 2 - 1 of a root of unity of order ``size``."""
    key = (p, size, back)
    if key not in _ROOTS:
        w = pow(g, (p - 1) // size, p)
        w = pow(w, -1, p) if back else w
        out = np.ones(1, np.uint64)
        while len(out) < size // 2:
            out = np.concatenate([out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)])
        _ROOTS[key] = out[: max(1, size // 2)]
    return _ROOTS[key]


def ntt(x: np.ndarray, p: int, g: int, back: bool = False) -> np.ndarray:
    """The transform of each row modulo p; ``back`` gives the rows again. The length is a power of two.

    Forth by decimation in frequency, back by decimation in time: the order of the values between is that of reversed bits.
    """
    rows, n = x.shape
    q = np.uint64(p)
    x = x.astype(np.uint64) % q
    sizes = [n >> i for i in range(n.bit_length() - 1)]
    for size in reversed(sizes) if back else sizes:
        y = x.reshape(rows, n // size, 2, size // 2)
        w = _roots(p, g, size, back)
        a, b = y[:, :, 0], y[:, :, 1]
        out = np.empty_like(y)
        if back:
            b = b * w % q
            out[:, :, 0], out[:, :, 1] = (a + b) % q, (a + q - b) % q
        else:
            out[:, :, 0], out[:, :, 1] = (a + b) % q, (a + q - b) * w % q
        x = out.reshape(rows, n)
    return x * np.uint64(pow(n, -1, p)) % q if back else x


def squared_differences(x: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """Whether the block of ``s`` numbers at each place of ``at`` occurs ``s`` to ``2 s - 1`` further on: rows of ``s`` truths.

    ``x`` has 3 s numbers after each place.
    """
    window = x[at[:, None] + np.arange(s, 3 * s)]
    block = x[at[:, None] + np.arange(s)]
    if s < DIRECT:
        out = np.empty((len(at), s), bool)
        for d in range(s):
            diff = block - window[:, d : d + s]
            out[:, d] = (diff * diff).sum(1) == 0
        return out
    # numbers that blocks don't hold stand for themselves by their order, so that sums stay small
    low = min(int(block.min()), int(window.min()))
    most = max(int(block.max()), int(window.max())) - low
    zero, product = np.ones((len(at), s), bool), 1
    for p, g in PRIMES:
        a, b = ((v - low).astype(np.uint64) % np.uint64(p) for v in (block, window))
        q = np.uint64(p)
        padded = np.zeros((len(at), 2 * s), np.uint64)
        padded[:, 0] = a[:, 0]
        padded[:, s + 1 :] = a[:, :0:-1]  # the block reversed around 0: the product's place d is the sum over i of block i times window d + i
        cross = ntt(ntt(padded, p, g) * ntt(b, p, g) % q, p, g, True)[:, :s]
        own = (a * a % q).sum(1) % q
        sums = np.zeros((len(at), 2 * s + 1), np.uint64)
        np.cumsum(b * b % q, axis=1, out=sums[:, 1:])
        theirs = (sums[:, s : 2 * s] - sums[:, :s]) % q
        zero &= (own[:, None] + theirs) % q == 2 * cross % q
        product *= p
        if product > s * most * most:
            break
    return zero


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How far x[a:] and x[b:] agree, going up (step 1) or down from the places before them (step -1)."""
    n, size, done = len(x), 64, 0
    while True:
        room = n - max(a, b) - done if step > 0 else min(a, b) - done
        k = min(size, room)
        if k <= 0:
            return done
        u, v = (x[c + done : c + done + k] if step > 0 else x[c - done - k : c - done][::-1] for c in (a, b))
        differ = np.flatnonzero(u != v)
        if len(differ):
            return done + int(differ[0])
        done += k
        size = min(size * 2, 1 << 16)


class _Found:
    """Runs found so far, and for each place the one that holds it and reaches furthest."""

    def __init__(self, n: int):
        self.runs: set[tuple[int, int, int]] = set()
        self.until = np.zeros(n + 1, np.int64)  # where that run ends, and its period
        self.of = np.ones(n + 1, np.int64)

    def add(self, start: int, stop: int, period: int) -> None:
        self.runs.add((start, stop, period))
        longer = self.until[start:stop] < stop
        self.until[start:stop][longer] = stop
        self.of[start:stop][longer] = period

    def inside(self, at: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """Which stretches lie in one run with a period up to ``most``."""
        return (self.until[at] >= end) & (self.of[at] <= most)


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of numbers, by start and period.

    Numbers of different texts differ, and texts lie side by side.
    """
    n = len(x)
    if n < LEAST:
        return []
    order = np.argsort(x, kind="stable")
    again = np.full(n, n)
    same = x[order][1:] == x[order][:-1]
    again[order[:-1][same]] = order[1:][same] - order[:-1][same]
    found = _Found(n)
    s = 1
    # beyond the numbers, others that are all different
    longer = np.concatenate([x, np.arange(-1, -3 * n - 1, -1, dtype=x.dtype)])
    tops = again.copy()  # greatest distance to the next like number, by block
    while REPEATS * s <= n:
        if s > 1:
            tops = np.maximum(tops[0 : len(tops) - 1 : 2], tops[1::2])
        at = np.flatnonzero(tops[: n // s] < 2 * s) * s
        at = at[~found.inside(at, np.minimum(at + 3 * s, n), s)]
        rows = max(1, _BATCH // (4 * s))
        for i in range(0, len(at), rows):
            mine = at[i : i + rows]
            for b, d in zip(*np.nonzero(squared_differences(longer, mine, s))):
                _seeded(x, int(mine[b]), s, s + int(d), found)
        s *= 2
    return sorted((a, e - a, q) for a, e, q in found.runs)


def _seeded(x: np.ndarray, at: int, s: int, d: int, found: _Found) -> None:
    """Extends the occurrence of the block at ``at``, ``d`` further on, and keeps it if it is a run of least period d."""
    end = at + s + d
    if found.until[at] >= end and d % found.of[at] == 0:
        return
    right = _same(x, at + s, at + s + d, 1)
    left = _same(x, at, at + d, -1)
    start, stop = at - left, end + right
    if stop - start < max(LEAST, REPEATS * d) or (start, stop, d) in found.runs:
        return
    # by the periodicity lemma a smaller period divides d, and then d / p is a period for some prime p
    if not any(_same(x[: start + d + d // p], start, start + d // p, 1) >= d for p in _primes_of(d)):
        found.add(start, stop, d)


def _primes_of(d: int) -> list[int]:
    out, p = [], 2
    while p * p <= d:
        if d % p == 0:
            out.append(p)
            while d % p == 0:
                d //= p
        p += 1
    return out + [d] * (d > 1)


def edited(words: list, doc_id: int | None, every: int = 10) -> list:
    """The words as they are, or from some place on those of one stretch again and again, as crc32 of the id says."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % every or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def numbered(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, each text with its own, and where texts end."""
    out, next_ = [], 0
    for words in texts:
        codes = {w: i for i, w in enumerate(dict.fromkeys(words), next_)}
        next_ += len(codes)
        out.append(np.fromiter((codes[w] for w in words), np.int64, len(words)))
    return np.concatenate(out) if out else np.empty(0, np.int64), np.cumsum([len(t) for t in texts])


def described(words: list[bytes], mine: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of a text with its runs."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in mine).encode()
    if not mine:
        return 0, None, None, None, None, sha(lines), sha(b" ".join(words))
    best = mine[0]
    for r in mine[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return len(mine), *best, 1000 * best[1] // best[2], sha(lines), sha(b" ".join(collapsed(words, mine)))


def collapsed(words: list, mine: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for a, n, q in mine:
        step[a + q] += 1
        step[a + n] -= 1
    return [w for w, gone in zip(words, (np.cumsum(step[:-1]) > 0).tolist()) if not gone]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit=None) -> DataFrame:
    """A row for each document: doc_id, how many runs, the one of highest exponent, and hashes of all runs and of the text
    without repetitions. ``edit`` makes other words of (words, id) first. Nothing is shuffled."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def batches(it):
        for b in it:
            ids, texts, held, size = b.column("doc_id"), b.column("text").cast(pa.binary()), [], 0
            at = 0

            def made():
                x, ends = numbered(held)
                all_runs = runs(x)
                of = np.searchsorted(ends, [r[0] for r in all_runs], side="right")
                by_text: list[list] = [[] for _ in held]
                for i, (a, n, q) in zip(of.tolist(), all_runs):
                    by_text[i].append((a - (int(ends[i - 1]) if i else 0), n, q))
                cols = zip(*(described(w, r) for w, r in zip(held, by_text)))
                return pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(held)), *(pa.array(c, k) for c, k in zip(cols, _KINDS))], names=["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]
                )

            for t, i in zip(texts, ids):
                # bytes.split takes the same white space as the words' pattern
                w = (t.as_py() or b"").split()
                w = edit(w, i.as_py()) if edit else w
                if held and size + len(w) > _BATCH:
                    yield made()
                    at, held, size = at + len(held), [], 0
                held.append(w)
                size += len(w)
            if held:
                yield made()

    return chosen.mapInArrow(batches, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op13_periodic_runs(spark, sf_dir):
    """Runs of words in every whole text of documents, a tenth of them edited to hold one."""
    return periodic_runs(table(spark, sf_dir, "documents"), edit=edited)


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
