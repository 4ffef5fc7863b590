"""Lower-cased words of texts as arrays: their bounds and 64-bit hashes, for many texts at once.

A word is a run of digits, letters a to z and characters beyond ASCII; only A-Z are lower-cased. Texts go through numpy in
blocks of a fixed size, so memory follows the longest text and never its longest word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that belong to words once a text is lower-cased.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BLOCK = 1 << 18
_TEXTS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_BLOCK, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words by turns, and the hash of each word; a hash is a polynomial in the word's bytes."""
    up, down = _powers()
    last, carry, scale, back = False, 0, 1, 1
    at, before, inverse = [], [], []
    for a in range(0, len(x), _BLOCK):
        part = x[a : a + _BLOCK]
        inside = WORD_BYTE[part]
        turn = np.flatnonzero(np.concatenate(([inside[0] != last], inside[1:] != inside[:-1])))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        at.append(turn + a)
        before.append(np.uint64(carry) + sums[turn] * np.uint64(scale))
        inverse.append(down[turn] * np.uint64(back))
        last = bool(inside[-1])
        carry = (carry + int(sums[-1]) * scale) & _MASK
        scale = scale * int(up[-1]) * _BASE & _MASK
        back = back * int(down[-1]) * pow(_BASE, -1, 1 << 64) & _MASK
    if last:
        at.append(np.array([len(x)]))
        before.append(np.array([carry], np.uint64))
        inverse.append(np.ones(1, np.uint64))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edges, sums, back_ = np.concatenate(at), np.concatenate(before), np.concatenate(inverse)
    return edges, mixed((sums[1::2] - sums[0::2]) * back_[0::2])


@dataclass
class Words:
    """Words of some consecutive texts: those of text i are ``bounds[i]`` to ``bounds[i + 1]``."""

    first: int
    buffer: bytes
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def between(self, a: int, b: int) -> str:
        """Words a to b, joined by one space."""
        return b" ".join([self.buffer[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]).decode("utf-8", "replace")


def words(texts: list[bytes | None]) -> Iterator[Words]:
    """The words of all texts in order, of some megabytes or one long text at a time; a null text has none."""
    held: list[bytes] = []
    size = first = 0

    def made() -> Words:
        buffer = b"\n".join(held).lower()
        ends = np.cumsum([len(t) + 1 for t in held])
        edges, h = _edges(np.frombuffer(buffer, np.uint8))
        start, end = edges[0::2], edges[1::2]
        return Words(first, buffer, np.concatenate(([0], np.searchsorted(start, ends))), start, end, h)

    for t in texts:
        t = t or b""
        if held and size + len(t) > _TEXTS:
            yield made()
            first += len(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield made()


def text_bytes(column) -> list[bytes | None]:
    """An Arrow column of strings as UTF-8."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of ``k`` words within one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + w.hash[j : j + n]
    stop = np.repeat(w.bounds[1:], w.counts())
    at = np.flatnonzero(np.arange(n) + k <= stop[:n])
    return at, mixed(h[at])


class Cells:
    """A bit for each of 2**power cells: whether one of a table's 64-bit hashes falls there. It lets through some others,
    which a join turns away later; its size follows the table's rows up to a bound of 64 MB."""

    MOST = 29
    PIECE = 1 << 16

    def __init__(self, power: int, bits: np.ndarray):
        self.power, self.bits = power, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        cell = h >> np.uint64(64 - self.power)
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    @classmethod
    def of(cls, hashes, column: str = "h") -> "Cells":
        """From a DataFrame of hashes. Pieces of 8 kB are made in Spark; at most 8,192 of them come to the driver."""
        import pyarrow as pa
        from pyspark.sql import functions as F

        power = min(cls.MOST, max(16, (16 * max(1, hashes.count())).bit_length()))
        cell = F.shiftrightunsigned(F.col(column), 64 - power)

        def piece_of(t: pa.Table) -> pa.Table:
            bits = np.zeros(cls.PIECE, np.uint8)
            bits[t.column("cell").to_numpy() % cls.PIECE] = 1
            return pa.table({"piece": t.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        cells = hashes.select(cell.alias("cell")).distinct().withColumn("piece", (F.col("cell") / cls.PIECE).cast("long"))
        bits = np.zeros((1 << power) // 8, np.uint8)
        for r in cells.groupBy("piece").applyInArrow(piece_of, "piece long, bits binary").collect():
            bits[r["piece"] * (cls.PIECE // 8) : (r["piece"] + 1) * (cls.PIECE // 8)] = np.frombuffer(r["bits"], np.uint8)
        return cls(power, bits)
