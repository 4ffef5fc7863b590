"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each i, the sum of x[j] * base**j for j < i, modulo a prime. The difference of two
entries, brought to a common power of the base, is the hash of the span between them; so any two spans are compared in
constant time, and the longest common extension of two places is found by binary search over its length. Two primes of
31 bits give 62 bits together. The prefix array of an edited text follows from those of its parts.

A fingerprint takes the hashes of all spans of ``SPAN`` code points (a shorter text is one span), deals them to ``BINS``
bins by their high bits and keeps 16 bits of the least of each bin: two fingerprints agree in about as many bins as
the sets of spans have in common.

Every document meets the next one by ascending id: documents are dealt into ranges of ids, each range also gets the
first document of the next, and each task reads its range in order with one document held back. Texts are shuffled once.

Edge cases: a null text is empty; an empty text has no spans, and is like another empty one alone; null ids come first;
rows of one id are ordered by their texts; a single row is its own next; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 914213)
SPAN, BINS = 24, 64
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2 for _ in PRIMES]


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo prime k, for i < n at least; tables double as longer texts come."""
    p = PRIMES[k]
    while len(_powers[k][0]) < n:
        for i, b in enumerate((BASES[k], pow(BASES[k], -1, p))):
            have = _powers[k][i]
            _powers[k][i] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
    return _powers[k][0], _powers[k][1]


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.n = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        out = []
        for k, p in enumerate(PRIMES):
            a = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * _power(k, len(x))[0][: len(x)] % np.uint64(p), out=a[1:])
            out.append(a % np.uint64(p))
        return cls(out)

    def joined(self, a: int, other: PrefixHashes, b: int) -> PrefixHashes:
        """Prefix arrays of the first ``a`` code points of this text and then the first ``b`` of the other."""
        out = []
        for k, p in enumerate(PRIMES):
            shift = _power(k, a + 1)[0][a]
            out.append(np.concatenate([self.arrays[k][: a + 1], (self.arrays[k][a] + other.arrays[k][1 : b + 1] * shift) % np.uint64(p)]))
        return PrefixHashes(out)

    def spans(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of ``length`` code points, by start."""
        out = np.zeros(max(0, self.n - length + 1), np.uint64)
        for k, p in enumerate(PRIMES):
            a, p = self.arrays[k], np.uint64(p)
            h = (a[length:] + p - a[: len(out)]) % p * _power(k, len(out))[1][: len(out)] % p
            out = out << np.uint64(31) | h
        return out

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hashes of the span from i to j."""
        return tuple(
            (int(self.arrays[k][j]) - int(self.arrays[k][i])) % p * int(_power(k, i + 1)[1][i]) % p for k, p in enumerate(PRIMES)
        )

    def common(self, i: int, other: PrefixHashes, j: int) -> int:
        """Longest common extension of place i here and place j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def bins(self) -> np.ndarray:
        """16 bits of the least hash of each bin, 0 for an empty bin."""
        h = self.spans(min(SPAN, self.n)) if self.n else np.empty(0, np.uint64)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.full(BINS, ~np.uint64(0))
        np.minimum.at(least, (h >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64), h)
        low = np.maximum(least & np.uint64(0xFFFF), np.uint64(1))
        return np.where(least == ~np.uint64(0), np.uint64(0), low).astype(np.uint16)


def fingerprint(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either uses; two without spans are alike."""
    used = (a > 0) | (b > 0)
    n = int(np.count_nonzero(used))
    return float(np.count_nonzero((a == b) & used) / n) if n else 1.0


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges (bucket); the rows of a range's first id also stand, with head, in the range before."""
    parts = partitions(docs.sparkSession)
    ids = docs.select("doc_id")
    # several ranges to a partition, as ranges are dealt to partitions by hash: their sums are more even
    ranged = ids.where("doc_id is not null").repartitionByRange(4 * parts, "doc_id")
    # one row for each range
    heads = sorted(r[0] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("doc_id")).select("min(doc_id)").collect())
    first_null = not ids.where("doc_id is null").isEmpty()
    if first_null:
        heads = [None] + heads[1:]
    n = max(1, len(heads))
    keys = heads[1:]

    def batches(it):
        head_of = {h: i for i, h in enumerate(heads)}
        for b in it:
            of = b.column("doc_id").to_pylist()
            bucket = [0 if i is None else bisect.bisect_right(keys, i) for i in of]
            again = [k for k, i in enumerate(of) if i in head_of]
            rows = pa.array(list(range(len(of))) + again, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(rows), b.column("text").take(rows),
                    pa.array(bucket + [(head_of[of[k]] - 1) % n for k in again], pa.int32()),
                    pa.array([False] * len(of) + [True] * len(again)),
                ],
                names=["doc_id", "text", "bucket", "head"],
            )

    dealt = docs.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, bucket int, head boolean")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "head", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """A row for each document: the fingerprints of its text and of its edited text, and their likenesses.

    The edited text has the last 1/share of the code points replaced by as many first ones of the next document.
    lce_edited and lce_next are the code points that the text shares with either from the start on.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    of = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {of}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited long, lce_next long"

    def batches(it):
        id_type = None
        held = None  # the document before: (bucket, id, text, prefix hashes, bins)
        for b in it:
            id_type = id_type or b.column("doc_id").type
            out = []
            for bucket, head, i, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "head", "doc_id", "text"))):
                if held and held[0] != bucket:
                    held = None
                if head and held is None:
                    continue  # another row of the next range's first id
                hashes = PrefixHashes.of(t)
                bins = hashes.bins()
                if held:
                    _, own_id, own, mine, my_bins = held
                    n = mine.n
                    m = n // share
                    edited = mine.joined(n - m, hashes, min(m, hashes.n))
                    edited_bins = edited.bins()
                    sha = hashlib.sha256((own[: n - m] + t[:m]).encode()).hexdigest()
                    out.append(
                        (own_id, n, sha, fingerprint(my_bins), fingerprint(edited_bins), likeness(my_bins, edited_bins), likeness(my_bins, bins),
                         mine.common(0, edited, 0), mine.common(0, hashes, 0))
                    )
                held = None if head else (bucket, i, t, hashes, bins)
            cols = list(zip(*out)) or [()] * 9
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return _with_next(chosen).mapInArrow(batches, schema)


def op5_fingerprints(spark, sf_dir):
    """Fingerprints of every whole text of documents and of its edited text."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
