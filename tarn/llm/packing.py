"""Best-fit packing of token sequences by linear grouping.

Documents become token ids; longer ones than a sequence are cut. Only the number of pieces of each length is needed to
plan, and lengths are at most ``capacity``, so the plan is made from a table of at most ``capacity`` rows:

1. Large lengths are sorted down and cut into groups of equal cardinality; each length is rounded up to the largest of
   its group, which leaves few sizes.
2. Configurations of these sizes are chosen one after another: the largest size left, completed to the fullest sequence
   that the sizes left allow (an exact subset-sum table), as many times over as they last.
3. The actual pieces take the places of the rounded ones in order, which frees what rounding had added.
4. Small lengths, from the largest down, go to the fullest sequences that still hold them, then to new ones.

All steps handle runs of like sequences at once, so the plan's size depends on ``capacity`` and the number of groups,
not on the number of pieces. Each piece finds its place by its length and its rank among the pieces of that length.
Ranks are counted in slices: a length that half of all pieces share is still counted by many tasks.

Edge cases: a null or empty text is one piece with the end id alone; repeated rows are packed each; an empty table gives
an empty result; only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, table

CAPACITY, END_ID = 1024, 2
#: Numbers of groups that are tried; the plan with the fewest sequences is taken.
GROUPS = (128, 256, 512, 1024)
#: The words of this kind of byte-level vocabulary, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters are encoded by the tokenizers library: what counts as a letter depends on the version of
#: Unicode there, while for these characters all versions agree.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level vocabulary file of the tokenizers library.

    Texts of common characters are encoded by tiktoken with the same vocabulary, which gives the same ids several times
    faster; all others by tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        # byte-level vocabularies write each byte as a printable character: itself, or the next free one from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if not _PLAIN.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its patterns give up on very long runs of white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's whole text; only the first piece may be shorter."""
    vocabulary = vocabulary or default_vocabulary()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def batches(it):
        encode = None
        for b in it:
            encode = encode or Encoder(vocabulary)
            of, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(t), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                lo, hi, k = 0, first, 0
                while lo < len(ids):
                    of.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    lo, hi, k = hi, hi + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return chosen.mapInArrow(batches, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """Pieces of one length with ranks from ``rank`` on go to as many sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def group_sizes(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping of the lengths over ``least``: (rounded size, [(length, pieces)]) of groups of equal cardinality."""
    lengths = [(n, int(counts[n])) for n in range(len(counts) - 1, least, -1) if counts[n]]
    total = sum(c for _, c in lengths)
    size = -(-total // groups) if total else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for n, c in lengths:
        while c:
            if not room:
                out.append((n, []))
                room = size
            take = min(c, room)
            out[-1][1].append((n, take))
            c -= take
            room -= take
    # groups of one rounded size are one size
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for n, items in out:
        if merged and merged[-1][0] == n:
            merged[-1][1].extend(items)
        else:
            merged.append((n, items))
    return merged


def configurations(sizes: list[int], counts: list[int], capacity: int):
    """Yields (configuration, times): how many of each size one sequence holds, until no size is left."""
    left = list(counts)
    while any(left):
        head = next(i for i, c in enumerate(left) if c)
        room = capacity - sizes[head]
        # reach[w]: how many of which size was last added to come to w exactly; larger sizes first
        reach: dict[int, tuple[int, int, int]] = {0: (-1, 0, 0)}
        full = False
        for i in range(head, len(sizes)):
            spare = left[i] - (i == head)
            if not spare or full:
                continue
            for w in list(reach):
                v, k = w + sizes[i], 1
                while v <= room and k <= spare and v not in reach:
                    reach[v] = (i, k, w)
                    full |= v == room
                    v, k = v + sizes[i], k + 1
        w = max(reach)
        config = {head: 1}
        while w:
            i, k, before = reach[w]
            config[i] = config.get(i, 0) + k
            w = before
        times = min(left[i] // k for i, k in config.items())
        for i, k in config.items():
            left[i] -= k * times
        yield config, times


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 1024, small_share: float = 0.125) -> tuple[list[Run], int]:
    """Runs that place ``counts[n]`` pieces of each length n, and the number of sequences."""
    small = int(capacity * small_share)
    used = np.zeros(len(counts), np.int64)  # ranks given so far, by length
    runs: list[Run] = []
    grouped = group_sizes(counts, small, groups)
    sizes = [n for n, _ in grouped]
    stock = [list(reversed(items)) for _, items in grouped]
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    made = 0

    def put(length, count, sequence, offset):
        runs.append(Run(length, int(used[length]), count, sequence, offset))
        used[length] += count

    for config, times in configurations(sizes, [sum(c for _, c in items) for _, items in grouped], capacity):
        parts = [(made, times, 0)]  # (first sequence, sequences, filled): like sequences
        for i, k in sorted(config.items()):
            for _ in range(k):
                split = []
                for first, n, filled in parts:
                    while n:
                        length, c = stock[i][-1]
                        take = min(n, c)
                        put(length, take, first, filled)
                        split.append((first, take, filled + length))
                        stock[i][-1] = (length, c - take)
                        if c == take:
                            stock[i].pop()
                        first, n = first + take, n - take
                parts = split
        for first, n, filled in parts:
            gaps.setdefault(capacity - filled, []).append((first, n))
        made += times
    rooms = sorted(gaps)
    heapq.heapify(rooms)
    volume = sum(int(counts[n]) * n for n in range(1, small + 1))
    open_rooms = set(gaps)

    def keep(room, first, n):
        gaps.setdefault(room, []).append((first, n))
        open_rooms.add(room)

    for length in range(min(small, len(counts) - 1), 0, -1):
        n = int(counts[length])
        volume -= n * length
        while n:
            fit = [r for r in range(length, capacity + 1) if r in open_rooms]
            if not fit:
                more = max(1, -(-(n * length + volume) // capacity))
                keep(capacity, made, more)
                made += more
                continue
            room = fit[0]
            first, have = gaps[room].pop()
            if not gaps[room]:
                open_rooms.discard(room)
            take = min(n, have)
            put(length, take, first, capacity - room)
            if take < have:
                keep(room, first + take, have - take)
            keep(room - length, first, take)
            n -= take
    return runs, made


def _ranked(found: DataFrame, slices: int) -> DataFrame:
    """Adds rank: each piece's number among those of its length. Slices of a length are ranked apart and then shifted."""
    cut = found.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)))
    sums = cut.groupBy("length", "__slice").count()
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # a length has at most ``slices`` rows here
    shift = sums.select("length", "__slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        cut.withColumn("__rank", F.row_number().over(within) - 1)
        .join(shift, ["length", "__slice"])
        .withColumn("rank", F.col("__rank") + F.col("__shift"))
        .drop("__slice", "__rank", "__shift")
    )


def best_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[Run]:
    """The plan with the fewest sequences among a few numbers of groups and limits of what counts as small."""
    return min((plan(counts, capacity, g, s) for g in groups for s in (0.03, 0.06, 0.09, 0.125, 0.15)), key=lambda x: x[1])[0]


def pack(found: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = found.sparkSession
    found = saved(found)
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    runs = best_plan(counts, capacity, groups)
    runs.sort(key=lambda r: (r.length, r.rank))
    cols = [np.array([getattr(r, n) for r in runs], np.int64) for n in ("length", "rank", "sequence", "offset")]
    shared = spark.sparkContext.broadcast(cols)  # its size depends on capacity and groups alone

    def batches(it):
        length, rank, sequence, offset = shared.value
        key = length << 40 | rank
        for b in it:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, n << 40 | r, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(sequence[i] + r - rank[i]), pa.array(offset[i])], names=[*names, "sequence_id", "offset"]
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    of = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {of}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return _ranked(found, 4 * partitions(spark)).select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(batches, schema)


def op8_packing(spark, sf_dir):
    """All documents as token pieces in sequences of at most 1024 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))


QUERIES = {"op8_packing": op8_packing}
