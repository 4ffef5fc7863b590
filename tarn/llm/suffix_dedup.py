"""Suffix-array dedup: removal of every byte that a repeated string of ``LENGTH`` bytes covers.

A suffix order of the whole corpus is never held in one place. The work is cut so that each piece can be ordered alone:

1. Equal texts are folded into one with a count (before the shuffle), and written bucketed by their key, so that the
   later joins with texts don't shuffle texts again.
2. Each window of LENGTH bytes has an anchor: the least hash among its GRAM-byte strings, the leftmost of equals. Equal
   windows have equal anchors at equal offsets, so a window that repeats stands at an anchor that repeats. Anchors are
   counted over the whole corpus; only those found twice go on.
3. Around each repeated anchor the string that holds all windows of this anchor is cut out: a segment. Equal segments
   are folded again, with a count. All segments of an anchor meet in one task, a few at a time.
4. Their suffixes are ordered column by column (see ``Collection``): one symbol of each segment is inserted per round,
   from the right, and the Burrows-Wheeler transform and the longest common prefixes are updated. Windows whose suffix
   has a neighbour with a common prefix of LENGTH bytes repeat, as do all windows of a segment that occurs twice.
5. The repeated windows are joined back to the texts, whose covered bytes are removed.

Segments of an anchor with over ``hot_rows`` places (a passage that many documents share) don't meet in one task: there
each window is an anchor of its own, keyed by 128 bits of hash of its LENGTH bytes, and counted.

Edge cases: a null text is empty; texts under LENGTH bytes lose nothing; copies of a longer text lose everything;
repeated rows are copies of each other; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, plain_names, saved, shared_dir, table, tidy

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1  # grams in a window
#: Texts are hashed in blocks of so many bytes that overlap by a window.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(BLOCK + LENGTH, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def window_anchors(x: np.ndarray, ends: np.ndarray):
    """Anchors of the windows of concatenated texts ``x`` (at most BLOCK + LENGTH bytes); ``ends`` are the texts' ends.

    Returns (first, last, anchor, hash) of each run of windows with one anchor. No window crosses the end of a text.
    """
    up, down = _powers()
    n = len(x)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = (prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = REACH - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & low).astype(np.int64)
    starts = np.arange(len(at))
    of = np.searchsorted(ends, starts, side="right")
    inside = starts + LENGTH <= ends[of]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    return first, last, at[first], h[at[first]]


def _blocks(texts: list[bytes]):
    """(owner, offset, bytes) pieces of at most BLOCK + LENGTH bytes; long texts are cut with an overlap."""
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            yield i, at, t[at : at + BLOCK + LENGTH - 1]


def text_anchors(texts: list[bytes]):
    """Yields (owner, first, last, anchor, hash) arrays; positions count from the owner's start."""
    held, total = [], 0

    def flush():
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        first, last, at, h = window_anchors(x, ends)
        piece = np.searchsorted(ends, first, side="right")
        shift = np.array([o for _, o, _ in held]) - (ends - sizes)
        owner = np.array([i for i, _, _ in held])[piece]
        s = shift[piece]
        return owner, first + s, last + s, at + s, h

    for piece in _blocks(texts):
        if len(piece[2]) < LENGTH:
            continue
        if total + len(piece[2]) > BLOCK + LENGTH:
            yield flush()
            held, total = [], 0
        held.append(piece)
        total += len(piece[2])
    if held:
        yield flush()


class Collection:
    """Burrows-Wheeler transform and common prefixes of a collection, built column by column.

    A symbol is ``width`` bytes, so a string is inserted once for each of its ``width`` phases and a window of LENGTH
    bytes is LENGTH / width symbols of one of them. ``bwt[i]`` is the symbol before suffix i in sorted order (0: none),
    ``lcp[i]`` the symbols it shares with suffix i - 1. A round reads both in order, ranks the symbols to insert by one
    stable sort, and writes both anew with the new suffixes in their places.
    """

    def __init__(self, strings: list[bytes], width: int = 8):
        self.width = width
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
        grams = np.zeros(len(x) - width, np.uint64)
        for i in range(width):
            grams |= x[i : i + len(grams)].astype(np.uint64) << np.uint64(8 * i)
        values, code = np.unique(grams, return_inverse=True)
        code = (code + 1).astype(np.uint16 if len(values) < 65535 else np.uint32)
        # phase r of string s: symbols at begin + r, begin + r + width, ...; column k counts from its right end
        owner = np.repeat(np.arange(len(strings)), width)
        phase = np.tile(np.arange(width), len(strings))
        begin = (ends - sizes)[owner] + phase
        self.length = (sizes[owner] - phase) // width
        self.owner, self.phase = owner, phase
        most = int(self.length.max())
        last = begin + (self.length - 1) * width
        column = np.arange(most + 1)
        at = last[:, None] - column[None, :] * width
        inside = column[None, :] < self.length[:, None]
        self.symbols = np.where(inside, code[np.where(inside, at, 0)], 0).astype(code.dtype)
        self._insert(most)

    def _insert(self, most: int) -> None:
        m = len(self.owner)
        bwt, lcp = self.symbols[:, 0].copy(), np.zeros(m, np.uint8)
        pos = np.arange(m)
        active = np.arange(m)
        for k in range(1, most + 1):
            active = active[self.length[active] >= k]
            if not len(active):
                break
            order = np.argsort(bwt, kind="stable")
            done = len(bwt) - int(np.count_nonzero(bwt))
            to = np.empty(len(bwt), np.int64)  # where the suffix longer by the symbol before it stands
            to[order[done:]] = m + np.arange(len(bwt) - done)
            new = to[pos[active]]
            grown = np.zeros(len(bwt) + len(active), bool)
            grown[new] = True
            old = ~grown
            nxt = np.empty(len(grown), bwt.dtype)
            nxt[old] = bwt
            nxt[new] = self.symbols[active, k]
            common = np.empty(len(grown), np.uint8)
            common[old] = lcp
            # common prefixes change at the new suffixes and at the ones after them
            x = np.concatenate([new, new + 1])
            x = x[(x < len(grown)) & (x > m)]
            q, p = order[done + x - 1 - m], order[done + x - m]
            same = bwt[q] == bwt[p]
            common[x[~same]] = 0
            common[new[new == m]] = 0
            q, p, x = q[same], p[same], x[same]
            common[x] = np.minimum(_range_min(lcp, q + 1, p), 254) + 1
            pos[active] = new
            bwt, lcp = nxt, common
        self.bwt, self.lcp = bwt, lcp

    def repeated(self) -> list[np.ndarray]:
        """For each string, which of its windows of LENGTH bytes stand elsewhere too, in this or another string."""
        need = LENGTH // self.width
        bwt, m = self.bwt, len(self.owner)
        order = np.argsort(bwt, kind="stable")
        done = len(bwt) - int(np.count_nonzero(bwt))
        to = np.empty(len(bwt), np.int64)
        to[order[done:]] = m + np.arange(len(bwt) - done)
        twin = self.lcp >= need
        twin[:-1] |= self.lcp[1:] >= need
        count = np.bincount(self.owner, weights=np.maximum(self.length - need + 1, 0)).astype(np.int64)
        out = [np.zeros(c, bool) for c in count]
        flat = np.concatenate(out)
        at = np.cumsum(count) - count
        live, pos = np.arange(m), np.arange(m)
        for k in range(1, int(self.length.max()) + 1):
            go = self.length[live] >= k
            live, pos = live[go], to[pos[go]]
            if k >= need:
                hit = twin[pos]
                s = live[hit]
                flat[at[self.owner[s]] + self.phase[s] + (self.length[s] - k) * self.width] = True
        return np.split(flat, np.cumsum(count)[:-1])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], both ends included, by a table of minima over spans of powers of two."""
    if not len(lo):
        return np.empty(0, values.dtype)
    levels = [values]
    longest = int((hi - lo).max()) + 1
    size = 1
    while size * 2 <= longest:
        v = levels[-1]
        up = v.copy()
        np.minimum(v[:-size], v[size:], out=up[:-size])
        levels.append(up)
        size *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    grid = np.stack(levels)
    return np.minimum(grid[level, lo], grid[level, hi - (1 << level) + 1])


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of each run of True, ends exclusive, as a flat array."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.astype(np.int32)


def _key(text_col):
    sha = F.sha2(text_col, 256)
    part = lambda a, b: F.conv(F.substring(sha, a, b), 16, 10).cast("long")
    return part(1, 15).alias("k1"), part(16, 9).alias("k2")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, body, copies): each distinct text once, bucketed by its key of 96 bits of SHA-256."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(body.alias("body")).select(*_key(F.col("body")), "body")
    folded = chosen.groupBy("k1", "k2").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    name = f"tarn_texts_{uuid.uuid4().hex}"
    with tidy(spark):
        (
            folded.write.bucketBy(partitions(spark), "k1", "k2")
            .sortBy("k1", "k2")
            .option("path", f"{shared_dir(spark)}/{name}")
            .option("compression", "zstd")
            .saveAsTable(name)
        )
    return spark.table(name)


def _anchors(texts: DataFrame) -> DataFrame:
    """(h, k1, k2, place): place packs the anchor's position, the windows before it and their number less one."""

    def batches(it):
        for b in it:
            bodies = b.column("body").cast(pa.binary()).to_pylist()
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for owner, first, last, at, h in text_anchors(bodies):
                place = (at << 16) | ((at - first) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(place)], names=["h", "k1", "k2", "place"]
                )

    return texts.select("k1", "k2", "body").mapInArrow(batches, "h long, k1 long, k2 long, place long")


def _segments(joined: DataFrame) -> DataFrame:
    """From texts with their repeated anchors: each place of a segment, and at its first place in the batch its bytes
    and the weight (documents, copies included) of all its places in the batch.

    ``hot`` anchors give a row for each window instead, without bytes.
    """
    schema = "h long, s1 long, s2 long, weight long, bytes binary, k1 long, k2 long, first long, hot boolean"

    def batches(it):
        for b in it:
            cols = {n: [] for n in ("h", "s1", "s2", "weight", "bytes", "k1", "k2", "first", "hot")}
            seen: dict[bytes, int] = {}
            held = 0

            def rows():
                made = pa.RecordBatch.from_arrays(
                    [pa.array(cols[n], pa.int64()) for n in ("h", "s1", "s2", "weight")]
                    + [pa.array(cols["bytes"], pa.binary())]
                    + [pa.array(cols[n], pa.int64()) for n in ("k1", "k2", "first")]
                    + [pa.array(cols["hot"], pa.bool_())],
                    names=list(cols),
                )
                for c in cols.values():
                    c.clear()
                seen.clear()
                return made

            def add(*row):
                for c, v in zip(cols.values(), row):
                    c.append(v)

            bodies = b.column("body").cast(pa.binary()).to_pylist()
            copies, places = b.column("copies").to_pylist(), b.column("places").to_pylist()
            for text, c, k1, k2, where in zip(bodies, copies, b.column("k1").to_pylist(), b.column("k2").to_pylist(), places):
                for x in where:
                    h, place = x["h"], x["place"]
                    at = place >> 16
                    first = at - ((place >> 8) & 255)
                    n = (place & 255) + 1
                    if x["hot"]:
                        for p in range(first, first + n):
                            d = xxhash.xxh128_digest(text[p : p + LENGTH])
                            s1, s2 = (int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))
                            add(h, s1, s2, c, None, k1, k2, p, True)
                    else:
                        s = text[first : first + n + LENGTH - 1]
                        d = xxhash.xxh128_digest(s)
                        s1, s2 = (int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))
                        if d in seen:
                            cols["weight"][seen[d]] += c
                            add(h, s1, s2, 0, None, k1, k2, first, False)
                        else:
                            seen[d] = len(cols["h"])
                            add(h, s1, s2, c, s, k1, k2, first, False)
                            held += len(s)
                if held > 8_000_000 or len(cols["h"]) > 100_000:
                    yield rows()
                    held = 0
            if cols["h"]:
                yield rows()

    return joined.mapInArrow(batches, schema)


def _order(groups: DataFrame) -> DataFrame:
    """From segments sorted by anchor, with their weights: the runs of repeated windows of each distinct segment."""

    def batches(it):
        out: list[tuple[int, int, bytes]] = []
        pending: list[tuple[list, list, list]] = []  # anchors that wait for one collection
        size = 0

        def emit(found, key, count):
            runs = _runs(np.ones(len(found), bool) if count > 1 else found)
            if len(runs):
                out.append((*key, runs.tobytes()))

        def close(group):
            nonlocal size
            if not group:
                return
            counts = [g[1] for g in group.values()]
            single = [(k, g[0]) for k, g in group.items() if g[1] == 1]
            for k, g in group.items():
                if g[1] > 1:
                    emit(np.zeros(len(g[0]) - LENGTH + 1, bool), k, g[1])
            if single and len(group) > 1:
                # segments with a count take part, so that others find them; their own windows are settled
                pending.append(([g[0] for g in group.values()], list(group), counts))
                size += sum(len(g[0]) for g in group.values())

        def flush():
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["s1", "s2", "runs"],
            )

        def settle():
            nonlocal pending, size
            strings = [s for g in pending for s in g[0]]
            if strings:
                keys, counts = ([k for g in pending for k in g[i]] for i in (1, 2))
                for found, key, c in zip(Collection(strings).repeated(), keys, counts):
                    if c == 1:
                        emit(found, key, 1)
            pending, size = [], 0

        at, group = None, {}
        for b in it:
            for h, s1, s2, s, c in zip(*(b.column(n).to_pylist() for n in ("h", "s1", "s2", "bytes", "weight"))):
                if h != at:
                    close(group)
                    if size >= 60_000:
                        settle()
                    if len(out) > 20_000:
                        yield flush()
                    at, group = h, {}
                group[s1, s2] = (s, c + group[s1, s2][1] if (s1, s2) in group else c)
        close(group)
        settle()
        if out:
            yield flush()

    return groups.mapInArrow(batches, "s1 long, s2 long, runs binary")


def repeated_spans(texts: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """(k1, k2, spans): for each distinct text the repeated windows, as an array of (first, runs)."""
    anchors = saved(_anchors(texts))
    # a table, so that Spark can split the rows of a common anchor in the join
    twice = saved(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    # an anchor of one text counts twice too if the text has copies, but copies are settled without it
    places = anchors.join(twice, "h").select("k1", "k2", F.struct("h", "place", (F.col("n") > hot_rows).alias("hot")).alias("x"))
    by_text = places.groupBy("k1", "k2").agg(F.collect_list("x").alias("places"))
    cut = saved(_segments(texts.join(by_text, ["k1", "k2"])))
    strings = cut.where("bytes is not null").select("h", "s1", "s2", "bytes", "weight")
    found = _order(strings.repartition("h").sortWithinPartitions("h"))
    spans = cut.where("not hot").join(found, ["s1", "s2"]).select("k1", "k2", F.struct("first", "runs").alias("x"))
    one = F.unhex(F.lit("0000000001000000"))
    windows = cut.where("hot")
    # a table, so that Spark can split the rows of a common window in the join
    often = saved(windows.groupBy("s1", "s2").agg(F.sum("weight").alias("n")).where("n > 1").select("s1", "s2"))
    hot = windows.join(often, ["s1", "s2"], "left_semi")
    spans = spans.unionByName(hot.select("k1", "k2", F.struct("first", one.alias("runs")).alias("x")))
    return spans.groupBy("k1", "k2").agg(F.collect_list("x").alias("spans"))


def covered(n: int, copies: int, spans) -> np.ndarray:
    """Which of a text's ``n`` bytes lie in a repeated window."""
    if copies > 1 and n >= LENGTH:
        return np.ones(n, bool)
    step = np.zeros(n + 1, np.int64)
    for x in spans or ():
        runs = np.frombuffer(x["runs"], np.int32).astype(np.int64) + x["first"]
        np.add.at(step, runs[0::2], 1)
        np.add.at(step, runs[1::2] + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def dedup_texts(texts: DataFrame, with_text: bool) -> DataFrame:
    """For each distinct text (k1, k2): n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text kept."""
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    joined = texts.join(repeated_spans(texts), ["k1", "k2"], "left")

    def batches(it):
        for b in it:
            rows = []
            for t, copies, spans in zip(b.column("body").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist(), b.column("spans").to_pylist()):
                gone = covered(len(t), copies, spans)
                n = int(np.count_nonzero(gone))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if n else t
                row = (len(t), n, len(_runs(gone)) // 2, hashlib.sha256(kept).hexdigest())
                # a removed run can cut a character: its bytes that stay are no text
                rows.append(row + (kept.decode("utf-8", "ignore"),) * with_text)
            cols = list(zip(*rows)) or [()] * (4 + with_text)
            types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2")] + [pa.array(c, t) for c, t in zip(cols, types)],
                names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text,
            )

    return joined.mapInArrow(batches, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    found = dedup_texts(distinct_texts(docs, text_col), False)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select("doc_id", *_key(F.col("body")))
    return ids.join(found, ["k1", "k2"]).drop("k1", "k2")


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each text without its repeated bytes; a text that loses nothing stays as it is."""
    columns, docs = docs.columns, plain_names(docs)
    found = dedup_texts(distinct_texts(docs, text_col), True).where("n_removed > 0").select("k1", "k2", "kept")
    keys = _key(F.coalesce(F.col(text_col), F.lit("")))
    inner = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(found, ["k1", "k2"], "left")
    return inner.select(
        *[(F.coalesce("kept", F.col("row")[c]) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    ).toDF(*columns)


def op1_suffix_dedup(spark, sf_dir):
    """What repeated strings of 200 bytes leave of every whole text of documents."""
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
