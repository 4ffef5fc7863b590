"""Language-model scores from a hierarchical Pitman-Yor model.

A token's restaurant is that of the token before it (or of a text's beginning). All these restaurants share one parent,
that of single tokens, whose base is uniform over the known tokens and one unknown; every customer of the parent is a
table of a child. Seatings are sampled by Gibbs: given all others, a dish's customers in a restaurant are seated anew.
Only the number of their tables matters to a prediction, so that is what is drawn, from its exact distribution: with c
customers, t tables have the weight S(c, t) * prod_{k<t} (strength + discount * (T + k)) * P^t, with generalised Stirling
numbers S (the seatings of c customers at t tables), T the tables of the restaurant's other dishes and P the parent's
probability. Above ``EXACT`` customers the same distribution is drawn from by its saddle point. The chain's state (tables
of every dish in every restaurant) goes from pass to pass; probabilities are averaged over several of its states.

How it spreads over a cluster: pairs of tokens (cells) are dealt by the later token, so that all customers of one dish
meet in one block: a bucket of tokens. Each block then needs the customers and tables of the restaurants that its cells
stand in. Blocks send their sums by restaurant to ranges of restaurants, where they are added up and sent back: one
shuffle of packed arrays each way and pass, of a size that grows with the data. The restaurants of a pass are sampled
side by side, given the totals of the pass before.

Tokens that would make a block large (a share above 1 / (2 * buckets); so their number is bounded by that of buckets) are
dealt by the pair instead, over as many blocks as their share asks for; their tables in these blocks are added up from
pass to pass. Pairs that would make a block large
go to their block as counts alone; where they stand in texts stays with the texts, and their probabilities (at most as
many as 4 * buckets) are sent there.

Tokens are told apart by 64-bit hashes, restaurants by 40 bits of theirs.

Edge cases: a null or empty text has one token, its end; null ids count as the empty string for the hold-out; an empty
table gives an empty result; repeated rows each count and return a row; only the named columns are read.
"""

from __future__ import annotations

import io
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, shared_dir, table, tidy

END, BEGIN = np.uint64(1), np.uint64(2)
#: Documents and bytes of a batch; a document's place in its batch fits 15 bits.
BATCH, BATCH_BYTES = 1024, 4 << 20
#: Bytes that are split into tokens at once.
CHUNK = 1 << 18
#: Blocks of tokens are so much smaller than a shuffle partition, as a sampler holds its block several times over.
BLOCKS_PER_PARTITION = 4
#: Batches whose sums a task holds before it sends them on.
HELD = 250
#: Rows of texts, blocks and sums that a worker is given at once.
ARROW_ROWS = 16
#: Cells with more customers draw their tables by the saddle point.
EXACT = 64

_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
_LOW = np.uint64(32)


@dataclass(frozen=True)
class Model:
    strength: float = 1.0
    sweeps: int = 2  # of each pass
    samples: int = 3  # states of the chain that probabilities are averaged over
    passes: int = 2  # passes that bring the totals up to date
    seed: int = 7


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _LOW)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _chunk_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes that begin and end with a blank, by sums of powers."""
    global _powers
    if len(_powers[0]) < len(x):
        _powers = [np.full(2 * len(x), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in _powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    edge = np.flatnonzero(np.diff(_IS_BLANK[x].view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(x)], out=sums[1:])
    return start, _mixed((sums[end] - sums[start]) * _powers[1][start])


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts one after another, and their number in each text."""
    owners, words = [], []
    held, size = [], 0

    def flush():
        nonlocal held, size
        start, h = _chunk_hashes(np.frombuffer(b"\n" + b"\n".join(p for _, p in held) + b"\n", np.uint8))
        ends = np.cumsum([len(p) + 1 for _, p in held])
        owners.append(np.array([i for i, _ in held])[np.searchsorted(ends, start - 1, side="right")])
        words.append(h)
        held, size = [], 0

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        at = 0
        while at < len(b):
            end = len(b)
            if end - at > CHUNK:  # a long text is cut at a blank
                m = _BLANKS.search(b, at + CHUNK)
                end = m.start() if m else end
            held.append((i, b[at:end]))
            size += end - at
            at = end
            if size >= CHUNK:
                flush()
    if held:
        flush()
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    out = np.empty(len(owner) + len(texts), np.uint64)
    if len(owner):
        out[np.arange(len(owner)) + owner] = np.concatenate(words)
    out[np.cumsum(sizes) - 1] = END
    return out, sizes


def _contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """40 bits of the hash of the token before each."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return _mixed(before) >> np.uint64(24)


def _pairs(word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return _mixed(word ^ (ctx * np.uint64(_BASE)))


def _range(h: np.ndarray, n) -> np.ndarray:
    """Which of n even ranges of hashes."""
    return ((h >> _LOW) * np.asarray(n, np.uint64) >> _LOW).astype(np.int64)


def _among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each x in the keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def _run_bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return np.append(0, cut), np.append(cut, len(keys[0]))


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.compress(out.getvalue(), 1)


def _unpack(blob: bytes) -> dict:
    return dict(np.load(io.BytesIO(zstandard.decompress(blob))))


def _pieces(it, columns):
    """Columns of batches of up to BATCH rows and (but for a single longer text) BATCH_BYTES of text, however Arrow cuts them."""
    held, rows, size = [], 0, 0

    def batch():
        nonlocal held, rows, size
        t = pa.Table.from_batches(held)
        held, rows, size = [], 0, 0
        return [t.column(c).combine_chunks() for c in columns]

    for b in it:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(upto[at - 1]) if at else 0
            n = min(BATCH - rows, int(np.searchsorted(upto, done + BATCH_BYTES - size, side="right")) - at)
            if n <= 0 and rows:
                yield batch()
                continue
            n = max(1, n)
            held.append(b.slice(at, n))
            rows, size, at = rows + n, size + int(upto[at + n - 1]) - done, at + n
    if rows:
        yield batch()


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and held_out: crc32 of the id as text leaves 2 when divided by 7."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))


@dataclass(frozen=True)
class Hot:
    """Tokens and pairs that would make a block large; at most as many as 4 times the buckets."""

    words: np.ndarray  # sorted hashes
    parts: np.ndarray  # over how many blocks each is dealt; in all at most a few times the buckets
    pairs: np.ndarray  # sorted hashes of pairs
    of: np.ndarray  # the pairs' tokens

    def place(self, at: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """What a hot token's pair is dealt by; ``at`` is the token's position in words."""
        return _mixed(word + (_range(pair, self.parts[at]) + 1).astype(np.uint64) * np.uint64(_BASE))


def _totals(chosen: DataFrame, share: int) -> tuple[Hot, int]:
    """What is hot (a share above 1 / share of all tokens), and the number of training tokens.

    What has a share of s in all tokens has one above s / 2 in batches with half of its places, so it is enough to send
    what has 1 / (2 * share) of a batch, and to keep what then adds up to half a share of all.
    """

    def batches(it):
        total = train = 0
        for text, held in _pieces(it, ("text", "held_out")):
            tokens, sizes = _tokens(text.to_pylist())
            total += len(tokens)
            train += int(sizes[~held.to_numpy(zero_copy_only=False)].sum())
            words, n = np.unique(tokens, return_counts=True)
            often = n * 2 * share >= len(tokens)
            words, n = words[often], n[often]
            of = _among(words, tokens) >= 0
            pairs, first, m = np.unique(_pairs(tokens[of], _contexts(tokens, sizes)[of]), return_index=True, return_counts=True)
            often = m * 2 * share >= len(tokens)
            pairs, of, m = pairs[often], tokens[of][first[often]], m[often]
            cols = np.repeat([1, 2], [len(n), len(m)]), np.append(words, pairs).view(np.int64), np.append(words, of).view(np.int64), np.append(n, m)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["kind", "key", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([3, 4]), pa.array([0, 0]), pa.array([0, 0]), pa.array([total, train])], names=["kind", "key", "word", "n"])

    found = chosen.select("text", "held_out").mapInArrow(batches, "kind long, key long, word long, n long")
    sums = saved(found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("word").alias("word")), ARROW_ROWS)
    count = {r["kind"]: r["n"] for r in sums.where("kind > 2").collect()}  # two rows
    # at most 2 * share of each kind
    hot = sums.where((F.col("kind") <= 2) & (F.col("n") * 2 * share >= count.get(3, 0))).toPandas()
    (words, _, n), (pairs, of, _) = ([x[c].to_numpy(np.int64) for c in ("key", "word", "n")] for x in (hot[hot["kind"] == k] for k in (1, 2)))
    words, pairs, of = words.view(np.uint64), pairs.view(np.uint64), of.view(np.uint64)
    a, b = np.argsort(words), np.argsort(pairs)
    # pieces of half a block's mean size
    return Hot(words[a], np.ceil(n[a] * share / max(count.get(3, 0), 1)).astype(np.int64), pairs[b], of[b]), count.get(4, 0)


BLOCK = "bucket int, batch long, cells binary, places binary, ids array<{of}>, held array<boolean>, tokens array<long>"


def _rows(rows: list[tuple], id_type) -> pa.RecordBatch:
    """Rows of BLOCK as an Arrow batch."""
    cols = list(zip(*rows))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "batch", "cells", "places", "ids", "held", "tokens"])


def _ctx_bytes(ctx: np.ndarray) -> bytes:
    return (ctx >> np.uint64(8)).astype(np.uint32).tobytes() + ctx.astype(np.uint8).tobytes()


def _ctx_array(blob, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(blob, np.uint8, n, 4 * n)


def _deal(chosen: DataFrame, hot: Hot, buckets: int) -> DataFrame:
    """Tokens dealt out: for each batch a header (bucket below 0: ids and places of hot pairs), and a row for each bucket.

    A bucket's blob has, in order: numbers of words, cells and places; words and their cells; the cells' contexts, places
    and training customers; the places' documents.
    """
    id_type = chosen.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def blob_of(word, ctx, n, c, doc) -> bytes:
        lo, hi = _run_bounds(word)
        head = np.array([len(lo), len(ctx), len(doc)], np.int64).tobytes()
        return b"".join((head, word[lo].tobytes(), (hi - lo).astype(np.uint32).tobytes(), _ctx_bytes(ctx), n.astype(np.uint32).tobytes(), c.astype(np.uint32).tobytes(), doc.tobytes()))

    def batches(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, text, held) in enumerate(_pieces(it, ("doc_id", "text", "held_out"))):
            batch = (part << 32) + number
            tokens, sizes = _tokens(text.to_pylist())
            held = held.to_numpy(zero_copy_only=False)
            ctx = _contexts(tokens, sizes)
            doc = np.repeat((np.arange(len(sizes)) | np.where(held, 0, 1 << 15)).astype(np.uint16), sizes)
            which = _among(hot.words, tokens)
            split = np.flatnonzero(which >= 0)  # dealt by the pair
            pair = _pairs(tokens[split], ctx[split])
            place = hot.place(which[split], tokens[split], pair)
            cell = _among(hot.pairs, pair)
            is_hot = split[cell >= 0]
            header = _pack(cell=cell[cell >= 0].astype(np.uint32), doc=doc[is_hot])
            rows = [(-1 - int(_mixed(np.array([batch], np.uint64))[0] >> np.uint64(34)), batch, None, header, ids.to_pylist(), held.tolist(), sizes.tolist())]
            for at in np.unique(cell[cell >= 0]):  # the block of a hot pair gets its customers without places
                x = is_hot[cell[cell >= 0] == at]
                w, u = tokens[x[:1]], ctx[x[:1]]
                c = np.array([int((doc[x] >> 15).sum())])
                rows.append((int(_range(place[cell == at][:1], buckets)[0]), batch, blob_of(w, u, np.zeros(1), c, np.empty(0, np.uint16)), None, None, None, None))
            # places in the order of buckets, words and contexts; what collides in 32 bits makes a few more runs
            order = tokens & ~np.uint64(0xFFFFFFFF) | ctx >> np.uint64(8)
            order[split] = place & ~np.uint64(0xFFFFFFFF) | pair >> _LOW
            keep = np.ones(len(tokens), bool)
            keep[is_hot] = False
            keep = np.flatnonzero(keep)
            order = keep[np.argsort(order[keep])]
            dealt = tokens.copy()
            dealt[split] = place
            bucket = _range(dealt[order], buckets)
            tokens, ctx, doc = tokens[order], ctx[order], doc[order]
            del order, dealt, keep, which  # a batch's arrays are some of the largest that a worker holds
            first, last = _run_bounds(bucket, tokens, ctx)
            n = last - first
            c = np.add.reduceat((doc >> 15).astype(np.int64), first) if len(first) else n
            for lo, hi in zip(*_run_bounds(bucket[first])):
                a, b = first[lo], last[hi - 1]
                f = first[lo:hi]
                rows.append((int(bucket[a]), batch, blob_of(tokens[f], ctx[f], n[lo:hi], c[lo:hi], doc[a:b] & 0x7FFF), None, None, None, None))
            yield _rows(rows, arrow_id)

    return chosen.mapInArrow(batches, BLOCK.format(of=id_type.simpleString()))


def _made(bucket: int, rows: list[tuple]) -> tuple:
    """One block of all blobs of a bucket: its cells, and their places in documents."""
    words, ctxs, ns, cs, docs, batch = [], [], [], [], [], []
    for i, (_, blob) in enumerate(rows):
        nw, nc, nt = np.frombuffer(blob, np.int64, 3)
        at = 24 + 8 * nw
        words.append(np.repeat(np.frombuffer(blob, np.uint64, nw, 24), np.frombuffer(blob, np.uint32, nw, at)))
        at += 4 * nw
        ctxs.append(_ctx_array(memoryview(blob)[at:], nc))
        at += 5 * nc
        ns.append(np.frombuffer(blob[at : at + 4 * nc], np.uint32).astype(np.int64))
        cs.append(np.frombuffer(blob[at + 4 * nc : at + 8 * nc], np.uint32).astype(np.int64))
        docs.append(np.frombuffer(blob[at + 8 * nc :], np.uint16))
        batch.append(np.full(nc, i, np.uint32))
    words, word = np.unique(np.concatenate(words), return_inverse=True)
    ctxs, ctx = np.unique(np.concatenate(ctxs), return_inverse=True)
    n, c, doc, batch = np.concatenate(ns), np.concatenate(cs), np.concatenate(docs), np.concatenate(batch)
    order = np.argsort(word.astype(np.int64) << 32 | ctx, kind="stable")
    word, ctx = word[order], ctx[order]
    lo, hi = _run_bounds(word, ctx)
    begin = np.cumsum(n) - n
    n, begin = n[order], begin[order]
    moved = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(doc))
    cells = _pack(words=words, ctxs=ctxs, word=word[lo].astype(np.uint32), ctx=ctx[lo].astype(np.uint32), c=np.add.reduceat(c[order], lo))
    small = np.uint16 if len(rows) <= 65536 else np.uint32
    places = _pack(batches=np.array([r[0] for r in rows], np.int64), n=np.add.reduceat(n, lo).astype(np.uint32), batch=np.repeat(batch[order], n).astype(small), doc=doc[moved])
    return bucket, None, cells, places, None, None, None


def _blocks(dealt: DataFrame) -> DataFrame:
    """A table of blocks and headers in buckets, so that joins by bucket don't shuffle it again."""
    spark = dealt.sparkSession
    n = partitions(spark)
    arrow_schema = dealt.schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(arrow_schema["ids"].dataType.elementType)

    def batches(it):
        at, held = None, []
        for b in it:
            buckets, numbers = b.column("bucket").to_pylist(), b.column("batch").to_pylist()
            blobs = b.column("cells").to_pylist()
            for i, (bucket, batch, blob) in enumerate(zip(buckets, numbers, blobs)):
                if bucket < 0:
                    yield b.slice(i, 1)
                    continue
                if bucket != at and held:
                    yield _rows([_made(at, held)], arrow_id)
                    held = []
                at = bucket
                held.append((batch, blob))
        if held:
            yield _rows([_made(at, held)], arrow_id)

    made = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(batches, arrow_schema)
    name = f"tarn_blocks_{uuid.uuid4().hex}"
    with tidy(spark, arrow_rows=ARROW_ROWS):
        made.write.bucketBy(n, "bucket").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


@dataclass
class State:
    """What a pass knows of the data outside its block, besides the totals of its restaurants."""

    parent_customers: float = 0.0
    parent_tables: float = 0.0
    known: int = 0  # distinct training tokens
    d1: float = 0.5  # discounts of the contexts' restaurants and of their parent
    d0: float = 0.5
    count: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the hot tokens: training tokens,
    c0: np.ndarray = field(default_factory=lambda: np.zeros(0))  # customers and
    t0: np.ndarray = field(default_factory=lambda: np.zeros(0))  # tables in the parent


_stirling: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """Generalised Stirling numbers S[c, t] for up to EXACT customers."""
    if d not in _stirling:
        s = np.zeros((EXACT + 1, EXACT + 1))
        s[0, 0] = 1
        for c in range(EXACT):
            s[c + 1, 1:] = s[c, :-1]
            s[c + 1] += (c - d * np.arange(EXACT + 1)) * s[c]
            s[c + 1, 0] = 0
        _stirling[d] = s
    return _stirling[d]


def draw(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers each, from their distribution given all else.

    ``others``: tables of the restaurant's other dishes; ``p``: the parent's probability of the dish.
    """
    t = np.minimum(c, 1).astype(np.float64)
    more = np.flatnonzero((c > 1) & (c <= EXACT))
    more = more[np.argsort(c[more], kind="stable")]
    s = stirling(d)
    for lo, hi in zip(*_run_bounds(c[more])):
        n = int(c[more[lo]])
        step = s[n, 2 : n + 1] / s[n, 1:n]
        for at in range(lo, hi, 1 << 15):
            i = more[at : min(hi, at + (1 << 15))]
            # weights of 1, 2, ... tables, each by the one before; beyond 1e4 nobody shares a table anyway
            a = np.minimum((strength + d * (others[i][:, None] + np.arange(1, n))) * p[i][:, None], 1e4)
            w = np.cumprod(np.hstack([np.ones((len(i), 1)), a * step]), axis=1)
            np.cumsum(w, axis=1, out=w)
            t[i] = 1 + (w < (rng.random(len(i)) * w[:, -1])[:, None]).sum(axis=1)
    i = np.flatnonzero(c > EXACT)
    if len(i):
        mean, sd = tables_of_many(c[i].astype(np.float64), others[i], p[i], d, strength)
        t[i] = np.clip(np.rint(mean + sd * rng.standard_normal(len(i))), 1, c[i])
    return t


def tables_of_many(c, others, p, d: float, strength: float):
    """Mode and spread of the number of tables, where the saddle point of S(c, t) meets the other weights.

    With y for 1 - z at the saddle point z: (1 - y) y^(d - 1) = c / a and t = a (1 - y^d) / d, a the weight of a new table.
    """
    t = np.sqrt(c)
    for _ in range(4):
        a = (strength + d * (others + t)) * p
        want = np.log(c / a)
        lo, hi = np.full(len(c), -80.0 / (1 - d)), np.full(len(c), -1e-15)
        for _ in range(46):
            mid = (lo + hi) / 2
            above = np.log(-np.expm1(mid)) + (d - 1) * mid > want
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        y = np.exp((lo + hi) / 2)
        t = np.clip(a * -np.expm1(d * np.log(y)) / d, 1, c)
    rest = -np.expm1(d * np.log(y))  # 1 - y^d
    slope = (1 / t) / (1 / np.maximum(1 - y, 1e-12) + (1 - d) / y - d * y ** (d - 1) / np.maximum(rest, 1e-12))
    bend = d * p / a - d * y ** (d - 1) / np.maximum(rest, 1e-12) * slope - 1 / t
    return t, np.sqrt(1 / np.maximum(-bend, 1e-12))


class Block:
    """The cells of some dishes, and the sampler over them."""

    def __init__(self, cells: bytes, met, hot: Hot, state: State, model: Model, salt: int, bucket: int):
        p = _unpack(cells)
        self.state, self.model = state, model
        self.ctxs, self.words = p["ctxs"], p["words"]
        self.word, self.ctx, self.c = p["word"].astype(np.int64), p["ctx"].astype(np.int64), p["c"].astype(np.int64)
        self.hot = _among(hot.words, self.words)
        self.own = self.hot < 0  # dishes that this block has all customers of
        self.count = np.bincount(self.word, weights=self.c, minlength=len(self.words))
        self.rng = np.random.default_rng([model.seed, salt, bucket])
        self.t = np.minimum(self.c, 1).astype(np.float64)
        self.customers = self.tables = None
        for _, blob in sorted((m["range"], m["blob"]) for m in met or () if m["range"] < 0):
            self.t[self.c > 1] = np.frombuffer(zstandard.decompress(blob), np.uint32)
        parts = [_unpack(blob) for _, blob in sorted((m["range"], m["blob"]) for m in met or () if m["range"] >= 0)]
        if parts:
            self.customers, self.tables = (np.concatenate([x[k] for x in parts]).astype(np.float64) for k in ("c", "t"))
        if len(state.c0):
            self.count[~self.own] = state.count[self.hot[~self.own]]
        self.t0 = None
        self._parent(False)

    def _parent(self, seat: bool) -> None:
        s, theta = self.state, self.model.strength
        self.c0 = np.bincount(self.word, weights=self.t, minlength=len(self.words))
        own, t0 = self.own, np.minimum(self.c0, 1)
        even = np.full(len(self.words), 1 / (s.known + 1))
        if seat:
            others = np.maximum(s.parent_tables - (t0 if self.t0 is None else self.t0), 0)
            t0[own] = draw(self.c0[own].astype(np.int64), others[own], even[own], s.d0, theta, self.rng)
        if len(s.c0):
            at = self.hot[~own]
            self.c0[~own], t0[~own] = s.c0[at], s.t0[at]
        self.t0 = t0
        self._weights()

    def _weights(self) -> None:
        s, theta = self.state, self.model.strength
        even = 1 / (s.known + 1)
        self.p0 = (self.c0 - s.d0 * self.t0 + (theta + s.d0 * s.parent_tables) * even) / (theta + s.parent_customers)

    def sweep(self) -> None:
        s = self.state
        self._parent(True)
        self.t = draw(self.c, np.maximum(self.tables[self.ctx] - self.t, 0), self.p0[self.word], s.d1, self.model.strength, self.rng)

    def probability(self) -> np.ndarray:
        """Of each cell's token in its context, under the seating of now."""
        s, theta = self.state, self.model.strength
        back = (theta + s.d1 * self.tables[self.ctx]) * self.p0[self.word]
        return (self.c - s.d1 * self.t + back) / (theta + self.customers[self.ctx])

    def averaged(self) -> np.ndarray:
        total = np.zeros(len(self.c))
        for _ in range(self.model.samples):
            self.sweep()
            self._parent(True)
            total += self.probability()
        return total / self.model.samples


PARTS = "range int, bucket int, blob binary, key long, n double"
#: Keys of what is added up over all blocks; hot tokens follow from 0 on, two keys each.
_SUMS = ("c0", "t0", "known", "one", "two", "one0", "two0")


def _pass(blocks: DataFrame, met: DataFrame | None, hot: Hot, state: State, model: Model, salt: int) -> tuple[DataFrame, State]:
    """One pass over all restaurants: totals for each block, and the sums. salt 0 seats everyone at one table a dish."""
    spark = blocks.sparkSession
    # each block sends a row to each range, and contexts are a fraction of the tokens: fewer ranges than partitions do
    ranges = max(1, partitions(spark) // 3)
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.float64()]
    names = ["range", "bucket", "blob", "key", "n"]

    def batches(it):
        for b in it:
            mets = b.column("met").to_pylist() if salt else [None] * b.num_rows
            for bucket, cells, m in zip(b.column("bucket").to_pylist(), b.column("cells").to_pylist(), mets):
                k = Block(cells, m, hot, state, model, salt, bucket)
                if salt:
                    for _ in range(model.sweeps):
                        k.sweep()
                    k._parent(True)
                c, t = (np.bincount(k.ctx, weights=x, minlength=len(k.ctxs)).astype(np.uint64) for x in (k.c, k.t))
                rows = [(int(r), bucket, _sums_blob(k.ctxs[lo:hi], c[lo:hi], t[lo:hi]), None, None)
                        for r, lo, hi in zip(*_range_runs(k.ctxs, ranges))]
                rows.append((-1 - bucket, bucket, zstandard.compress(k.t[k.c > 1].astype(np.uint32).tobytes(), 1), None, None))
                c0, own = np.bincount(k.word, weights=k.t, minlength=len(k.words)), k.own
                sums = [c0[own].sum(), k.t0[own].sum(), np.count_nonzero(k.count[own]), *((k.c == i).sum() for i in (1, 2)), *((c0[own] == i).sum() for i in (1, 2))]
                rows += [(-1 - bucket, bucket, None, -1 - i, float(x)) for i, x in enumerate(sums)]
                count = np.bincount(k.word, weights=k.c, minlength=len(k.words))
                for w in np.flatnonzero(~own):
                    rows += [(-1 - bucket, bucket, None, int(2 * k.hot[w]), float(count[w])), (-1 - bucket, bucket, None, int(2 * k.hot[w] + 1), float(c0[w]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def added(it):
        """Sums by context of all blobs of a range, sent back to each block in its own order."""

        def totals(of, rows):
            opened = [_sums_of(blob) for _, blob in rows]
            n = [len(x[0]) for x in opened]
            distinct, at = np.unique(np.concatenate([x[0] for x in opened]), return_inverse=True)

            def total(x):
                sums = np.bincount(at, weights=np.concatenate(x), minlength=len(distinct))
                return sums.astype(np.uint32 if not len(sums) or sums.max() < 1 << 32 else np.int64)[at]

            # one after the other: a range's arrays are the largest that a worker holds
            c, t = (total([x[i] for x in opened]) for i in (1, 2))
            ends = np.cumsum(n)
            out = [(of, bucket, _pack(c=c[e - k : e], t=t[e - k : e]), None, None) for (bucket, _), k, e in zip(rows, n, ends)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

        at, rows = None, []
        for b in it:
            of = b.column("range").to_numpy()
            if (of < 0).any():
                yield b.filter(pa.array(of < 0))
            for i in np.flatnonzero(of >= 0):
                if of[i] != at and rows:
                    yield totals(int(at), rows)
                    rows = []
                at = of[i]
                rows.append((b.column("bucket")[int(i)].as_py(), b.column("blob")[int(i)].as_py()))
        if rows:
            yield totals(int(at), rows)

    base = blocks.where("bucket >= 0").select("bucket", "cells")
    parts = (base.join(met, "bucket") if salt else base).mapInArrow(batches, PARTS)
    totals = saved(parts.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(added, PARTS), ARROW_ROWS)
    got = totals.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # 7 and two a hot token
    sums = dict(zip(got["key"].to_numpy(np.int64).tolist(), got["n"].tolist()))
    r = {name: sums.get(-1 - i, 0.0) for i, name in enumerate(_SUMS)}
    count, c0 = (np.array([sums.get(2 * i + j, 0.0) for i in range(len(hot.words))]) for j in (0, 1))
    known = int(r["known"]) + int((count > 0).sum())
    discount = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95))
    d1, d0 = (discount(r["one"], r["two"]), discount(r["one0"], r["two0"])) if salt == 0 else (state.d1, state.d0)
    t0 = np.minimum(c0, 1)
    if salt:
        rng = np.random.default_rng([model.seed, salt])
        t0 = draw(c0.astype(np.int64), np.maximum(state.parent_tables - state.t0, 0), np.full(len(c0), 1 / (known + 1)), d0, model.strength, rng)
    after = State(r["c0"] + c0.sum(), r["t0"] + t0.sum(), known, d1, d0, count, c0, t0)
    met = totals.where("key is null").groupBy("bucket").agg(F.collect_list(F.struct("range", "blob")).alias("met"))
    return met, after


def _sums_blob(ctxs: np.ndarray, c: np.ndarray, t: np.ndarray) -> bytes:
    """Contexts with their customers and tables, in 32 bits each, or in 64 where a context has more customers than that."""
    width = 4 if not len(c) or int(c.max()) < 1 << 32 else 8
    return bytes([width]) + _ctx_bytes(ctxs) + c.astype(f"u{width}").tobytes() + t.astype(f"u{width}").tobytes()


def _sums_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = blob[0]
    k = (len(blob) - 1) // (5 + 2 * width)
    c, t = (np.frombuffer(blob, f"u{width}", k, 1 + (5 + i * width) * k) for i in (0, 1))
    return _ctx_array(blob[1:], k), c, t


def _range_runs(ctxs: np.ndarray, ranges: int):
    """(range, start, end) of the even ranges of sorted 40-bit contexts, as three arrays."""
    of = (ctxs * np.uint64(ranges) >> np.uint64(40)).astype(np.int64) if ranges < 1 << 24 else np.zeros(len(ctxs), np.int64)
    lo, hi = _run_bounds(of)
    return of[lo], lo, hi


class _Sums:
    """Sums by batch and document, sent on as bytes when there are many or the task ends."""

    SCHEMA = "batch long, doc binary, score binary, base binary, known binary"

    def __init__(self):
        self.of: dict[int, np.ndarray] = {}

    def add(self, batch, doc, score, base, known):
        a = self.of.setdefault(int(batch), np.zeros((4, BATCH)))
        for row, weights in zip(a, (None, score, base, known)):
            row += np.bincount(doc, weights=weights, minlength=BATCH)

    def rows(self):
        cols = [[], [], [], [], []]
        for batch, a in self.of.items():
            d = np.flatnonzero(a[0])
            parts = (d.astype(np.uint16), a[1, d], a[2, d], a[3, d].astype(np.uint32))
            for c, v in zip(cols, (batch, *(x.tobytes() for x in parts))):
                c.append(v)
        self.of.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["batch", "doc", "score", "base", "known"])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model = Model()) -> DataFrame:
    """For each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    chosen = _chosen(docs, id_col, text_col)
    buckets = BLOCKS_PER_PARTITION * partitions(spark)
    hot, total = _totals(chosen, 2 * buckets)
    of = chosen.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(_deal(chosen, hot, buckets))
    state, met = State(), None
    for salt in range(model.passes + 1):
        met, state = _pass(blocks, met, hot, state, model, salt)
    joined = blocks.where("bucket >= 0").join(met, "bucket")
    base_log = lambda c: np.log10((c + 1) / (total + state.known + 1))
    last = model.passes + 1

    def hot_pairs(it):
        for b in it:
            for bucket, cells, m in zip(*(b.column(n).to_pylist() for n in ("bucket", "cells", "met"))):
                k = Block(cells, m, hot, state, model, last, bucket)
                at = _among(hot.pairs, _pairs(k.words[k.word], k.ctxs[k.ctx]))
                i = np.flatnonzero(at >= 0)
                count = k.count[k.word[i]]
                yield pa.RecordBatch.from_arrays([pa.array(at[i].astype(np.int64)), pa.array(k.averaged()[i]), pa.array(count)], names=["pair", "p", "count"])

    pair_p, pair_count = np.ones(len(hot.pairs)), np.zeros(len(hot.pairs))
    if len(hot.pairs):
        owners = np.unique(_range(hot.place(_among(hot.words, hot.of), hot.of, hot.pairs), buckets)).tolist()
        found = joined.where(F.col("bucket").isin(owners)).select("bucket", "cells", "met").mapInArrow(hot_pairs, "pair long, p double, count double")
        for r in found.collect():  # a row for each hot pair
            pair_p[r["pair"]], pair_count[r["pair"]] = r["p"], r["count"]
    shared = spark.sparkContext.broadcast((pair_p, pair_count))  # at most 4 * buckets numbers each

    def cold_scores(it):
        sums = _Sums()
        for b in it:
            for bucket, cells, places, m in zip(*(b.column(n).to_pylist() for n in ("bucket", "cells", "places", "met"))):
                k = Block(cells, m, hot, state, model, last, bucket)
                p = _unpack(places)
                score, base, known = np.log10(k.averaged()), base_log(k.count)[k.word], (k.count > 0)[k.word]
                cell = np.repeat(np.arange(len(k.c), dtype=np.int32), p["n"])
                order = np.argsort(p["batch"], kind="stable")
                batch, doc, cell = p["batch"][order], p["doc"][order], cell[order]
                for lo, hi in zip(*_run_bounds(batch)):
                    x = cell[lo:hi]
                    sums.add(p["batches"][batch[lo]], doc[lo:hi], score[x], base[x], known[x])
                if len(sums.of) > HELD:
                    yield sums.rows()
        yield sums.rows()

    def hot_scores(it):
        pair_p, pair_count = shared.value
        sums = _Sums()
        for b in it:
            for batch, places in zip(b.column("batch").to_pylist(), b.column("places").to_pylist()):
                p = _unpack(places)
                x = p["cell"]
                sums.add(batch, p["doc"] & 0x7FFF, np.log10(pair_p)[x], base_log(pair_count)[x], (pair_count > 0)[x])
                if len(sums.of) > HELD:
                    yield sums.rows()
        yield sums.rows()

    headers = blocks.where("bucket < 0")
    partial = joined.select("bucket", "cells", "places", "met").mapInArrow(cold_scores, _Sums.SCHEMA)
    partial = partial.unionByName(headers.select("batch", "places").mapInArrow(hot_scores, _Sums.SCHEMA))
    # written here, so that blocks go to Python a few at a time
    gathered = headers.select("batch", "ids", "held", "tokens").unionByName(saved(partial, ARROW_ROWS), allowMissingColumns=True)

    def combined(t: pa.Table) -> pa.Table:
        ids = held = sizes = None
        for i, h, n in zip(*(t.column(c).to_pylist() for c in ("ids", "held", "tokens"))):
            if n is not None:
                ids, held, sizes = i, h, n
        score, base, known = (np.zeros(len(sizes)) for _ in range(3))
        for d, s, b, k in zip(*(t.column(c).to_pylist() for c in ("doc", "score", "base", "known"))):
            if d is not None:
                d = np.frombuffer(d, np.uint16)
                score[d] += np.frombuffer(s, np.float64)
                base[d] += np.frombuffer(b, np.float64)
                known[d] += np.frombuffer(k, np.uint32)
        id_type = t.schema.field("ids").type.value_type
        return pa.table(
            {
                "doc_id": pa.array(ids, id_type), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            }
        )

    out = gathered.groupBy("batch").applyInArrow(combined, f"doc_id {of}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op2_pitman_yor_scores(spark, sf_dir):
    """Scores of every whole text of documents."""
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pitman_yor_scores": op2_pitman_yor_scores}
