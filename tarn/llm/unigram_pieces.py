"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a model file form a trie over their bytes, laid out in two arrays: the child of node s by byte c is node
base[s] + c if check[base[s] + c] is s. Viterbi finds the segmentation of greatest total log score; characters that no
piece covers are written as their bytes. White space becomes a marker that starts a piece, and the text gets one marker
in front; decoding turns markers back to spaces and drops that one.

No piece holds a marker behind another character, so a text falls apart before each run of markers, and its parts are
segmented alone. All distinct parts of a batch are segmented together, in step: one move through the trie for all.

A model file of another kind than unigram numbers its pieces by rank; their log scores then follow Zipf's law,
-log(rank + 2).

Edge cases: a null or empty text has no ids; the marker in a text decodes to a space; repeated rows each return a row;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: As in the library: an unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """A vocabulary ready to be sent to tasks; its size is that of the model file."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece that ends at a node, or -1
    score: np.ndarray
    spelling: list[bytes]
    byte_ids: list[int]
    longest: int
    breaks: bool  # no piece holds a line feed or tab

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        ranked = model.trainer_spec.model_type != model.trainer_spec.UNIGRAM
        spelling, score, words, byte_ids = [], [], {}, [0] * 256
        for i, p in enumerate(model.pieces):
            score.append(-float(np.log(i + 2)) if ranked else p.score)
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                spelling.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                words[p.piece.encode()] = i
                spelling.append(p.piece.encode())
            else:
                spelling.append(b"")
        return cls(*double_array(words), np.array(score), spelling, byte_ids, max(map(len, words)), not any(b"\n" in w or b"\t" in w for w in words))


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of the double-array trie of ``words``; node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for w, i in words.items():
        s = 0
        for c in w:
            if c not in children[s]:
                children[s][c] = len(children)
                children.append({})
                ends.append(-1)
            s = children[s][c]
        ends[s] = i
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    free = 257  # below, a child by a high byte could not stand, and the hole would stay
    # searches for several children start here; after long ones it moves on, and single children fill the holes behind
    start = 1
    queue = [(0, 0)]
    for s, at in queue:
        value[at] = ends[s]
        labels = sorted(children[s])
        if not labels:
            continue
        while taken[free]:
            free += 1
        b = max(1, free - labels[0])
        if len(labels) > 1:
            b = first = max(b, start)
            while any(taken[b + c] for c in labels):
                b += 1
            if b > first + 100:
                start = b
        else:
            while taken[b + labels[0]]:
                b += 1
        base[at] = b
        for c in labels:
            taken[b + c] = 1
            check[b + c] = at
            queue.append((children[s][c], b + c))
        if b + 600 > size:
            more = size
            base, check, value = (np.concatenate([x, np.full(more, v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
            taken.extend(bytes(more))
            size += more
    return base, check, value


def segment(parts: list[bytes], v: Pieces) -> list[tuple[list[int], float]]:
    """Ids and score of each of many parts (UTF-8), by Viterbi in step over groups of like lengths."""
    out: list = [None] * len(parts)
    for i, p in enumerate(parts):
        if len(p) > ALONE:
            out[i] = _alone(p, v)
    order = sorted((i for i, p in enumerate(parts) if len(p) <= ALONE), key=lambda i: len(parts[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 20_000 and (end - at + 1) * len(parts[order[end]]) <= 2_000_000 and len(parts[order[end]]) <= len(parts[order[at]]) + 8:
            end += 1
        rows = order[at:end]
        for i, x in zip(rows, _in_step([parts[i] for i in rows], v)):
            out[i] = x
        at = end
    return out


#: Parts with more bytes are segmented alone; most are a word.
ALONE = 192
#: Positions of such a part whose pieces are looked up at once.
WINDOW = 1 << 15


def _alone(part: bytes, v: Pieces) -> tuple[list[int], float]:
    """Ids and score of one long part: pieces from all positions by one walk through the trie, then Viterbi over them."""
    n = len(part)
    text = np.frombuffer(part, np.uint8)
    leads = np.flatnonzero(text & 0xC0 != 0x80)
    width = np.append(leads[1:], n) - leads
    unknown = float(v.score.min()) - UNKNOWN_PENALTY
    limit = len(v.check)
    best, come, piece = [-np.inf] * (n + 1), array("i", bytes(4 * (n + 1))), array("i", [-1]) * (n + 1)
    best[0] = 0.0
    for lo in range(0, len(leads), WINDOW):
        at = leads[lo : lo + WINDOW]
        live, node = np.arange(len(at)), np.zeros(len(at), np.int32)
        found = []
        for k in range(v.longest):
            inside = at[live] + k < n
            live, node = live[inside], node[inside]
            child = v.base[node] + text[at[live] + k]
            ok = (child < limit) & (v.check[np.minimum(child, limit - 1)] == node) & (v.base[node] > 0)
            live, node = live[ok], child[ok]
            if not len(live):
                break
            hit = np.flatnonzero(v.value[node] >= 0)
            found.append((live[hit], np.full(len(hit), k + 1), v.value[node[hit]]))
        start, size, ends = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(len(at) + 1)).tolist()
        size, ends, worth = size[order].tolist(), ends[order].tolist(), v.score[ends[order]].tolist()
        for j, (i, w) in enumerate(zip(at.tolist(), width[lo : lo + WINDOW].tolist())):
            here = best[i]
            if here == -np.inf:
                continue
            single = False
            for e in range(bounds[j], bounds[j + 1]):
                to, now = i + size[e], here + worth[e]
                single |= size[e] == w
                if now > best[to]:
                    best[to], come[to], piece[to] = now, i, ends[e]
            if not single and here + unknown > best[i + w]:
                best[i + w], come[i + w], piece[i + w] = here + unknown, i, -1
    ids, e = [], n
    while e:
        b, i = come[e], piece[e]
        ids.extend([i] if i >= 0 else [v.byte_ids[c] for c in reversed(part[b:e])])
        e = b
    return ids[::-1], best[n]


def _in_step(parts: list[bytes], v: Pieces):
    n, most = len(parts), len(parts[-1])
    text = np.frombuffer(b"".join(p.ljust(most + 1, b"\0") for p in parts), np.uint8).reshape(n, most + 1)
    size = np.array([len(p) for p in parts])
    best = np.full((n, most + 1), -np.inf)
    best[:, 0] = 0.0
    come = np.zeros((n, most + 1), np.int32)  # where the last piece began
    piece = np.full((n, most + 1), -1, np.int32)
    unknown = float(v.score.min()) - UNKNOWN_PENALTY
    limit = len(v.check)
    for i in range(most):
        rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
        if not len(rows):
            continue
        lead = text[rows, i]
        wide = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.zeros(len(rows), bool)
        live, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for k in range(v.longest):
            go = rows[live]
            inside = i + k < size[go]
            live, node, go = live[inside], node[inside], go[inside]
            if not len(live):
                break
            child = v.base[node] + text[go, i + k]
            ok = (child < limit) & (v.check[np.minimum(child, limit - 1)] == node) & (v.base[node] > 0)
            live, node, go = live[ok], child[ok], go[ok]
            if not len(live):
                break
            ends = v.value[node]
            hit = np.flatnonzero(ends >= 0)
            if len(hit):
                r, p = go[hit], ends[hit]
                single[live[hit[wide[live[hit]] == k + 1]]] = True
                now = best[r, i] + v.score[p]
                better = now > best[r, i + k + 1]
                r, p = r[better], p[better]
                best[r, i + k + 1], come[r, i + k + 1], piece[r, i + k + 1] = now[better], i, p
        r, w = rows[~single], wide[~single]
        if len(r):
            to = np.minimum(i + w, size[r])
            now = best[r, i] + unknown
            better = now > best[r, to]
            r, to = r[better], to[better]
            best[r, to], come[r, to], piece[r, to] = now[better], i, -1
    # back from the ends, all parts in step; a part that has come to its start stays there
    rows, at, steps = np.arange(n), size.copy(), []
    while at.any():
        steps.append(np.where(at > 0, piece[rows, at], -2))
        at = come[rows, at]
    back = np.stack(steps[::-1], axis=1)
    used = np.count_nonzero(back != -2, axis=1).tolist()
    bare = (back == -1).any(axis=1)
    width = back.shape[1]
    for j, (ids, k) in enumerate(zip(back.tolist(), used)):
        if bare[j]:
            ids, e = [], len(parts[j])
            while e:
                b, i = int(come[j, e]), int(piece[j, e])
                ids.extend([i] if i >= 0 else [v.byte_ids[c] for c in reversed(parts[j][b:e])])
                e = b
            yield ids[::-1], float(best[j, size[j]])
        else:
            yield ids[width - k :], float(best[j, size[j]])


class Codec:
    """Encoder and decoder that remembers parts: those of the last ``remember``, and older ones that came again."""

    def __init__(self, pieces: Pieces, remember: int = 250_000):
        self.pieces, self.remember = pieces, remember
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # no piece holds a line feed or tab: a text falls apart at them, too
        self.part = re.compile(f"[\\n\\t]|{MARK}+[^{MARK}\\n\\t]*|[^{MARK}\\n\\t]+" if pieces.breaks else _PART.pattern)
        # what an id adds to a text's score: bytes of a character that no piece covers count once together
        self.is_byte = np.zeros(len(pieces.score), bool)
        self.is_byte[pieces.byte_ids] = True
        self.adds = np.where(self.is_byte, 0.0, pieces.score)
        self.adds[[i for b, i in enumerate(pieces.byte_ids) if not 0x80 <= b < 0xC0]] = float(pieces.score.min()) - UNKNOWN_PENALTY

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.part.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > self.remember:
            self.older, self.ids = self.ids, {}
        new = []
        for p in set(chain.from_iterable(parts)).difference(self.ids):
            if p in self.older:
                self.ids[p] = self.older[p]
            else:
                new.append(p)
        for p, (found, _) in zip(new, segment([p.encode() for p in new], self.pieces)):
            self.ids[p] = array("I", found).tobytes()
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, x)), np.uint32) for x in parts]

    def score(self, ids: np.ndarray) -> float:
        return float(self.adds[ids].sum())

    def decode(self, ids) -> str:
        spelled = b"".join(map(self.pieces.spelling.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = spelled.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


#: Codecs of this Python process by model file, so that the tasks of a worker share what it remembers.
_codecs: dict[str, Codec] = {}


def _codec(path: str, pieces: Pieces) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(pieces)
    return _codecs[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """For each document its ids (if asked for), their number, byte ids, checksum and score, and whether decoding gives
    the text back."""
    spark = docs.sparkSession
    path = model or default_model()
    shared = spark.sparkContext.broadcast(Pieces.load(path))  # as large as the vocabulary
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "score", "decoded_sha256", "exact"] + ["ids"] * with_ids

    def batches(it):
        codec = _codec(path, shared.value)
        for b in it:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                texts = s.column("text").to_pylist()
                cols = defaultdict(list)
                for t, ids in zip(texts, codec.encode_batch(texts)):
                    back = codec.decode(ids)
                    cols["n_ids"].append(len(ids))
                    cols["n_byte_ids"].append(int(np.count_nonzero(codec.is_byte[ids])))
                    cols["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    cols["score"].append(codec.score(ids))
                    cols["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    cols["exact"].append(back == (t or "").replace(MARK, " "))
                    if with_ids:
                        cols["ids"].append(ids.astype(np.int32))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([s.column("doc_id")] + [pa.array(cols[n], k) for n, k in zip(names[1:], kinds)], names=names)

    of = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        batches, f"doc_id {of}, n_ids long, n_byte_ids long, ids_crc32 long, score double, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids
    )


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    path = model or default_model()
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))
    chosen = encoded.select("doc_id", "ids")

    def batches(it):
        codec = _codec(path, shared.value)
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([codec.decode(x or ()) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"]
            )

    return chosen.mapInArrow(batches, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text string")


def op10_unigram_pieces(spark, sf_dir):
    """Every whole text of documents encoded to piece ids and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op10_unigram_pieces": op10_unigram_pieces}
