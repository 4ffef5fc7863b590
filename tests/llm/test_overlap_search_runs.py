"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import decontaminate, lexical_search, periodic_runs, words

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = {"h": "1", "row": "2", "win": "3", "term": "4", "shard": "5", "query": "6", "start": "7", "a.b": "8", "n": "9"}


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def table(spark, rows, schema):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é.ß\n\x00Ⅷ", max_size=30)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for w in words.words([t.encode() if t is not None else None for t in texts]):
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            got.append(([w.between(i, i + 1) for i in range(a, b)], w.hash[a:b].tolist()))
    assert [g for g, _ in got] == [terms(t) for t in texts]
    of = {}
    for ws, hs in got:
        for x, h in zip(ws, hs):
            assert of.setdefault(x, h) == h
    assert len(set(of.values())) == len(of)


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(words, "_BLOCK", 7)
    monkeypatch.setattr(words, "_POWERS", [])
    text = "abcdefghijklmnopqrstuvwxyz " * 9 + "abcdefghijklmnopqrstuvwxyz xyz"
    (w,) = words.words([text.encode()])
    assert [w.between(i, i + 1) for i in range(len(w.hash))] == terms(text)
    assert len(set(w.hash.tolist())) == 2


def test_shingles_stay_within_texts():
    (w,) = words.words([b"a b c", b"", b"b c a b", None])
    at, h = words.shingles(w, 2)
    assert at.tolist() == [0, 1, 3, 4, 5]
    assert h[1] == h[2] and h[0] == h[4]
    assert words.shingles(w, 5)[0].tolist() == []


def test_cells_hold_every_hash(spark):
    hs = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(x),) for x in hs], "h long")
    cells = words.Cells.of(df)
    assert cells.has(hs.view(np.uint64)).all()
    assert cells.has(np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.2
    assert not words.Cells.of(df.where("h is null")).has(hs.view(np.uint64)).any()


# 11 decontamination


def contaminated_brute(docs, items):
    windows = {}
    for i, t in items:
        w = terms(t)
        m = min(10, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[a : a + m]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w = terms(t)
        hit, found = set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                g = tuple(w[a : a + m])
                if g in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def decontaminated(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()], key=str)


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n, k: " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 4, 9, 10, 11, 14]), rng.choice([2, 3, 7]))) for i in range(25)]
    items += [(7, items[0][1]), (None, items[3][1]), (90, None), (91, "..."), (92, "É É é"), (5, items[5][1]), (5, items[5][1])]
    docs = [(i, some(rng.randint(0, 60), rng.choice([2, 4, 7]))) for i in range(60)]
    docs += [(60, items[6][1].upper() + "! " + items[2][1]), (60, items[6][1]), (None, items[6][1]), (61, None), (62, ""), (63, "é É É é" * 3), (64, ("a " * 5 + "b ") * 4000)]
    got = decontaminate.contamination(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"))
    assert decontaminated(got) == contaminated_brute(docs, items)


@pytest.mark.parametrize("window,shingle", [(5, 2), (10, 10), (3, 1)])
def test_contamination_with_other_sizes(spark, window, shingle):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five"), (2, "two three four"), (3, "six five four")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, items, window=window, shingle=shingle).collect()}
    assert got == {5: {1: 5, 2: 0, 3: 0}, 10: {1: 0, 2: 0, 3: 0}, 3: {1: 5, 2: 3, 3: 0}}[window]


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    assert [r["n_items"] for r in decontaminate.contamination(docs, items.where("false")).collect()] == [0, 0]
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, items, shingle=11)


def test_prefixes_are_the_rarest(spark):
    """A window's candidates come from its rarest shingle alone: a passage of common words makes few of them."""
    common = " ".join(["the of and to"] * 200)
    docs = spark.createDataFrame([(i, common) for i in range(50)] + [(99, "the of and to the rare of and to the of and")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "and to the rare of and to the of and")], "item_id long, text string")
    every, places, _ = decontaminate.overlaps(docs, items)
    assert places.count() == 1 and every.count() == 51


# 12 ranked lexical search


def ranked_brute(items, docs, k=10):
    bag = [Counter(terms(t)) for _, t in docs]
    big_n, big_l = sum(1 for b in bag if b), sum(sum(b.values()) for b in bag)
    df = Counter(t for b in bag for t in b)
    out = []
    for i, t in items:
        asked = Counter(terms(t))
        scores = []
        for (d, _), b in zip(docs, bag):
            n = sum(b.values())
            m = 25 + (75 * n * big_n) // big_l if big_l else 0
            s = sum(c * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 8 * m)) for x, c in asked.items() if x in b)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(i)}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    some = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(700)] + [(700, None), (701, "..."), (None, some(9)), (5, some(20))]
    docs += [(800 + i, "W1 w2 W3 w1") for i in range(40)] + [(900, some(5000))]
    items = [(i, some(rng.randint(1, 12))) for i in range(30)] + [(30, "w1 w2 w3"), (31, None), (32, "unknown"), (33, ""), (None, "w7"), (3, "w9 w9 w5")]
    layout = lexical_search.Layout(shard=64, block=4, queries=7, pilot=2)
    got = lexical_search.search(table(spark, items, "item_id long, text string"), table(spark, docs, "doc_id long, text string").repartition(3), layout=layout)
    assert found(got) == ranked_brute(items, docs)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert lexical_search.search(items, docs.where("false")).count() == 0
    assert lexical_search.search(items.where("false"), docs).count() == 0
    assert found(lexical_search.search(items, docs)) == ranked_brute([("x", "a b")], [(1, "a b"), (2, None)])


def shard_of(n_docs, seed=1, block=16):
    rng = np.random.default_rng(seed)
    doc, term, impact = [], [], []
    for d in range(n_docs):
        topic = d % 20
        t = np.unique(np.concatenate([rng.integers(0, 30, 6), 1000 + topic * 16 + rng.integers(0, 16, 12)]))
        doc.append(np.full(len(t), d))
        term.append(t.astype(np.uint64))
        impact.append(rng.integers(1, 999_999, len(t)))
    doc, term, impact = (np.concatenate(x) for x in (doc, term, impact))
    return (doc, term, impact), lexical_search.Shard(lexical_search.blocked(doc, term, impact, n_docs, block), np.arange(n_docs))


def test_bounds_hold_and_skip_blocks():
    (doc, term, impact), s = shard_of(2000)
    for b in range(len(s.blocks) - 1):
        own = s.list_of[b]
        members = s.members[s.blocks[b] : s.blocks[b + 1]]
        summary = dict(zip(s.sum_term[s.heads[b] : s.heads[b + 1]].tolist(), s.sum_top[s.heads[b] : s.heads[b + 1]].tolist()))
        assert 1 <= len(members) <= 16 and min(summary) == own
        for d in members.tolist()[:3]:
            for t, x in zip(s.doc_term[s.rows[d] : s.rows[d + 1]].tolist(), s.impact[s.rows[d] : s.rows[d + 1]].tolist()):
                assert t < own or summary[t] * lexical_search.STEP >= x
    rng = np.random.default_rng(2)
    for _ in range(40):
        topic = int(rng.integers(0, 20))
        asked = np.unique(np.concatenate([rng.integers(0, 30, 4), 1000 + topic * 16 + rng.integers(0, 16, 4)])).astype(np.uint64)
        weight = rng.integers(1, 9000, len(asked))
        of = dict(zip(asked.tolist(), weight.tolist()))
        want = np.zeros(2000, np.int64)
        np.add.at(want, doc, [of.get(t, 0) * x for t, x in zip(term.tolist(), impact.tolist())])
        best = sorted([(-v, d) for d, v in enumerate(want.tolist()) if v])[:10]
        docs, scores = s.best(s.numbers(asked), weight, 1, 10)
        assert sorted(zip((-scores).tolist(), docs.tolist())) == best
        # a known least score changes no result above it
        docs, scores = s.best(s.numbers(asked), weight, -best[4][0], 10)
        assert {(v, d) for v, d in best if v <= best[4][0]} <= set(zip((-scores).tolist(), docs.tolist()))
    assert s.scored < s.seen / 2


def test_blocks_hold_like_documents():
    """Documents of one block are nearer to one another than documents of the list at large."""
    (doc, term, impact), s = shard_of(2000)
    vectors = {d: set(s.doc_term[s.rows[d] : s.rows[d + 1]].tolist()) for d in range(2000)}
    hot = len(s.term) - 1  # the longest list
    blocks = [s.members[s.blocks[b] : s.blocks[b + 1]].tolist() for b in range(s.lists[hot], s.lists[hot + 1])]
    near = [len(vectors[a] & vectors[b]) for m in blocks for a, b in zip(m, m[1:])]
    mixed = [d for m in blocks for d in m]
    random.Random(1).shuffle(mixed)
    far = [len(vectors[a] & vectors[b]) for a, b in zip(mixed, mixed[1:])]
    assert np.mean(near) > 1.5 * np.mean(far)


# 13 periodic runs


def runs_brute(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length, s = j - i + q, x[i : j + q]
            if length >= max(6, 4 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def described_brute(i, text):
    x = (text or "").encode()
    x = re.findall(rb"[^\x20\x09-\x0D]+", x)
    n = len(x)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[a + (k - a) % p] if k >= a else x[k] for k in range(n)]
    rs = runs_brute(x)
    gone = {k for a, m, q in rs for k in range(a + q, a + m)}
    kept = sha(b" ".join(w for k, w in enumerate(x) if k not in gone))
    best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rs else (None, None, None)
    return (i, len(rs), *best, 1000 * best[1] // best[2] if rs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in rs)), kept)


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_runs_against_brute_force(parts):
    x = [w for p, k in parts for w in p * k]
    assert periodic_runs.runs(np.array(x, np.int64)) == runs_brute(x)


@pytest.mark.parametrize("period,seed", [(33, 1), (64, 2), (100, 3), (127, 4), (200, 5)])
def test_runs_of_long_periods(period, seed):
    rng = random.Random(seed)
    for k in (2, 500):
        p = [rng.randrange(k) for _ in range(period)]
        x = [rng.randrange(k) for _ in range(rng.randint(0, 99))] + (p * 7)[: rng.randint(4 * period, 7 * period)] + [rng.randrange(k) for _ in range(50)]
        assert periodic_runs.runs(np.array(x, np.int64)) == runs_brute(x)


@pytest.mark.parametrize("p,g", periodic_runs.PRIMES)
def test_transforms_are_exact(p, g):
    rng = np.random.default_rng(1)
    x = rng.integers(0, p, (3, 64)).astype(np.uint64)
    assert (periodic_runs.ntt(periodic_runs.ntt(x, p, g), p, g, True) == x).all()
    y = rng.integers(0, p, (3, 64)).astype(np.uint64)
    got = periodic_runs.ntt(periodic_runs.ntt(x, p, g) * periodic_runs.ntt(y, p, g) % np.uint64(p), p, g, True)
    want = [[sum(int(a[i]) * int(b[(k - i) % 64]) for i in range(64)) % p for k in range(64)] for a, b in zip(x, y)]
    assert got.tolist() == want


@pytest.mark.parametrize("s", [4, 32, 64])
def test_squared_differences(s):
    rng = np.random.default_rng(s)
    x = np.tile(rng.integers(0, 10**9, s + 3), 9)
    x[7 * s] += 1
    at = np.arange(4) * s
    want = [[bool((x[a : a + s] == x[a + d : a + d + s]).all()) for d in range(s, 2 * s)] for a in at.tolist()]
    got = periodic_runs.squared_differences(x, at, s)
    assert got.tolist() == want and got.any()


def test_large_runs_take_one_pass():
    n = 200_000
    assert periodic_runs.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic_runs.runs(np.tile(np.arange(n // 8), 8)) == [(0, n, n // 8)]


def test_op13_against_brute_force(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        if len(t or "") < 6000:
            want[i] = described_brute(i, t)
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(docs["doc_id"]) and len(want) > 150
    assert {i: got[i] for i in want} == want


def test_runs_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b c " * 4), (5, "x x " * 6), (9, "A a " * 40_000), (17, "k " * 30 + "m"), (33, "\t\n")]
    df = table(spark, rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in periodic_runs.periodic_runs(df, edit=periodic_runs.edited).collect()], key=str)
    want = [described_brute(i, t) for i, t in rows if i != 9]
    assert [g for g in got if g[0] != 9] == sorted(want, key=str)
    assert [g[1:6] for g in got if g[0] == 9] == [(1, 0, 80_000, 2, 40_000_000)]
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0
