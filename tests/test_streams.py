"""Streams: the cache against a replay in order, whatever the batches; the collection against its last arrivals."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tarn.operators import ingest as I
from tarn.sources.versions import Versions, children
from tarn.streaming import cache, ingest
from tarn.streaming import streams as S

TTL = dt.timedelta(hours=1)
START = dt.datetime(2024, 5, 1)
REQUEST = "key string, ts timestamp, request long, available boolean, report_date date, result string"


def requests(n=120, seed=1):
    rng = random.Random(seed)
    out, at = [], START
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([1, 5, 20, 45]), microseconds=rng.randrange(10**6))
        day = at.date() + dt.timedelta(days=rng.random() < 0.1)
        out.append((rng.choice("abc"), at, i, rng.random() < 0.7, None if rng.random() < 0.1 else day, f"r{i}"))
    return out


def replay(rows, until):
    """What a cache does, request by request."""
    entries, out = {}, []
    for key, ts, i, available, day, result in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts > until:
            continue
        e = entries.get(key)
        if e and not e[3] and ts > e[0] + TTL:
            out.append((key, e[0] + TTL, "expired", None, e[2], e[0]))
            e = entries[key] = (*e[:3], True)
        if e and ts - e[0] <= TTL and (e[1] is None or e[1] <= ts.date()):
            out.append((key, ts, "hit", i, e[2], e[0]))
        elif available:
            out.append((key, ts, "replaced" if e else "miss", i, result, ts))
            entries[key] = (ts, day, result, False)
        else:
            out.append((key, ts, "unavailable", i, None, None))
    out += [(k, e[0] + TTL, "expired", None, e[2], e[0]) for k, e in entries.items() if not e[3] and until > e[0] + TTL]
    return sorted(out, key=str)


def feed(spark, parts, at, together=False):
    """Each part as files of its own; the stream is stopped and started again between parts, unless all come together."""
    def run():
        with cache.keyed_state(spark):
            S.run_once(cache.cached(S.read(spark, f"{at}/in", spark.createDataFrame([], REQUEST).schema), TTL), f"{at}/out", f"{at}/state")

    for part in parts:
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if not together:
            run()
    if together:
        run()
    return sorted([tuple(r) for r in spark.read.parquet(f"{at}/out").collect()], key=str)


def test_cache_rows_do_not_depend_on_batches(spark, tmp_path):
    rows = requests()
    until = rows[-1][1] - dt.timedelta(minutes=10)
    want = replay(rows, until)
    assert {r[2] for r in want} == {"hit", "miss", "replaced", "unavailable", "expired"}
    assert feed(spark, [rows], f"{tmp_path}/a") == want
    # in two parts, the first out of order and with some of the second's rows kept back within the time for late ones
    cut = 60
    held = [r for r in rows[:cut] if r[1] > rows[cut - 1][1] - dt.timedelta(minutes=8)][:-1]
    first = [r for r in rows[:cut] if r not in held]
    random.Random(2).shuffle(first)
    assert feed(spark, [first, held + rows[cut:]], f"{tmp_path}/b") == want


def test_cache_takes_no_request_without_key_or_time(spark, tmp_path):
    rows = [(None, START, 1, True, None, "x"), ("a", None, 2, True, None, "x"), ("a", START, 3, None, None, "x"), ("a", START + dt.timedelta(minutes=1), 4, True, None, None)]
    rows.append(("z", START + dt.timedelta(hours=9), 5, True, None, "later"))
    got = feed(spark, [rows], f"{tmp_path}/a")
    assert [(r[2], r[3]) for r in got] == [("unavailable", 3), ("miss", 4), ("expired", None)]


def test_state_of_the_cache_is_by_buckets(spark, tmp_path):
    """Writes to state are bounded by buckets, not by keys; rows are the same with any number of buckets."""
    rows = [(f"k{i % 1500}", START + dt.timedelta(seconds=5 * i), i, i % 3 > 0, None, f"r{i}") for i in range(3000)]
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    for buckets in ({}, {"buckets": 3}):
        at = f"{tmp_path}/{len(got)}"
        with cache.keyed_state(spark):
            made = cache.cached(S.read(spark, f"{tmp_path}/in", spark.createDataFrame([], REQUEST).schema), TTL, **buckets)
            q = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        puts = sum(o["customMetrics"]["rocksdbPutCount"] for p in q.recentProgress for o in p["stateOperators"])
        assert 0 < puts < 20 * buckets.get("buckets", 256)  # a state of each key took 12 for each of 1,500 keys
        got.append(sorted([tuple(r) for r in spark.read.parquet(f"{at}/out").collect()], key=str))
    assert got[0] == got[1] == replay(rows, rows[-1][1] - dt.timedelta(minutes=10))


def test_cache_in_another_time_zone(spark, tmp_path):
    rows = requests(60)
    want = feed(spark, [rows], f"{tmp_path}/utc")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Dhaka")
    try:
        # the same times and days as they are read there
        shifted = lambda t: t and t + dt.timedelta(hours=6)
        with cache.keyed_state(spark):
            moved = S.read(spark, f"{tmp_path}/utc/in", spark.createDataFrame([], REQUEST).schema).withColumn("ts", F.col("ts") - F.expr("interval 6 hours"))
            S.run_once(cache.cached(moved, TTL), f"{tmp_path}/dhaka", f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/dhaka").collect()]
    assert sorted([(k, shifted(m), *rest, shifted(s)) for k, m, *rest, s in got], key=str) == want


DOC = "name string, text string, at int, gone boolean"


def collection(spark, at):
    records = lambda d: I.chunks(d, "name", "text").select(F.col("doc_id").alias("name"), "chunk_no", "chunk")
    into = Versions(spark, at, "name", "string", "chunk_no int, chunk string")
    return into, ingest.ingested(into, "text", records, order=[F.desc("at")], tombstone="gone")


def test_ingest_by_versions(spark, tmp_path):
    into, write = collection(spark, f"{tmp_path}/c")
    long = "A sentence that is long enough to be a chunk of its own. "
    batches = [
        [("a", long, 1, False), ("a", long + "Newer.", 2, False), ("b", long * 40, 1, False), ("c", "short", 1, False), (None, long, 1, False), ("n", None, 1, False)],
        [("a", long + "Newer.", 3, False), ("b", long * 20, 2, False), ("c", None, 1, True), ("x", None, 1, True), ("d", long, 1, None)],
    ]
    state = lambda: sorted(map(tuple, into.current().select("name", "version", "chunk_no", "chunk").collect()))
    frames = [spark.createDataFrame(b, DOC) for b in batches]
    write(frames[0], 0)
    first = state()
    assert {r[0] for r in first} == {"a", "b"} and [r[3] for r in first if r[0] == "a"] == [(long + "Newer.").strip()]
    write(frames[1], 1)
    second = state()
    assert {(r[0], r[1]) for r in second} == {("a", 0), ("b", 1), ("d", 1)}
    assert len([r for r in second if r[0] == "b"]) < len([r for r in first if r[0] == "b"])
    # a batch that runs again replaces itself
    write(frames[1], 1)
    assert state() == second
    known = {r["name"]: r["deleted"] for r in into.known().collect()}
    assert known == {"a": False, "b": False, "c": True, "d": False, "n": False}
    # folded into a base, with a version after it
    assert into.compact() == 1
    assert state() == second and {r["name"]: r["deleted"] for r in into.known().collect()} == known
    write(spark.createDataFrame([("c", long, 1, False)], DOC), 2)
    assert {r[0] for r in state()} == {"a", "b", "c", "d"}
    assert "base-000000000001" in children(spark, f"{tmp_path}/c/keys")


def test_a_version_without_its_keys_is_not_seen(spark, tmp_path):
    into, write = collection(spark, f"{tmp_path}/c")
    text = "Words enough to make a chunk of a document, and a few more."
    write(spark.createDataFrame([("a", text, 1, False)], DOC), 0)
    # records of a version that died before its keys were written
    spark.createDataFrame([("a", 1, 0, "other")], "name string, version long, chunk_no int, chunk string").write.parquet(f"{tmp_path}/c/records/{1:012d}")
    assert [r["chunk"] for r in into.current().collect()] == [text]
    write(spark.createDataFrame([("a", text + " Changed.", 1, False)], DOC), 1)
    assert [r["chunk"] for r in into.current().collect()] == [text + " Changed."]


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    into, write = collection(spark, f"{tmp_path}/c")
    text = "Some words that make a chunk when they stand together, number %d."
    arrivals = [[(f"d{i}", text % i, 1, False) for i in range(20)], [(f"d{i}", text % (i * i), 1, False) for i in range(10, 30)]]
    schema = spark.createDataFrame([], DOC).schema
    for a in arrivals:
        spark.createDataFrame(a, DOC).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second time there is nothing new
            S.each_batch(S.read(spark, f"{tmp_path}/in", schema), write, f"{tmp_path}/state")
    want = {f"d{i}": text % (i * i if i >= 10 else i) for i in range(30)}
    assert {r["name"]: r["chunk"] for r in into.current().collect()} == want


def test_nothing_is_there(spark):
    into = Versions(spark, tempfile.mkdtemp(prefix="spark-"), "name")
    assert into.current().count() == into.known().count() == 0 and into.compact() is None
    with pytest.raises(Exception):
        into.write(0, spark.createDataFrame([], "other string"), spark.createDataFrame([], "name string, record string"))
