"""A cache with a time to live as keyed state of a stream: requests in, and what the cache did about each out.

Requests of a key are answered in the order of their time, however they arrive: they wait in state until the watermark has
passed them. So the rows out don't depend on how the input was cut into batches, nor on restarts.

Calls between Spark and Python cost far more than the work on a request. So keys are dealt to a fixed number of buckets, and state
is that of a bucket: its waiting requests in packs, as they came, and the entries of its keys in one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, moment timestamp, kind string, request long, result string, saved_at timestamp"
#: Times are microseconds since 1970, days and reports (their dates) days since then.
_REQUEST = pa.schema([("key", pa.string()), ("at", pa.int64()), ("day", pa.int32()), ("request", pa.int64()), ("available", pa.bool_()), ("report", pa.int32()), ("result", pa.string())])
_ENTRY = pa.schema([("key", pa.string()), ("saved_at", pa.int64()), ("report", pa.int32()), ("result", pa.string()), ("shown", pa.bool_())])
#: The date of a report that has none: never of the future.
_NO_DATE = -(2**31)


def _pack(table: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpack(packs, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(p[0])).read_all() for p in packs)])


def _lists(table: pa.Table) -> list[list]:
    """The columns as lists; none but strings and ``request`` have nulls."""
    return [c.to_pylist() if c.null_count else c.to_pandas().tolist() for c in table.columns]


class TimedCache(StatefulProcessor):
    """A bucket's entries (saved_at, report, result) by key, its waiting requests, and one timer for whatever comes next.

    Rows out, by ``kind``: ``hit`` (the entry answers: from 0 to ``ttl`` old, and no report from the future), ``miss`` (there
    was none: the request's own result is stored), ``replaced`` (there was one that doesn't answer), ``unavailable`` (no entry
    answers, and the request has no result of its own: nothing is stored), ``expired`` (an entry has outlived its time).
    """

    def __init__(self, ttl: dt.timedelta):
        self.ttl = ttl // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "pack binary")
        self.waiting = handle.getListState("waiting", "pack binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = pa.Table.from_pandas(batch, _REQUEST, preserve_index=False)
            self.waiting.appendValue(_pack(new))
            at = pc.min(new["at"]).as_py()
            first = at if first is None else min(first, at)
        if first is not None:
            self._wake(-(-first // 1000), timerValues)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now, ttl, out = timerValues.getCurrentWatermarkInMs() * 1000, self.ttl, []
        waiting = _unpack(self.waiting.get() if self.waiting.exists() else [], _REQUEST)
        left = waiting.filter(pc.greater(waiting["at"], now))
        due = waiting.filter(pc.less_equal(waiting["at"], now)).sort_by([("at", "ascending"), ("request", "ascending")])
        held = _lists(_unpack([self.entries.get()] if self.entries.exists() else [], _ENTRY))
        entries = {k: e for k, *e in zip(*held)}
        for k, at, day, request, available, report, result in zip(*_lists(due)):
            e = entries.get(k)
            if e and not e[3] and at > e[0] + ttl:
                self._expire(k, e, out)
            if e and 0 <= at - e[0] <= ttl and e[1] <= day:
                out.append((k, at, "hit", request, e[2], e[0]))
            elif available:
                out.append((k, at, "replaced" if e else "miss", request, result, at))
                entries[k] = [at, report, result, False]
            else:
                out.append((k, at, "unavailable", request, None, None))
        for k, e in entries.items():
            if not e[3] and now > e[0] + ttl:
                self._expire(k, e, out)
        if len(due):
            self.waiting.put([_pack(left)]) if len(left) else self.waiting.clear()
        if out:
            self.entries.update(_pack(pa.table([pa.array(c, t) for c, t in zip([list(entries), *zip(*entries.values())], _ENTRY.types)], schema=_ENTRY)) if entries else _pack(_ENTRY.empty_table()))
        following = [-(-pc.min(left["at"]).as_py() // 1000)] if len(left) else []
        following += [(e[0] + ttl) // 1000 + 1 for e in entries.values() if not e[3]]
        if following:
            self._wake(min(following), timerValues)
        if out:
            k, moment, kind, request, result, saved = zip(*out)
            yield pd.DataFrame({"key": k, "moment": moment, "kind": kind, "request": pd.array(request, "Int64"), "result": result, "saved_at": pd.array(saved, "Int64")})
        else:
            yield pd.DataFrame()

    def _expire(self, key: str, entry: list, out: list) -> None:
        """Marks an entry as expired; it stays, to be replaced."""
        out.append((key, entry[0] + self.ttl, "expired", None, entry[2], entry[0]))
        entry[3] = True

    def _wake(self, at: int, timerValues) -> None:
        """One timer a bucket: the earliest time at which there is something to do, never one that has passed."""
        at = max(at, timerValues.getCurrentWatermarkInMs() + 1)
        set_ = self.timer.get()[0] if self.timer.exists() else None
        if set_ is not None and set_ <= at:
            return
        if set_ is not None:
            self.handle.deleteTimer(set_)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Keyed state of arbitrary kinds lives in the RocksDB store; a query keeps the store it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cached(requests: DataFrame, ttl: dt.timedelta, late: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """What a cache does about a stream of requests (key, ts, request, available, report_date, result).

    Requests may come late by ``late``; later ones are dropped, as the watermark says. A null key or time is no request. Start
    the stream within ``keyed_state``. What waits in one of the ``buckets`` is in memory at once; a stream keeps the number it
    was started with.
    """
    clean = requests.where("key is not null and ts is not null").withWatermark("ts", late).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "ts", "key", F.unix_micros("ts").alias("at"), F.unix_date(F.to_date("ts")).alias("day"), "request",
        F.coalesce("available", F.lit(False)).alias("available"), F.coalesce(F.unix_date("report_date"), F.lit(_NO_DATE)).alias("report"), "result",
    )
    out = OUT.replace("timestamp", "long")
    done = clean.groupBy("bucket").transformWithStateInPandas(statefulProcessor=TimedCache(ttl), outputStructType=out, outputMode="Append", timeMode="EventTime")
    time = lambda c: F.timestamp_micros(c).alias(c)
    return done.select("key", time("moment"), "kind", "request", "result", time("saved_at"))
