"""HTTP by rounds: a request a row, and rows that failed for the moment are tried again in the next round.

A task never waits: it tries each of its rows once and writes down what came of it. Waits lie between rounds, one for all
rows, so a slow or busy host holds no core, and a lost executor repeats only its round.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import stored

#: What a server says when it may answer later.
LATER = (408, 425, 429, 500, 502, 503, 504)
ANSWER = "status int, content binary, error string, again boolean"


class Answered(Exception):
    """A reply that isn't good: raise it in ``get`` with the status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def attempted(rows: DataFrame, url: str, load: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """Rows with status, content, error and again, after one request each; ``load`` makes the function from addresses to bytes
    once a task. A failure is its row's alone. Requests that get no reply at all may be tried again, as may those in LATER."""
    schema = rows.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in ANSWER.split(", "))])
    names = schema.columns

    def batches(it):
        get = load()
        for b in it:
            out = []
            for u in b.column(url).to_pylist():
                try:
                    out.append((200, get(u), None, False) if u else (None, None, "no address", False))
                except Answered as e:
                    out.append((e.status, None, str(e), e.status in LATER))
                except ValueError as e:  # an address or a reply that makes no sense
                    out.append((None, None, f"ValueError: {e}", False))
                except Exception as e:  # noqa: BLE001  what a client raises is not known here
                    out.append((None, None, f"{type(e).__name__}: {e}", True))
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return rows.mapInArrow(batches, schema.schema)


def fetched(rows: DataFrame, url: str, load, rounds: int = 3, first_wait: float = 0.5, most_wait: float = 8.0, sleep=time.sleep) -> DataFrame:
    """Rows with status, content, error and tries, after up to ``rounds`` rounds; each round's rows are written.

    Waits between rounds double up to ``most_wait``. Equal addresses are asked for once a row; make them distinct first.
    """
    done, left = None, rows
    for turn in range(rounds):
        made = stored(attempted(left, url, load).withColumn("tries", F.lit(turn + 1)))
        last = turn == rounds - 1
        over = made if last else made.where("not again")
        done = over.drop("again") if done is None else done.unionByName(over.drop("again"))
        if last or made.where("again").isEmpty():
            return done
        left = made.where("again").select(*rows.columns)
        sleep(min(first_wait * 2**turn, most_wait))
    return done


def recorded(answers: DataFrame, path: str, url: str = "url") -> None:
    """Good answers as a snapshot for runs without a network."""
    answers.where("content is not null").select(F.col(url).alias("url"), "status", "content").dropDuplicates(["url"]).write.mode("errorifexists").parquet(path)


def replayed(rows: DataFrame, url: str, path: str) -> DataFrame:
    """What ``fetched`` returns, from a snapshot: addresses it doesn't know fail."""
    known = rows.sparkSession.read.parquet(path).withColumnRenamed("url", "__url")
    met = rows.join(known, F.col(url) == F.col("__url"), "left").drop("__url")
    return met.withColumns({"error": F.when(F.col("content").isNull(), F.lit("not in the snapshot")), "tries": F.lit(0)})
