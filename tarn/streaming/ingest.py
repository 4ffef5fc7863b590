"""Incremental ingest as a stream: files of documents in, a collection that holds the latest records of each document.

A micro-batch is a version of the collection, named by the batch's id. A batch that runs again, because the query died
before it was marked as done, is planned against the versions before it and replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import ingest as I
from tarn.sources.versions import Versions


def ingested(into: Versions, text: str, records: Callable[[DataFrame], DataFrame], order: list | None = None, tombstone: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: new and changed documents of a batch replace their records.

    ``records`` makes records (key, ...) of documents; ``order`` says which of a document's rows in a batch counts (the first);
    rows whose column ``tombstone`` is true delete their document. A null key is no document, a null text an empty one.
    """

    def write(batch: DataFrame, version: int) -> None:
        key = into.key
        hashed = batch.where(F.col(key).isNotNull()).withColumn("content_hash", I.content_hash(F.coalesce(F.col(text), F.lit(""))))
        latest = I.upsert(hashed, [key], [*(order or []), F.asc("content_hash")])
        gone = F.coalesce(F.col(tombstone), F.lit(False)) if tombstone else F.lit(False)
        known = into.known(before=version).where("not deleted").select(key, "content_hash")
        live = latest.where(~gone)
        # ids and hashes alone are planned; texts of what changed are met again
        todo = I.plan(live.select(key, "content_hash"), known, key).select(key, "content_hash").persist()
        try:
            changed = live.join(todo.select(key), key, "left_semi")
            deleted = latest.where(gone).select(key).join(known.select(key), key, "left_semi") if tombstone else None
            into.write(version, todo, records(changed), deleted)
        finally:
            todo.unpersist()

    return write
