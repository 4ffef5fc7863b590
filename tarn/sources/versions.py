"""Keyed records in a folder that grows by versions: what each version changed, and now and then a base of all.

    folder/keys/base-<n>      (key..., content_hash, deleted, version): the state of each key as of version n
    folder/keys/delta-<n>     keys that version n changed or deleted
    folder/records/<n>        records of the keys that version n changed

A version's records are written before its keys, so that nobody sees records of a version that isn't whole, and a version
that is written again replaces itself. Readers take the newest base and the deltas after it; only keys and hashes take part
in that, and records are met by (key, version).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.ingest import upsert


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


class Versions:
    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str = "string", record: str = "record string"):
        """``record`` is the schema of what records have besides key and version."""
        self.spark, self.path, self.key = spark, path, key
        self.key_schema = f"`{key}` {key_type}, content_hash string, deleted boolean, version long"
        self.record_schema = f"`{key}` {key_type}, version long, {record}"

    def _whole(self, kind: str) -> list[int]:
        """Versions of which a folder is there and whole."""
        names = children(self.spark, f"{self.path}/keys")
        found = [int(n.split("-")[1]) for n in names if n.startswith(kind)]
        return sorted(v for v in found if "_SUCCESS" in children(self.spark, f"{self.path}/keys/{kind}-{v:012d}"))

    def _keys(self, kind: str, versions: list[int]) -> DataFrame:
        reader = self.spark.read.schema(self.key_schema)
        return reader.parquet(*[f"{self.path}/keys/{kind}-{v:012d}" for v in versions]) if versions else self.spark.createDataFrame([], self.key_schema)

    def known(self, before: int | None = None) -> DataFrame:
        """(key, content_hash, deleted, version): the latest state of each key, before a version if one is given.

        Keys of the base aren't shuffled where Spark can broadcast those of the deltas.
        """
        ok = lambda v: before is None or v < before
        base = max((v for v in self._whole("base") if ok(v)), default=None)
        since = [v for v in self._whole("delta") if ok(v) and (base is None or v > base)]
        if not since:
            return self._keys("base", [base] if base is not None else [])
        later = upsert(self._keys("delta", since), [self.key], [F.desc("version")])
        return later if base is None else self._keys("base", [base]).join(later.select(self.key), self.key, "left_anti").unionByName(later)

    def current(self, before: int | None = None) -> DataFrame:
        """All records of all keys that aren't deleted, as of the last whole version (before one, if it is given)."""
        live = self.known(before).where("not deleted").select(self.key, "version")
        # a version that has not been replaced since is one that is written now, or that died: its keys are not known
        versions = [v for v in children(self.spark, f"{self.path}/records") if before is None or int(v) < before]
        reader = self.spark.read.schema(self.record_schema)
        records = reader.parquet(*[f"{self.path}/records/{v}" for v in versions]) if versions else self.spark.createDataFrame([], self.record_schema)
        return records.join(live, [self.key, "version"])

    def write(self, version: int, changed: DataFrame, records: DataFrame, deleted: DataFrame | None = None) -> None:
        """One version: ``changed`` (key, content_hash), their ``records`` (key, ...), and ``deleted`` (key)."""
        records.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/records/{version:012d}")
        keys = changed.select(self.key, "content_hash", F.lit(False).alias("deleted"))
        if deleted is not None:
            keys = keys.unionByName(deleted.select(self.key, F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("deleted")))
        keys.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/keys/delta-{version:012d}")

    def compact(self) -> int | None:
        """A base of all keys as of the last version, so that readers needn't fold the deltas before it."""
        last = max(self._whole("delta"), default=None)
        if last is not None:
            self.known(last + 1).write.mode("overwrite").parquet(f"{self.path}/keys/base-{last:012d}")
        return last
