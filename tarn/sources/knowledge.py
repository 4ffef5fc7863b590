"""A knowledge base: records of documents by versions, and a collection of their vectors; filled by runs, asked by vectors.

A run reads pages, takes the documents that are new or changed against the version before, and writes their records, vectors
and hashes. What it did is counted while it is written (``observe``), not by reading it again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.config import Settings
from tarn.operators import ingest as I
from tarn.sources import capabilities
from tarn.sources.collection import Collection
from tarn.sources.files import stored
from tarn.sources.versions import Versions, children

RECORD = "page long, chunk_id string, text string, is_table boolean, title string, source_org string, source_url string, crop string, vector array<float>"


@dataclass
class KnowledgeBase:
    spark: SparkSession
    path: str

    def __post_init__(self):
        self.records = Versions(self.spark, f"{self.path}/records", "filename", "string", RECORD)

    def vectors(self) -> Collection:
        return Collection(self.spark, f"{self.path}/vectors", "string")

    def run(self, pages: DataFrame, sources: DataFrame, version: int, tables: DataFrame | None = None, embedding: capabilities.Capability | None = None, script: str = D.BANGLA, s: Settings = Settings(), force: bool = False, name: str | None = None, cells: int = 64) -> dict[str, int]:
        """One run over pages (filename, page, text, content_hash) as ``version``; returns what it counted.

        A run that is made again with its version replaces itself. ``force`` takes unchanged documents too, ``name`` only one.
        Records whose text the embedding can't take have no vector, and are found by words alone.
        """
        known = self.records.known(before=version).where("not deleted").select("filename", "content_hash")
        made, todo = I.run(pages, tables, sources, known, script, s, force, name)
        todo = stored(todo)
        made = capabilities.apply(made, "text", embedding or capabilities.hashed_embedding(), "vector")
        written, planned = Observation("records"), Observation("documents")
        made = made.observe(
            written, F.count(F.lit(1)).alias("records"), F.count_if("is_table").alias("tables"), F.count_if(~F.col("vector_available")).alias("without_vector"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
        )
        old = stored(self.records.current(before=version).join(todo.select("filename"), "filename", "left_semi").select("chunk_id"))
        names = ["filename", *(f.split()[0] for f in RECORD.split(", "))]
        self.records.write(version, todo.observe(planned, F.count(F.lit(1)).alias("documents")), made.select(*[F.col(c).cast("long") if c == "page" else c for c in names]))
        new = self.records.current().where(F.col("version") == version).select("chunk_id", "vector")
        if "centroids" not in children(self.spark, f"{self.path}/vectors"):
            if not new.where("vector is not null").isEmpty():
                Collection.create(new, f"{self.path}/vectors", "chunk_id", "vector", cells=cells)
        else:
            self.vectors().upsert(new, version, "chunk_id", "vector", deleted=old.join(new.select("chunk_id"), "chunk_id", "left_anti"))
        return {**planned.get, **written.get}

    def ask(self, queries: DataFrame, k: int, least: float | None = None, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """(query_id, rank, score, and the record) of the k nearest records of each query; payloads are joined after the cut."""
        found = self.vectors().search(queries, k, least, query_id, vector)
        return found.join(self.records.current().drop("vector", "version"), F.col("id") == F.col("chunk_id")).drop("id")
