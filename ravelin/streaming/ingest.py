"""Incremental ingest: a stream of document rows or files, upserted batch by batch into versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ravelin.operators.knowledge import first_of
from ravelin.plans.lineage import materialise
from ravelin.sources.files import chunks_of


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``old`` with the rows of ``new`` put over it; of rows with one key in ``new`` the first by ``order`` counts."""
    fresh = first_of(new, keys, order)
    return fresh if old is None else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def read_documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2500) -> StreamingQuery:
    """Appends each batch's passages under ``out/batch_id=<n>``: a batch that is done again writes the same place, so each counts once.
    A document that comes again has passages in a later batch; ``latest_passages`` takes those."""

    def write(batch: DataFrame, number: int) -> None:
        docs = first_of(batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("markdown")), ["doc_id"], [F.xxhash64("markdown")])
        chunks_of(docs, limit).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_passages(spark: SparkSession, out: str) -> DataFrame:
    """The passages of each document's last batch."""
    rows = spark.read.option("basePath", out).parquet(f"{out.rstrip('/')}/batch_id=*")
    last = rows.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["doc_id", "batch_id"], "left_semi").drop("batch_id")


def compact(spark: SparkSession, out: str) -> DataFrame:
    return materialise(latest_passages(spark, out), "stream-compact")
