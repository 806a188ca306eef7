"""The knowledge base at rest: pruning, deduplication, versioned publication behind a pointer, opening, search tables."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import fts
from ravelin.plans.lineage import spread
from ravelin.plans.tables import TABLES


def prune(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without rows whose ids are unknown or repeated, rejets (table, n)). A row is counted once."""
    out = dict(tables)
    nodes = tables["nodes"].where("node_id IS NOT NULL").dropDuplicates(["node_id"])
    chunks = tables["chunks"].where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"]).join(tables["documents"].select("doc_id"), "doc_id", "left_semi")
    ids = lambda name: nodes.select(F.col("node_id").alias(name))
    out["nodes"], out["chunks"] = nodes, chunks
    out["aliases"] = tables["aliases"].join(ids("node_id"), "node_id", "left_semi").dropDuplicates(["alias", "node_id"])
    out["mentions"] = tables["mentions"].withColumn("citation", F.coalesce("citation", F.lit(""))).join(ids("node_id"), "node_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["node_id", "chunk_id", "citation"])
    edges = tables["edges"].withColumn("chunk_id", F.nullif("chunk_id", F.lit("")))
    n = edges.count()
    for end in ("source_id", "cible_id"):
        edges = spread(edges, end, n=n).join(spread(ids(end), end, n=n), end)  # ids are there once; a semi join would be moved before the shuffle, and one side alone would be put into as many parts as the other has
    known = edges.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(edges.where("chunk_id IS NULL"), allowMissingColumns=True)
    out["edges"] = known.dropDuplicates(["source_id", "type", "cible_id", "chunk_id"])
    lost = None
    for name in ("nodes", "chunks", "aliases", "mentions", "edges"):
        one = tables[name].agg(F.count(F.lit(1)).alias("a")).crossJoin(out[name].agg(F.count(F.lit(1)).alias("b"))).select(F.lit(name).alias("table"), (F.col("a") - F.col("b")).alias("n"))
        lost = one if lost is None else lost.union(one)
    return out, lost


def good_vectors(vectors: DataFrame, owners: DataFrame, dim: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(vectors of known ids with the right size, the rejected others)."""
    known = vectors.join(owners.select(F.col(owners.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    right = (F.size("embedding") == dim) & F.col("embedding").isNotNull()
    return known.where(right), known.where(~F.coalesce(right, F.lit(False)))


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """To a file beside it first, which then takes its place: a reader never sees half a text."""
    fs, target = _file(spark, path)
    _, part = _file(spark, f"{path}.part-{uuid.uuid4().hex[:8]}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(part, target):  # file systems that don't rename over a file
        fs.delete(target, False)
        fs.rename(part, target)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def append(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as a folder of its own below ``path`` and reads it back."""
    own = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """All that ``append`` finished writing below ``path``; nothing if there is none. Folders that a lost job left unfinished are passed over."""
    fs, folder = _file(spark, path)
    whole = [s.getPath().toString() for s in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(folder) else []
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], ontology_version: str = "1") -> str:
    """Writes a new version beside the old ones, then moves the pointer: readers see the old version or the new one, and a failed build changes nothing."""
    version = datetime.now(UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    root, tables = root.rstrip("/"), dict(tables)
    tables["meta"] = spark.createDataFrame([("construit_le", version), ("ontologie_version", ontology_version), ("moteur", "spark")], "cle string, valeur string")
    if "chunks" in tables:
        tables["fts_postings"] = fts.postings(tables["chunks"])
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    if "chunks" in tables:
        at = f"{root}/{version}"
        fts.statistics(spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/fts_postings")).write.parquet(f"{at}/fts_statistics")
    fs, pointer = _file(spark, f"{root}/CURRENT-{version}")
    stream = fs.create(pointer, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    """The newest published version; a pointer appears only after all its tables are written."""
    fs, folder = _file(spark, root)
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [n.removeprefix("CURRENT-") for n in names if n.startswith("CURRENT-")]
    return max(found, default=None)


def open_base(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version; missing ones are empty."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    fs, folder = _file(spark, f"{root.rstrip('/')}/{version}")
    there = {s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()}
    out = {n: spark.createDataFrame([], t) for n, t in TABLES.items() if n not in there}
    return out | {n: spark.read.parquet(f"{root.rstrip('/')}/{version}/{n}") for n in there}


def table_exists(base: dict[str, DataFrame], name: str) -> bool:
    return name in base


def reset(spark: SparkSession, root: str, level: str = "versions") -> int:
    """Deletes what this engine wrote at ``root``: ``versions`` (published ones but the current), ``work`` (all versions, and with them every cache, and unfinished work), ``all`` (journals
    and the report too). Sources are never touched. Returns the number of deleted entries."""
    now, n = current_version(spark, root), 0
    fs, folder = _file(spark, root)
    if not fs.exists(folder):
        return 0
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        record = name in ("journal", "rapport.md")
        if level == "all" or level == "work" and not record or level == "versions" and not record and name != "work" and name.removeprefix("CURRENT-") != now:
            n += bool(fs.delete(s.getPath(), True))
    return n
