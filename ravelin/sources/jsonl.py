"""Tolerant readers: JSON lines, journals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.plans.tables import JOURNAL


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", str(multi_line).lower())
    try:
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], wide)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines). Blank lines are skipped; a missing file has no rows."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    try:
        lines = spark.read.text(path).where(F.trim("value") != "")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select(*[F.col(f"r.`{f.name}`") for f in schema.fields]), rows.where(bad).select(F.col("value").alias("ligne"))


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """All journal files of a folder; files that can't be read are skipped."""
    return _read(spark, f"{path.rstrip('/')}/*.json", JOURNAL, multi_line=True).where(F.col("_corrupt").isNull() & F.col("passe").isNotNull()).drop("_corrupt")
