"""What the operators of this subpackage share: column picking that survives clashing names, word counts, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word for counting: a run of characters that aren't white space.
WORD = r"\S+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so any other column of the input, whatever its name, can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input doesn't have (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hashes(df: DataFrame, *columns: str) -> tuple[list[str], list[Column]]:
    """(names that ``df`` doesn't have, two 64-bit hashes of the columns): what stands for a row where texts aren't to be shuffled."""
    names = [free_name(df, n) for n in ("row_hash_a", "row_hash_b")]
    return names, [F.xxhash64(F.lit(n), *[F.col(f"`{c}`") for c in columns]).alias(name) for n, name in zip("ab", names, strict=True)]


def hash_fraction(*columns: Column) -> Column:
    """A seeded-by-value number in [0, 1), the same on every run and cluster."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / float(1 << 32)


def bounded_sample(keys: DataFrame, key: str, group: str | None, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``keys`` for each value of ``group`` (or in all), those with the lowest hash of ``key``.

    Counts come from a partial aggregation; a hash filter that keeps about twice the bound runs before the ranking,
    so that what is ranked has a bounded size for any input.
    """
    from pyspark.sql import Window

    by = [group] if group else []
    counts = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    h = hash_fraction(F.col(key))
    joined = keys.join(counts, group) if group else keys.crossJoin(counts)
    near = joined.where(h * F.col("_n") < 2.0 * bound + 40).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(h, F.col(key)))
    return near.withColumn("_r", rank).where(F.col("_r") <= bound).drop("_r")


LONG, INT, DOUBLE, STRING, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
