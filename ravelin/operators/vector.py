"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, summed in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """id, distance, rang of the k nearest: each task keeps its k best, the driver merges them; other dimensions are left out."""
    from ravelin.operators.fts import ranked

    own = vectors.where(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), l2(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])).alias("distance"))
    return ranked(own.orderBy("distance", "id").limit(k), ["distance", "id"])


def _nearest(queries, k: int):
    """The k best of each batch for every query: by a matrix product, then exactly for what comes within rounding of the k-th."""

    def run(batches):
        names, matrix = queries.value
        square = (matrix * matrix).sum(axis=1)
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == matrix.shape[1] for v in pdf["v"]]]
            if not len(pdf):
                continue
            ids, own = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64)
            own_square = (own * own).sum(axis=1)
            for lo in range(0, len(matrix), 512):
                q = matrix[lo : lo + 512]
                d = square[lo : lo + 512, None] + own_square[None] - 2.0 * (q @ own.T)
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(own) else d.max(axis=1)
                row, col = np.nonzero(d <= (kth + 1e-9 * (1.0 + square[lo : lo + 512] + own_square.max()))[:, None])
                exact = np.sqrt(((q[row] - own[col]) ** 2).sum(axis=1))
                order = np.lexsort((ids[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.searchsorted(row, row)
                kept = np.arange(len(row)) - first < k
                yield pd.DataFrame({"query_id": names[lo : lo + 512][row[kept]], "id": ids[col[kept]], "distance": exact[kept]})

    return run


def knn_all(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", block_mb: int = 64) -> DataFrame:
    """query_id, id, distance, rang for every row of ``queries`` that isn't null. Queries go in blocks of at most ``block_mb``, by their measured size, each a broadcast and
    one pass over the vectors; every batch keeps its k best of a query, so what is merged by query is k rows for each batch."""
    spark = vectors.sparkSession
    own = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("q")).where(F.col("q").isNotNull() & F.col(id_col).isNotNull())
    sizes = own.groupBy(F.size("q").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # a row for each dimension
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull())
    out = None
    for dim, n in sizes:
        blocks = max(1, -(-n * max(dim, 1) * 8 // (block_mb << 20)))
        for b in range(blocks):
            part = own.where((F.size("q") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).orderBy("query_id").toArrow()
            shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.array(part["q"].to_pylist(), np.float64).reshape(len(part), dim)))
            one = rows.mapInPandas(_nearest(shared, k), f"query_id {kind}, id {kind}, distance double")
            out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, distance double, rang int")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rang", (F.row_number().over(best) - 1).cast("int")).where(F.col("rang") < k)


def rrf(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """id, score, first_list, first_rank from lists of (id, rang): sum of 1 / (constant + rang); ties keep the order of first sight."""
    together = None
    for i, one in enumerate(lists):
        own = one.select("id", "rang", F.lit(i).alias("liste"))
        together = own if together is None else together.union(own)
    seen = F.min(F.struct("liste", "rang"))
    # ranks are summed in list order, so that equal sums are equal numbers
    terms = F.sort_array(F.collect_list(F.struct("liste", "rang")))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.lit(1.0) / (F.lit(constant) + t["rang"]))
    return together.groupBy("id").agg(total.alias("score"), seen.alias("_f")).select("id", "score", F.col("_f.liste").alias("first_list"), F.col("_f.rang").alias("first_rank"))
