"""Full-text search with BM25 over a postings table.

The index is (mot, chunk_id, positions, dl), in lots of passages that are each in order of term, with one row of corpus statistics. A search reads only the
pages of its terms (the filter reaches the scan, and pages tell their least and greatest term), a few for each lot, and a stop word is spread over all lots. Both text
columns count together; a word that holds ``_`` is a phrase of its parts, matched by adjacent positions.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.names import fold
from ravelin.plans.lineage import materialise

K1, B, LOWEST_IDF = 1.2, 0.75, 1e-6
_TERM = re.compile(r"[^\W_]+")
#: Positions of the second column begin this far behind the first, so that no phrase spans both.
_GAP = 1 << 30
#: Passages in an Arrow batch of texts, places in a lot of postings, rows in an Arrow batch of them: they bound what a worker holds at once.
_BATCH, _LOT, _ROWS = 500, 2_000_000, 50_000


def question_words(question: str) -> list[list[str]]:
    """The words of a question (two signs at least), each as the terms that it is made of."""
    folded = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
    words = [re.findall(r"[^\W_]+", folded(w)) for w in re.findall(r"[\wÀ-ſ]{2,}", question)]
    return [w for w in words if w]


def _lots(batches):
    """mot, chunk_id, positions, dl for batches of an id and texts: the terms of each passage with their places, over all its columns, folded, cut
    and grouped within the row. What is kept at once is a lot of about _LOT places, however many passages there are; each lot is in order of term."""
    lot = _Lot()
    for batch in batches:
        lot.add_ids(batch.column(0))
        for row in range(batch.num_rows):
            found: dict[str, list[int]] = {}
            dl = 0
            for i, column in enumerate(batch.columns[1:]):
                text = column[row].as_py()
                terms = _TERM.findall(fold(text)) if isinstance(text, str) else []
                dl += len(terms)
                for p, t in enumerate(terms, i * _GAP):
                    found.setdefault(t, []).append(p)
            lot.add(row, found, dl)
            if len(lot.places) >= _LOT:
                yield from lot.in_order()
                lot = _Lot()
                lot.add_ids(batch.column(0))
    yield from lot.in_order()


class _Lot:
    """Postings in plain arrays: number of the term and of the passage, end of the places, places, size of the passage."""

    def __init__(self):
        self.ids, self.first, self.terms = [], 0, {}
        self.codes, self.rows, self.ends, self.places, self.sizes = array("i"), array("i"), array("i", [0]), array("q"), array("i")

    def add_ids(self, ids: pa.Array) -> None:
        self.first = sum(map(len, self.ids))
        self.ids.append(ids)

    def add(self, row: int, found: dict[str, list[int]], dl: int) -> None:
        for t, at in found.items():
            self.codes.append(self.terms.setdefault(t, len(self.terms)))
            self.rows.append(self.first + row)
            self.places.extend(at)
            self.ends.append(len(self.places))
            self.sizes.append(dl)

    def in_order(self):
        if not self.codes:
            return
        as_int = lambda x: np.frombuffer(x, dtype="int32")
        words = list(self.terms)
        rank = np.empty(len(words), dtype="int32")
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words), dtype="int32")
        order = np.argsort(rank[as_int(self.codes)], kind="stable")
        words, ids = pa.array(words, pa.string()), pa.concat_arrays(self.ids)
        places = pa.ListArray.from_arrays(pa.array(as_int(self.ends)), pa.array(np.frombuffer(self.places, dtype="int64")))
        for i in range(0, len(order), _ROWS):
            some = order[i : i + _ROWS]
            columns = [words.take(pa.array(as_int(self.codes)[some])), ids.take(pa.array(as_int(self.rows)[some])), places.take(pa.array(some)), pa.array(as_int(self.sizes)[some])]
            yield pa.RecordBatch.from_arrays(columns, ["mot", "chunk_id", "positions", "dl"])


def postings(passages: DataFrame, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("texte", "chemin_titres")) -> DataFrame:
    """mot, chunk_id, positions, dl: a row for each term of each passage; dl is the passage's number of terms. Rows come in lots in order of term."""
    own = passages.select(F.col(id_col).alias("chunk_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(text_cols)])
    fields = [T.StructField("mot", T.StringType()), T.StructField("chunk_id", own.schema["chunk_id"].dataType), T.StructField("positions", T.ArrayType(T.LongType())), T.StructField("dl", T.IntegerType())]
    return own.mapInArrow(_lots, T.StructType(fields))


def statistics(passages: DataFrame, index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: n (passages, those without a term included), avgdl."""
    total = index.select("chunk_id", F.size("positions").alias("tf")).agg(F.sum("tf").alias("terms"))
    return passages.agg(F.count(F.col(id_col)).alias("n")).crossJoin(total).select("n", (F.coalesce("terms", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"))


def build_index(passages: DataFrame, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("texte", "chemin_titres")) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics), written in the shared folder. Nothing is shuffled for it."""
    index = materialise(postings(passages, id_col, text_cols), "fts-postings", _BATCH)
    return index, materialise(statistics(passages, index, id_col), "fts-statistics")


def _back(k: int):
    return lambda p: p - k


def _hits(index: DataFrame, words: list[list[str]]) -> DataFrame:
    """w (number of the word), chunk_id, tf, dl."""
    parts = []
    for i, word in enumerate(words):
        found = index.where(F.col("mot") == word[0]).select("chunk_id", "dl", F.col("positions").alias("at"))
        for k, term in enumerate(word[1:], 1):
            later = index.where(F.col("mot") == term).select("chunk_id", F.transform("positions", _back(k)).alias("next"))
            found = found.join(later, "chunk_id").select("chunk_id", "dl", F.array_intersect("at", "next").alias("at"))
        parts.append(found.where(F.size("at") > 0).select(F.lit(i).alias("w"), "chunk_id", F.size("at").alias("tf"), "dl"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bm25(index: DataFrame, stats: DataFrame, words: list[list[str]]) -> DataFrame:
    """chunk_id, score (the lower the better), n_words matched."""
    hits = _hits(index, words)
    df = hits.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    both = hits.join(F.broadcast(df), "w").crossJoin(F.broadcast(stats))  # a row for each word of the question, and one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(LOWEST_IDF)).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # added in the order of the words, so that copies have equal scores
    parts = F.sort_array(F.collect_list(F.struct("w", part.alias("p"))))
    return both.groupBy("chunk_id").agg((-F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["p"])).alias("score"), F.count(F.lit(1)).alias("n_words"))


def search(index: DataFrame, stats: DataFrame, question: str, k: int | None, mode: str = "auto") -> DataFrame:
    """chunk_id, score, rang (from 0). ``and``: passages with all words; ``or``: with any; ``auto``: all, or any if none has all."""
    words = question_words(question)
    if not words:
        return index.sparkSession.createDataFrame([], "chunk_id string, score double, rang int")
    scored = bm25(index, stats, words)
    if mode != "or":
        full = scored.where(F.col("n_words") == len(words))
        if mode == "and":
            scored = full
        else:
            best = scored.agg(F.max("n_words").alias("most"))
            scored = scored.crossJoin(F.broadcast(best)).where((F.col("most") < len(words)) | (F.col("n_words") == len(words)))
    if k is None:
        return ranked_whole(scored, ["score", "chunk_id"]).select("chunk_id", "score", "rang")
    return ranked(scored.orderBy("score", "chunk_id").limit(k), ["score", "chunk_id"]).select("chunk_id", "score", "rang")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Adds rang from 0. For the bounded lists that are fused: the window has no partition."""
    from pyspark.sql import Window

    return df.withColumn("rang", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def ranked_whole(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds rang from 0 to a table of any size: sorted by ranges, numbered in each, and moved by the sizes of the ranges before it."""
    from pyspark.sql import Window

    parts = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "fts-ranges")
    at, before = 0, {}
    for r in parts.groupBy("_p").count().orderBy("_p").collect():  # a row for each range
        before[r["_p"]], at = at, at + r["count"]
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<int,int>")
    return parts.withColumn("rang", (F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.try_element_at(shift, F.col("_p"))).cast("int")).drop("_p")
