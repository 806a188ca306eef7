"""Enrichment: the context of each node, its card by a pluggable writer, embeddings by a pluggable encoder; both are reused by fingerprint."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.names import text_fingerprint


def node_contexts(nodes: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = 6000) -> DataFrame:
    """node_id, contexte: type and name, distinct citations (cut at 1500), then passages with the most mentions first, 1800 characters
    of each, up to the first that would pass ``limit``."""
    quotes = mentions.where("citation <> ''").groupBy("node_id").agg(F.substring(F.array_join(F.sort_array(F.collect_set("citation")), " | "), 1, 1500).alias("citations"))
    head = nodes.join(quotes, "node_id", "left").select("node_id", F.concat(F.upper("type"), F.lit(" : "), F.col("nom"), F.coalesce(F.concat(F.lit("\n"), F.col("citations")), F.lit(""))).alias("tete"))
    used = mentions.groupBy("node_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(chunks.select("chunk_id", F.substring("texte", 1, 1800).alias("t")), "chunk_id").join(head, "node_id")
    order = Window.partitionBy("node_id").orderBy(F.desc("n"), "chunk_id")
    run = used.withColumns({"upto": F.length("tete") + F.sum(F.length("t") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(order)})
    kept = run.where(F.col("upto") <= limit).groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), "\n").alias("corps"))
    return head.join(kept, "node_id", "left").select("node_id", F.concat("tete", F.coalesce(F.concat(F.lit("\n"), F.col("corps")), F.lit(""))).alias("contexte"))


def template_card(context: str) -> str:
    """The offline writer: the context's first line and how much is known."""
    lines = context.split("\n")
    return f"{lines[0]} ({len(lines) - 1} extraits)"


def write_cards(contexts: DataFrame, writer: Callable[[str], str] = template_card, model: str = "offline-template", cache: DataFrame | None = None) -> DataFrame:
    """node_id, sha, fiche, echec. A card of ``cache`` with the same sha is taken over; when writing fails the old card stays, with its old sha."""
    todo = contexts.withColumn("sha", text_fingerprint(F.concat("contexte", F.lit("\0" + model))))
    old = cache.select("node_id", F.col("sha").alias("sha0"), F.col("fiche").alias("fiche0")) if cache is not None else None
    todo = todo.join(old, "node_id", "left") if old is not None else todo.withColumns({"sha0": F.lit(None).cast("string"), "fiche0": F.lit(None).cast("string")})
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("node_id", "sha", "fiche", "echec")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.sha == r.sha0:
                    rows.append((r.node_id, r.sha, r.fiche0, None))
                    continue
                try:
                    rows.append((r.node_id, r.sha, writer(r.contexte), None))
                except Exception as e:  # one card's failure is reported in its row
                    rows.append((r.node_id, r.sha0, r.fiche0, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=kind.names)

    return todo.select("node_id", "sha", "contexte", "sha0", "fiche0").mapInPandas(run, kind)


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """The offline encoder: words by a hash to a signed place, normalised."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return encode


def chunk_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("id"), F.concat_ws("\n", "chemin_titres", "texte").alias("texte"))


def node_texts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id"), F.concat("type", F.lit(" : "), F.col("nom"), F.lit("\n"), F.substring(F.coalesce("fiche", F.lit("")), 1, 1200)).alias("texte"))


def embed(texts: DataFrame, encoder=None, model: str = "offline-hashing", dim: int = 64, cache: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """id, sha, embedding (null where the encoder failed on the batch). Vectors of ``cache`` with the same sha are taken over."""
    encoder = encoder or hashing_encoder(dim)
    todo, done = texts.withColumn("sha", text_fingerprint(F.concat("texte", F.lit("\0" + model)))), None
    if cache is not None:
        good = cache.where(F.col("embedding").isNotNull()).select("id", "sha", "embedding")
        done = good.join(todo, ["id", "sha"], "left_semi")
        todo = todo.join(good, ["id", "sha"], "left_anti")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(column: pd.Series) -> pd.Series:
        out: list = []
        for lo in range(0, len(column), batch):
            part = column.iloc[lo : lo + batch].fillna("").tolist()
            try:
                out += encoder(part)
            except Exception:  # the batch has no vectors and is encoded again next time
                out += [None] * len(part)
        return pd.Series(out, dtype=object)

    made = todo.select("id", "sha", run("texte").alias("embedding"))
    return made if done is None else made.unionByName(done)
