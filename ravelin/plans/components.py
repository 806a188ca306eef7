"""Connected components by contraction: each vertex takes the least of its neighbours and itself for its label, labels are followed to their ends,
and the edges between different ends are the next round's graph.

An edge table that is small, by count, is one task's work: a union-find there gives the same labels without the rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.plans.lineage import broadcast_below, materialise

_BROADCAST_ROWS = 500_000


def _least_beside(edges: DataFrame) -> DataFrame:
    """(id, label): each vertex with the least among itself and its neighbours. Followed from vertex to vertex, labels fall to one that is its own."""
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("n")).union(edges.select("v", "u"))
    return both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("label"))


def _followed(own: DataFrame) -> DataFrame:
    """Labels followed to their ends, by doubling, among those vertices alone that are a label; then put in once for all."""
    inner = materialise(own.join(own.select(F.col("label").alias("id")).distinct(), "id", "left_semi"), "component-inner")
    n = inner.count()
    while True:
        then = broadcast_below(inner.select(F.col("id").alias("label"), F.col("label").alias("then")), n, _BROADCAST_ROWS)
        moved = materialise(inner.join(then, "label").select("id", F.col("then").alias("label"), (F.col("then") != F.col("label")).alias("moved")), "component-inner")
        inner = moved.select("id", "label")
        if moved.where("moved").isEmpty():
            break
    ends = inner.select(F.col("id").alias("label"), F.col("label").alias("end"))
    return materialise(own.join(broadcast_below(ends, n, _BROADCAST_ROWS), "label").select("id", F.col("end").alias("label")), "component-labels")


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels of their ends, each once."""
    for end in ("u", "v"):
        edges = edges.withColumnRenamed(end, "id").join(labels, "id").drop("id").withColumnRenamed("label", end)
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _union_find(batches):
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"id": list(parent), "label": [root(x) for x in parent]})


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = 500_000) -> DataFrame:
    """(id, label) for every vertex of ``edges`` that has a neighbour; the label is the least id of the component. Up to ``one_task`` edges, counted, are labelled in one task.

    A round leaves at most half of the vertices, so rounds are as many as the logarithm of the vertices at most, and each handles what is left of the edges four times."""
    now, rounds = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "component-edges"), []
    n = now.count()
    while n > one_task:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds.append(_followed(materialise(_least_beside(now), "component-least")))
        now = materialise(_contracted(now, rounds[-1]), "component-edges")
        n = now.count()
    kind = now.schema["u"].dataType.simpleString()
    out = materialise(now.coalesce(1).mapInPandas(_union_find, f"id {kind}, label {kind}"), "components")
    for k, own in reversed(list(enumerate(rounds))):
        n = out.count()
        if n:
            later = broadcast_below(out.select(F.col("id").alias("label"), F.col("label").alias("end")), n, _BROADCAST_ROWS)
            own = own.join(later, "label", "left").select("id", F.coalesce("end", "label").alias("label"))
        out = materialise(own, "components") if k else own
    return out
