"""The typed graph: an undirected view, neighbourhoods, shortest paths, expansion from seeds with the reason of each link.

A level is one equi-join of the frontier with the undirected edge view and one anti-join with what was reached; an OR over
both ends would be a Cartesian product. The frontier is broadcast only when its counted rows allow. Each level is written in
the shared folder, so the plan doesn't grow and a lost executor costs a level at most; so are the edges, once for all levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans.lineage import broadcast_below, materialise

_BROADCAST_ROWS = 500_000


def undirected(edges: DataFrame) -> DataFrame:
    """de, vers, relation, sens: each edge seen from both its ends (a self loop once)."""
    out = edges.select(F.col("source_id").alias("de"), F.col("cible_id").alias("vers"), F.col("type").alias("relation"), F.lit("->").alias("sens"))
    back = edges.where(F.col("source_id") != F.col("cible_id")).select(F.col("cible_id").alias("de"), F.col("source_id").alias("vers"), F.col("type").alias("relation"), F.lit("<-").alias("sens"))
    return out.union(back)


def expand(edges: DataFrame, seeds: DataFrame, depth: int, cap: int | None = None) -> tuple[DataFrame, bool]:
    """(node_id, distance, parent, relation, sens, chemin), truncated?  ``seeds``: node_id; seeds whose id is in no edge stay.

    The parent is the least (parent id, relation, sens) that reaches the node at its distance; ``chemin`` is the array of steps from a seed.
    With a ``cap``, nearer nodes come first, then lower ids, and any cut is reported.
    """
    return _expand(materialise(edges.select("source_id", "type", "cible_id"), "graph-edges"), seeds, depth, cap)


def _expand(edges: DataFrame, seeds: DataFrame, depth: int, cap: int | None = None) -> tuple[DataFrame, bool]:
    """``expand`` over edges that are written. Each level is written once, and ``reached`` is their union."""
    links, kind = undirected(edges), edges.schema["source_id"].dataType.simpleString()
    step = f"struct<de:{kind},relation:string,sens:string,vers:{kind}>"
    reached = materialise(seeds.select(F.col("node_id").cast(kind).alias("node_id")).distinct().select("node_id", F.lit(0).alias("distance"), F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("sens"), F.array().cast(f"array<{step}>").alias("chemin")), "graph-seeds")
    frontier, n, cut = reached, reached.count(), False
    size = n
    for level in range(1, depth + 1):
        if not size or (cap is not None and n >= cap and cut):
            break
        front = frontier.select(F.col("node_id").alias("de"), F.col("chemin").alias("_before"))
        met = links.join(broadcast_below(front, size, _BROADCAST_ROWS), "de")
        new = met.groupBy(F.col("vers").alias("node_id")).agg(F.min(F.struct("de", "relation", "sens")).alias("p"), F.min_by("_before", F.struct("de", "relation", "sens")).alias("_before"))
        new = new.join(reached.select("node_id"), "node_id", "left_anti")
        last = F.struct(F.col("p.de").alias("de"), F.col("p.relation").alias("relation"), F.col("p.sens").alias("sens"), F.col("node_id").alias("vers"))
        new = new.select("node_id", F.lit(level).alias("distance"), F.col("p.de").alias("parent"), F.col("p.relation").alias("relation"), F.col("p.sens").alias("sens"), F.concat("_before", F.array(last)).cast(f"array<{step}>").alias("chemin"))
        if cap is not None:
            room = max(0, cap - n)
            over = materialise(new.orderBy("node_id").limit(room + 1), "graph-level")
            size = over.count()
            if size > room:
                cut, size = True, room
                over = materialise(over.orderBy("node_id").limit(room), "graph-level")
            frontier = over
        else:
            frontier = materialise(new, "graph-level")
            size = frontier.count()
        reached = reached.union(frontier) if size else reached
        n += size
    return reached, cut


def neighbourhood(edges: DataFrame, node_id: str | int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(node_id, distance), (source_id, type, cible_id). Depth is put into 1..3. Edges are those at nodes nearer than the depth:
    an edge between two nodes at the full depth isn't among them."""
    depth = max(1, min(int(depth), 3))
    edges = materialise(edges.select("source_id", "type", "cible_id"), "graph-edges")
    seeds = edges.sparkSession.createDataFrame([(node_id,)], f"node_id {edges.schema['source_id'].dataType.simpleString()}")
    reached, _ = _expand(edges, seeds, depth)
    inner = reached.where(F.col("distance") < depth).select("node_id")
    size = inner.count()
    ends = [edges.join(broadcast_below(inner.withColumnRenamed("node_id", end), size, _BROADCAST_ROWS), end, "left_semi").select("source_id", "type", "cible_id") for end in ("source_id", "cible_id")]
    return reached.select("node_id", "distance"), ends[0].union(ends[1]).distinct()


def shortest_path(edges: DataFrame, start: str | int, end: str | int, max_depth: int = 5, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """etape (from 1), de, relation, sens, vers of a shortest undirected path; no rows when there is none or start is end.

    Before a level is made, the links of the end are looked up in the level before: the one that holds the end is never made. Of several ways to a node the least (``name`` of the
    node before, relation, sens) counts. A level has that one step for each node, and the path is followed back through the levels."""
    spark, kind = edges.sparkSession, edges.schema["source_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"etape int, de {kind}, relation string, sens string, vers {kind}")
    if start == end:
        return empty
    links = undirected(materialise(edges.select("source_id", "type", "cible_id"), "graph-edges"))
    last = materialise(links.where(F.col("vers") == end), "path-end")
    beside = last.count()
    least = F.min_by(F.struct("de", "relation", "sens"), F.struct(name(F.col("de")), "relation", "sens"))
    level = materialise(spark.createDataFrame([(start,)], f"node_id {kind}").select("node_id", *[F.lit(None).cast(t).alias(c) for c, t in (("de", kind), ("relation", "string"), ("sens", "string"))]), "path-level")
    levels, size = [level], 1
    for depth in range(1, max_depth + 1):
        front = levels[-1].select(F.col("node_id").alias("de"))
        met = front.join(broadcast_below(last, beside, _BROADCAST_ROWS), "de") if beside <= size else last.join(broadcast_below(front, size, _BROADCAST_ROWS), "de")
        step = met.agg(least.alias("s")).first()["s"]
        if step is not None:
            path = [(depth, step["de"], step["relation"], step["sens"], end)]
            for k in range(depth - 1, 0, -1):
                at = path[-1][1]
                row = levels[k].where(F.col("node_id") == at).first()
                path.append((k, row["de"], row["relation"], row["sens"], at))
            return spark.createDataFrame(path[::-1], empty.schema)
        if depth == max_depth:
            break
        new = links.join(broadcast_below(front, size, _BROADCAST_ROWS), "de").groupBy(F.col("vers").alias("node_id")).agg(least.alias("s"))
        for before in levels:
            new = new.join(before.select("node_id"), "node_id", "left_anti")
        levels.append(materialise(new.select("node_id", "s.de", "s.relation", "s.sens"), "path-level"))
        size = levels[-1].count()
        if not size:
            break
    return empty
