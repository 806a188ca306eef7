"""Entity resolution: grouping by name key, lossless fuzzy candidates, arbitration, components, canonical nodes, aliases, mentions and edges.

Two names can score 80 only if they share a token, or are at most five signs long, or share two neighbouring signs: with l
the longer length, a ratio of 0.8 means at most 0.4 l insertions and deletions, which break at most 0.8 l of its l - 1
pairs of neighbours. Those three are the blocking keys, so candidates come from an equi-join and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.names import name_key, name_key_column, stable_id, token_set_ratio
from ravelin.plans.components import components
from ravelin.plans.config import Config
from ravelin.plans.lineage import materialise
from ravelin.plans.ontology import FALLBACK, Ontology

#: (type, a, b, score) -> the pairs (type, a, b) that are one entity.
Arbiter = Callable[[DataFrame], DataFrame]


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _blocking_keys(norm: Column) -> Column:
    tokens = F.split(norm, " ")
    line = F.array_join(F.array_sort(F.array_distinct(tokens)), " ")
    pairs = F.when(F.length(line) > 1, F.transform(F.sequence(F.lit(1), F.length(line) - 1), lambda i: F.concat(F.lit("2"), F.substr(line, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    short = F.when(F.length(line) <= 5, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(tokens, lambda t: F.concat(F.lit("t"), t)), pairs, short))


def fuzzy_pairs(names: DataFrame, cutoff: float = 80.0, per_name: int = 10) -> DataFrame:
    """type, a, b, score for a < b: of each name the best ``per_name`` among the later ones that reach the cutoff; equal scores by b."""
    keyed = names.select("type", "norm").where(F.length("norm") > 0).distinct().select("type", "norm", F.explode(_blocking_keys(F.col("norm"))).alias("key"))
    left, right = keyed.select("type", "key", F.col("norm").alias("a")), keyed.select("type", "key", F.col("norm").alias("b"))
    pairs = left.join(right, ["type", "key"]).where("a < b").select("type", "a", "b").distinct()
    scored = pairs.withColumn("score", _ratio("a", "b")).where(F.col("score") >= cutoff)
    best = Window.partitionBy("type", "a").orderBy(F.desc("score"), "b")
    return scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_name).drop("_r")


def attributes(rows: DataFrame, column: str = "attributs") -> DataFrame:
    """The rows with k, v for each attribute of the JSON object in ``column``; v is its value as JSON, so numbers, booleans, arrays and objects stay what they are."""
    from pyspark.sql import functions as fn

    parsed = rows.withColumn("_v", F.try_parse_json(column)).where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    return parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(fn.col("_v").outer())).select(*rows.columns, F.col("key").alias("k"), F.to_json("value").alias("v"))


def json_object(entries: Column) -> Column:
    """A JSON object from an array of (k, v) with v as JSON."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def _first_attributes(entities: DataFrame) -> DataFrame:
    """type, norm, k, v: for each attribute the first value seen."""
    each = attributes(entities.select("type", "norm", "ordinal", "attributs"))
    return each.groupBy("type", "norm", "k").agg(F.min_by("v", "ordinal").alias("v"))


def resolve(entities: DataFrame, relations: DataFrame, ontology: Ontology, config: Config | None = None, arbiter: Arbiter | None = None) -> dict[str, DataFrame]:
    """nodes, aliases, mentions, edges and counters (cle, valeur).

    ``entities``: type, nom, attributs, chunk_id, citation, ordinal; ``relations``: type, source_type, source_nom, cible_type, cible_nom, chunk_id,
    citation, ordinal. Without an arbiter doubtful pairs stay apart. Names without a letter are no entities, but a
    relation that names one has an implicit node, one for each type.
    """
    config, spark, titles = config or Config(), entities.sparkSession, ontology.titles
    prefix = F.create_map(*[F.lit(x) for kv in ontology.prefixes.items() for x in kv])
    key = lambda n, t: name_key_column(F.col(n), F.col(t) == "personne", titles)
    ents = materialise(entities.withColumn("norm", key("nom", "type")).where(F.length("norm") > 0), "resolve-entities")
    groups = ents.select("type", "norm").distinct()
    pairs = materialise(fuzzy_pairs(groups, config.seuil_arbitrage, config.candidats_par_nom), "resolve-pairs")
    sure, doubtful = pairs.where(F.col("score") >= config.seuil_fusion), pairs.where(F.col("score") < config.seuil_fusion)
    agreed = arbiter(doubtful).select("type", "a", "b") if arbiter else pairs.limit(0).select("type", "a", "b")
    rules = [(t, name_key(a, titles if t == "personne" else ()), name_key(b, titles if t == "personne" else ())) for t, a, b in ontology.equivalences]
    decreed = spark.createDataFrame(rules, "type string, a string, b string")
    for side in ("a", "b"):
        decreed = decreed.join(groups.withColumnRenamed("norm", side), ["type", side], "left_semi")
    same = sure.select("type", "a", "b").unionByName(agreed).unionByName(decreed)
    entry = lambda n: F.concat("type", F.lit("|"), F.col(n))
    labels = components(same.select(entry("a").alias("a"), entry("b").alias("b")))
    where = groups.withColumn("id", entry("norm")).join(labels, "id", "left").select("type", "norm", F.coalesce("label", "id").alias("rep"))
    where = materialise(where.withColumn("node_id", stable_id(prefix[F.col("type")], F.col("rep"), config.id_hex)), "resolve-nodes")

    placed = ents.join(where, ["type", "norm"])
    names = placed.groupBy("node_id", "type", "nom").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("o"))
    shown = names.groupBy("node_id", "type").agg(F.max_by("nom", F.struct("n", F.length("nom"), -F.col("o"))).alias("nom"), F.min("o").alias("ordinal"))
    aliases = names.join(shown.select("node_id", F.col("nom").alias("shown")), "node_id").where("nom <> shown").select(F.col("nom").alias("alias"), "node_id").distinct()
    own = _first_attributes(ents).join(where, ["type", "norm"]).select("node_id", "norm", "k", "v")
    own = own.groupBy("node_id", "k").agg(F.min_by("v", "norm").alias("v")).groupBy("node_id").agg(json_object(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributs"))
    mentions = placed.where(F.length("chunk_id") > 0).select("node_id", "chunk_id", F.coalesce("citation", F.lit("")).alias("citation")).distinct()

    rels = relations.withColumns({"s_norm": key("source_nom", "source_type"), "c_norm": key("cible_nom", "cible_type")})
    ends = rels.select(F.col("source_type").alias("type"), F.col("s_norm").alias("norm"), F.col("source_nom").alias("nom"), "ordinal").unionByName(rels.select(F.col("cible_type").alias("type"), F.col("c_norm").alias("norm"), F.col("cible_nom").alias("nom"), "ordinal"))
    ends = ends.where(F.col("type").isin(*ontology.prefixes) & F.col("norm").isNotNull())
    implicit = ends.join(groups, ["type", "norm"], "left_anti").groupBy("type", "norm").agg(F.min_by("nom", "ordinal").alias("nom"), F.min("ordinal").alias("ordinal"))
    implicit = materialise(implicit.withColumn("node_id", stable_id(prefix[F.col("type")], entry("norm"), config.id_hex)), "resolve-implicit")
    nodes = shown.join(own, "node_id", "left").select("node_id", "type", "nom", F.coalesce("attributs", F.lit("{}")).alias("attributs"), F.lit(None).cast("string").alias("fiche"), "ordinal")
    nodes = nodes.unionByName(implicit.select("node_id", "type", "nom", F.lit('{"implicite":true}').alias("attributs"), F.lit(None).cast("string").alias("fiche"), "ordinal"))

    known = where.select("type", "norm", "node_id").unionByName(implicit.select("type", "norm", "node_id"))
    src = known.select(F.col("type").alias("source_type"), F.col("norm").alias("s_norm"), F.col("node_id").alias("source_id"))
    dst = known.select(F.col("type").alias("cible_type"), F.col("norm").alias("c_norm"), F.col("node_id").alias("cible_id"))
    tied = rels.join(src, ["source_type", "s_norm"]).join(dst, ["cible_type", "c_norm"])
    edges = dedupe_edges(constrain(tied, ontology))
    out = {"nodes": nodes, "aliases": aliases, "mentions": mentions, "edges": edges}
    out = {n: materialise(d, f"resolve-{n}") for n, d in out.items()}
    counts = [(n, d.count()) for n, d in out.items()] + [("implicites", implicit.count()), ("paires_arbitrees", doubtful.count() if arbiter else 0), ("fusions_arbitrees", agreed.count() if arbiter else 0)]
    return out | {"counters": spark.createDataFrame(counts, "cle string, valeur long")}


def constrain(edges: DataFrame, ontology: Ontology) -> DataFrame:
    """Unknown types and self loops go; a relation between types that it doesn't allow becomes the fallback."""
    rules = F.broadcast(ontology.relations_frame(edges.sparkSession))  # as many rows as relation types
    both = edges.where("source_id <> cible_id").join(rules, "type")
    fits = lambda allowed, kind: F.array_contains(allowed, "*") | F.array_contains(F.col(allowed), F.col(kind))
    ok = fits("sources", "source_type") & fits("cibles", "cible_type")
    return both.withColumn("type", F.when(ok, F.col("type")).otherwise(FALLBACK)).drop("sources", "cibles")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge (by ordinal, then citation) of each (source, type, target, passage); an empty passage is none."""
    clean = edges.withColumns({"chunk_id": F.nullif("chunk_id", F.lit("")), "citation": F.coalesce("citation", F.lit(""))})
    first = clean.groupBy("source_id", "type", "cible_id", "chunk_id").agg(F.min(F.struct("ordinal", "citation")).alias("_f"))
    return first.select("source_id", "type", "cible_id", "chunk_id", F.col("_f.citation").alias("citation"), F.col("_f.ordinal").alias("ordinal"))
