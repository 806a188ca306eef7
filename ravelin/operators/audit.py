"""Quality audit of a knowledge base, journals of passes, and the Markdown report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.plans.config import Config
from ravelin.plans.ontology import Ontology
from ravelin.plans.tables import JOURNAL


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def type_counts(df: DataFrame, known: list[str]) -> DataFrame:
    """type, n, hors_ontologie."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("hors_ontologie", ~F.coalesce(F.col("type").isin(*known), F.lit(False)))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "cible_id")).alias("node_id")).distinct()


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "node_id", "left_anti")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, in one pass over the edges: a flag is joined in for each end."""
    ids = nodes.select("node_id").distinct()
    out = edges
    for end in ("source_id", "cible_id"):
        out = out.join(ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return out.where("_source_id IS NULL OR _cible_id IS NULL").select(*edges.columns)


def nodes_without_mention(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    return nodes.join(mentions.select("node_id"), "node_id", "left_anti")


def documents_without_entity(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    with_one = chunks.join(mentions.select("chunk_id"), "chunk_id", "left_semi").select("doc_id")
    return documents.join(with_one, "doc_id", "left_anti")


def nodes_without_card(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce(F.length("fiche"), F.lit(0)) == 0)


def vector_coverage(owners: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """n, avec_vecteur, pourcentage, alerte (below 95)."""
    have = vectors.select(F.col("id").alias(id_col)).distinct().withColumn("_v", F.lit(1))
    out = owners.select(id_col).join(have, id_col, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("avec_vecteur"))
    part = F.when(F.col("n") > 0, F.round(100.0 * F.col("avec_vecteur") / F.col("n"), 1)).otherwise(100.0)
    return out.withColumn("pourcentage", part).withColumn("alerte", F.col("pourcentage") < 95)


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, degre; a self loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_id", "cible_id"))).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degre"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 10, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The k nodes of most edges; equal degrees by ``name`` of the id, and the ids are given as that."""
    found = degrees(edges).join(nodes.select("node_id", "type", "nom"), "node_id")
    return found.withColumn("node_id", name(F.col("node_id"))).orderBy(F.desc("degre"), "node_id").limit(k)


def card_sample(nodes: DataFrame, mentions: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """k cards for a manual look, the same on every run, each with its first citation."""
    some = nodes.where(F.length("fiche") > 0).orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(k)
    quote = mentions.where("citation <> ''").groupBy("node_id").agg(F.min_by("citation", "chunk_id").alias("citation"))
    return some.join(quote, "node_id", "left").select("node_id", "type", "nom", "fiche", "citation")


def audit(tables: dict[str, DataFrame], ontology: Ontology) -> DataFrame:
    """controle, n, alerte: each check with its count in one frame."""
    nodes, edges = tables["nodes"], tables["edges"]
    checks = {
        "noeuds_isoles": isolated_nodes(nodes, edges), "aretes_orphelines": dangling_edges(nodes, edges), "noeuds_sans_mention": nodes_without_mention(nodes, tables["mentions"]),
        "documents_sans_entite": documents_without_entity(tables["documents"], tables["chunks"], tables["mentions"]), "noeuds_sans_fiche": nodes_without_card(nodes),
        "noeuds_hors_ontologie": nodes.where(~F.col("type").isin(*ontology.prefixes)), "aretes_hors_ontologie": edges.where(~F.col("type").isin(*ontology.relations)),
    }
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    out = row_counts(checks).withColumnRenamed("table", "controle").crossJoin(F.broadcast(total))  # one row
    alert = F.when(F.col("controle") == "noeuds_isoles", F.col("n") > 0.4 * F.col("total")).when(F.col("controle").isin("aretes_orphelines", "noeuds_hors_ontologie", "aretes_hors_ontologie"), F.col("n") > 0)
    return out.select("controle", "n", F.coalesce(alert, F.lit(False)).alias("alerte"))


class Journal:
    """The record of a pass, written whether the pass ends well or not."""

    def __init__(self, spark: SparkSession, folder: str, passe: str, config: Config | None = None):
        self.spark, self.folder, self.passe = spark, folder.rstrip("/"), passe
        self.limit = (config or Config()).max_incidents
        self.counters: dict[str, int] = {}
        self.incidents: list[tuple[str, str, str]] = []
        self.lost = 0

    def count(self, key: str, n: int = 1) -> None:
        self.counters[key] = self.counters.get(key, 0) + n

    def incident(self, level: str, subject: str, detail: str) -> None:
        """``erreur`` or ``avertissement``; beyond the limit incidents are counted only."""
        self.count(level)
        if len(self.incidents) < self.limit:
            self.incidents.append((level, subject, detail[:2000]))
        else:
            self.lost += 1

    def __enter__(self) -> Journal:
        self.began = time.time()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        status = "echec" if error else "avertissements" if self.counters.get("erreur") else "ok"
        if error:
            self.incident("erreur", self.passe, f"{kind.__name__}: {error}")
        row = (self.passe, status, datetime.now(UTC).isoformat(timespec="seconds"), round(time.time() - self.began, 1), self.counters, self.incidents, self.lost)
        record = self.spark.createDataFrame([row], JOURNAL)
        from ravelin.operators.store import write_text

        write_text(self.spark, f"{self.folder}/{self.passe}.json", record.toJSON().first())
        return False


def global_status(journals: DataFrame, expected: list[str]) -> str:
    """echec, absent, avertissements or ok, the worst that holds."""
    seen = {r.passe: r.statut for r in journals.select("passe", "statut").collect()}  # one row a pass
    states = [seen.get(p, "absent") for p in expected]
    return next((s for s in ("echec", "absent", "avertissements") if s in states), "ok")


def incident_report(journals: DataFrame) -> DataFrame:
    return journals.select("passe", F.explode("incidents").alias("i")).select("passe", "i.niveau", "i.sujet", "i.detail")


def report(tables: dict[str, DataFrame], ontology: Ontology, journals: DataFrame, expected: list[str]) -> str:
    """The report as Markdown, from small results."""
    lines = ["# Rapport", "", f"Statut : {global_status(journals, expected)}", "", "| passe | statut | duree (s) | compteurs |", "| --- | --- | --- | --- |"]
    own = journals.orderBy("passe").collect()
    lines += [f"| {r.passe} | {r.statut} | {r.duree_s} | {json.dumps(r.compteurs or {}, sort_keys=True)} |" for r in own]
    lines += ["", f"Duree totale : {sum(r.duree_s or 0 for r in own):.1f} s", "", "| controle | n | alerte |", "| --- | --- | --- |"]
    lines += [f"| {r.controle} | {r.n} | {'oui' if r.alerte else 'non'} |" for r in audit(tables, ontology).orderBy("controle").collect()]
    lines += ["", "| noeud | degre |", "| --- | --- |", *[f"| {r.nom} | {r.degre} |" for r in top_degrees(tables["nodes"], tables["edges"]).collect()]]
    for title, name, known in (("type de noeud", "nodes", ontology.prefixes), ("type de relation", "edges", ontology.relations)):
        lines += ["", f"| {title} | n | hors ontologie |", "| --- | --- | --- |"]
        lines += [f"| {r.type} | {r.n} | {'oui' if r.hors_ontologie else 'non'} |" for r in type_counts(tables[name], list(known)).orderBy(F.desc("n"), "type").collect()]
    for owner, name, key in (("chunks", "chunks_vec", "chunk_id"), ("nodes", "nodes_vec", "node_id")):
        if name in tables:
            c = vector_coverage(tables[owner], tables[name], key).first()
            lines += ["", f"Vecteurs de {owner} : {c.avec_vecteur} / {c.n} ({c.pourcentage} %){', alerte' if c.alerte else ''}"]
    for r in card_sample(tables["nodes"], tables["mentions"]).collect():
        lines += ["", f"**{r.nom}** ({r.type}) : {r.fiche}", f"> {r.citation or ''}"]
    lines += ["", *[f"* {r.passe}, {r.niveau}: {r.sujet} {r.detail}" for r in incident_report(journals).collect()]]
    return "\n".join(lines) + "\n"
