"""The query surface: schema, search, cards, dossiers. Each is one plan of joins over the tables and not a loop of lookups.

Where the order of ties matters it is the ordinal of a node, then its id; passages go by (ordre, chunk_id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.names import ascii_fold, like_nocase
from ravelin.functions.text import excerpt
from ravelin.operators import fts, graph
from ravelin.operators.vector import knn, rrf
from ravelin.plans.config import Config
from ravelin.plans.lineage import materialise
from ravelin.plans.ontology import Ontology

_IDS = "id string, rang int"


@dataclass
class Base:
    """The tables of a knowledge base; ``encode`` turns a question into a vector (None: full text only)."""

    tables: dict[str, DataFrame]
    config: Config
    encode: Callable[[str], list[float]] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def spark(self):
        return self.nodes.sparkSession

    def mode(self) -> str:
        return "hybride" if self.encode and "chunks_vec" in self.tables else "plein texte seul"


def schema(base: Base, ontology: Ontology) -> DataFrame:
    """genre (noeud, relation, meta), nom, n, valeur: the ontology with counts, 0 for what has no row."""
    out = None
    for kind, table, known in (("noeud", "nodes", ontology.prefixes), ("relation", "edges", ontology.relations)):
        names = base.spark.createDataFrame([(k,) for k in known], "nom string")
        counts = base.tables[table].groupBy(F.col("type").alias("nom")).agg(F.count(F.lit(1)).alias("n"))
        one = names.join(counts, "nom", "full").select(F.lit(kind).alias("genre"), "nom", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("valeur"))
        out = one if out is None else out.union(one)
    if "meta" in base.tables:
        out = out.union(base.meta.select(F.lit("meta"), "cle", F.lit(None).cast("long"), "valeur"))
    return out


def lexical_nodes(base: Base, question: str, k: int) -> DataFrame:
    """id, rang of nodes whose name or alias holds the question's first 60 characters, ASCII case apart."""
    needle = question[:60]
    named = base.nodes.where(like_nocase(F.col("nom"), needle)).select("node_id")
    also = base.aliases.where(like_nocase(F.col("alias"), needle)).select("node_id")
    found = base.nodes.select("node_id", "ordinal").join(named.union(also).distinct(), "node_id", "left_semi").orderBy("ordinal", "node_id").limit(k)
    return fts.ranked(found, ["ordinal", "node_id"]).select(F.col("node_id").alias("id"), "rang")


def _vectors(base: Base, table: str, question: str, k: int) -> DataFrame:
    if not base.encode or table not in base.tables:
        return base.spark.createDataFrame([], _IDS)
    return knn(base.tables[table], base.encode(question), k).select("id", "rang")


def _text(base: Base, question: str, k: int) -> DataFrame:
    return fts.search(base.fts_postings, base.fts_statistics, question, k).select(F.col("chunk_id").alias("id"), "rang")


def _top(fused: DataFrame, k: int) -> DataFrame:
    return fts.ranked(fused.orderBy(F.desc("score"), "first_list", "first_rank", "id").limit(k), [F.desc("score"), "first_list", "first_rank", "id"])


def search_passages(base: Base, question: str, k: int = 8) -> DataFrame:
    """rang, chunk_id, score, doc_id, titre, date_document, chemin_titres, extrait, noeuds (up to 8): full text and vectors fused by rank."""
    best = _top(rrf([_text(base, question, 4 * k), _vectors(base, "chunks_vec", question, 4 * k)], base.config.rrf_k), k)
    best = best.select(F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"), "rang")
    small = F.broadcast(best)  # k rows at most
    rows = base.chunks.join(small, "chunk_id").join(base.documents.select("doc_id", "titre", "date_document"), "doc_id", "left")
    tied = base.mentions.select("chunk_id", "node_id").join(small.select("chunk_id"), "chunk_id", "left_semi").distinct().join(base.nodes.select("node_id", "nom", "type", "ordinal"), "node_id")
    linked = tied.groupBy("chunk_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ordinal", "node_id", "type", "nom"))), 1, 8).alias("noeuds"))
    return rows.join(linked, "chunk_id", "left").select("rang", "chunk_id", "score", "doc_id", "titre", "date_document", "chemin_titres", excerpt(F.col("texte"), 400).alias("extrait"), "noeuds")


def search_nodes(base: Base, question: str, k: int = 8, type_noeud: str | None = None) -> DataFrame:
    """rang, node_id, type, nom, score, fiche. The type is asked after the best k are taken, so fewer may come back."""
    best = _top(rrf([_vectors(base, "nodes_vec", question, 3 * k), lexical_nodes(base, question, k)], base.config.rrf_k), k)
    rows = base.nodes.join(F.broadcast(best.select(F.col("id").alias("node_id"), F.round("score", 4).alias("score"), "rang")), "node_id")  # k rows at most
    rows = rows.where(F.col("type") == type_noeud) if type_noeud else rows
    return rows.select("rang", "node_id", "type", "nom", "score", excerpt(F.coalesce("fiche", F.lit("")), 250).alias("fiche"))


def _dicts(df: DataFrame, *order) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def recherche(base: Base, question: str, k: int = 8, type_noeud: str | None = None) -> dict:
    k = max(1, min(int(k), 20))
    return {"question": question, "mode": base.mode(), "noeuds": _dicts(search_nodes(base, question, k, type_noeud), "rang"), "passages": _dicts(search_passages(base, question, k), "rang")}


def resolve_node(base: Base, text: str) -> str | None:
    """The id itself, else the first node (by ordinal) whose name or alias it is, ASCII case apart."""
    want = ascii_fold(F.lit(text))
    named = base.nodes.where(ascii_fold(F.col("nom")) == want).select("node_id")
    also = base.aliases.where(ascii_fold(F.col("alias")) == want).select("node_id")
    exact = base.nodes.where(F.col("node_id") == text).select("node_id", F.lit(-1).cast("long").alias("o"))
    rest = base.nodes.join(named.union(also).distinct(), "node_id", "left_semi").select("node_id", F.coalesce(F.col("ordinal").cast("long"), F.lit(0).cast("long")).alias("o"))
    found = exact.union(rest).orderBy("o", "node_id").first()
    return found.node_id if found else None


def fiche(base: Base, node: str) -> dict:
    """The node with its aliases, up to 50 links out and 50 in, and 20 sources; {"erreur": ...} when there is none."""
    node_id = resolve_node(base, node)
    if node_id is None:
        return {"erreur": f"noeud inconnu : {node}"}
    names = base.nodes.select(F.col("node_id").alias("autre"), F.col("nom").alias("autre_nom"))

    def links(own: str, other: str) -> list[dict]:
        near = base.edges.where(F.col(own) == node_id).select("type", F.col(other).alias("autre"), "citation").join(names, "autre")
        return _dicts(near.orderBy("type", "autre", "citation").limit(50), "type", "autre", "citation")

    sources = base.mentions.where(F.col("node_id") == node_id).join(base.chunks, "chunk_id").join(base.documents.select("doc_id", "titre", "date_document"), "doc_id", "left")
    sources = sources.select("doc_id", "titre", "date_document", "chunk_id", "ordre", "citation").orderBy("doc_id", "ordre", "chunk_id", "citation").limit(20)
    return {
        "noeud": base.nodes.where(F.col("node_id") == node_id).first().asDict(),
        "alias": [r.alias for r in base.aliases.where(F.col("node_id") == node_id).orderBy("alias").collect()],
        "sortantes": links("source_id", "cible_id"), "entrantes": links("cible_id", "source_id"), "sources": _dicts(sources, "doc_id", "ordre", "chunk_id", "citation"),
    }


def voisins(base: Base, node: str, profondeur: int = 1) -> dict:
    node_id = resolve_node(base, node)
    if node_id is None:
        return {"erreur": f"noeud inconnu : {node}"}
    near, ties = graph.neighbourhood(base.edges, node_id, profondeur)
    near = near.join(base.nodes.select("node_id", "type", "nom"), "node_id")
    return {"noeuds": _dicts(near.orderBy("distance", "node_id").limit(80), "distance", "node_id"), "aretes": _dicts(ties.orderBy("source_id", "type", "cible_id").limit(150), "source_id", "type", "cible_id")}


def chemin(base: Base, depart: str, arrivee: str, profondeur_max: int = 5) -> dict:
    a, b = resolve_node(base, depart), resolve_node(base, arrivee)
    if a is None or b is None:
        return {"erreur": f"noeud inconnu : {depart if a is None else arrivee}"}
    steps = _dicts(graph.shortest_path(base.edges, a, b, max(1, min(int(profondeur_max), 6))), "etape")
    return {"longueur": len(steps) if steps or a == b else None, "etapes": steps}


def seeds(base: Base, sujet: str, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """(node_id, score), (chunk_id, score): where a dossier begins."""
    direct = resolve_node(base, sujet)
    fused = _top(rrf([_vectors(base, "nodes_vec", sujet, 4 * k), lexical_nodes(base, sujet, k)], base.config.rrf_k), k)
    nodes = fused.select(F.col("id").alias("node_id"), "score")
    if direct is not None:
        nodes = base.spark.createDataFrame([(direct, 1.0)], "node_id string, score double").union(nodes.where(F.col("node_id") != direct))
    passages = _top(rrf([_text(base, sujet, 6 * k), _vectors(base, "chunks_vec", sujet, 6 * k)], base.config.rrf_k), 2 * k)
    return nodes, passages.select(F.col("id").alias("chunk_id"), "score")


def dossier_tables(base: Base, start: DataFrame, direct: DataFrame, depth: int) -> tuple[dict[str, DataFrame], bool]:
    """documents (doc_id, date_document, distance, lien, passages), chronologie, origine; was the expansion cut? ``start``: node_id, ``direct``: chunk_id.

    A document's distance is the least of its nodes'; a document met by text alone has distance 0.
    """
    c = base.config
    reached, cut = graph.expand(base.edges, start, depth, c.max_noeuds_dossier)
    by_node = base.mentions.join(reached.select("node_id", "distance", "chemin"), "node_id").select("chunk_id", "distance", "node_id", "chemin", "citation")
    by_text = direct.select("chunk_id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("node_id"), F.array().cast(dict(reached.dtypes)["chemin"]).alias("chemin"), F.lit("").alias("citation"))
    met = by_node.unionByName(by_text).groupBy("chunk_id").agg(F.min("distance").alias("distance"), F.min_by("chemin", F.struct("distance", F.col("node_id").isNull(), "node_id")).alias("chemin"), F.max("citation").alias("citation"))
    found = met.join(base.chunks.select("chunk_id", "doc_id", "ordre", "texte"), "chunk_id")
    row = F.struct("ordre", "chunk_id", excerpt(F.col("texte"), 500).alias("extrait"), "citation")
    docs = found.groupBy("doc_id").agg(F.min("distance").alias("distance"), F.min_by("chemin", F.struct("distance", "ordre", "chunk_id")).alias("lien"), F.count(F.lit(1)).alias("n_passages"), F.slice(F.sort_array(F.collect_list(row)), 1, c.max_passages_doc).alias("passages"))
    docs = docs.join(base.documents.select("doc_id", "titre", "type_document", "date_document"), "doc_id")
    docs = materialise(docs.withColumn("lien", F.when(F.col("distance") > 0, F.col("lien"))), "dossier")
    when = F.coalesce("date_document", F.lit("9999"))
    dated = docs.where("date_document IS NOT NULL")
    return {
        "noeuds": reached, "tous": docs, "documents": docs.orderBy("distance", when, "doc_id").limit(c.max_documents_dossier),
        "origine": dated.where("distance = 0").orderBy("date_document", "doc_id").limit(1), "chronologie": dated.select("date_document", "doc_id", "titre", "distance"),
    }, cut


def dossier(base: Base, sujet: str, profondeur: int = 2, k: int = 6) -> dict:
    """Everything about a subject: its nodes, documents by distance and date, the origin, the chronology and what was left out."""
    nodes, passages = seeds(base, sujet, max(1, min(int(k), 12)))
    t, cut = dossier_tables(base, nodes, passages, max(1, min(int(profondeur), 3)))
    near = t["noeuds"].join(base.nodes.select("node_id", "type", "nom"), "node_id").select("node_id", "type", "nom", "distance")
    docs = _dicts(t["documents"], "distance", F.coalesce("date_document", F.lit("9999")), "doc_id")
    total, kept = t["tous"].agg(F.count(F.lit(1)), F.sum("n_passages")).first()
    pivot = near.where("distance = 0").orderBy("distance", "node_id").first()
    return {
        "sujet": sujet, "mode": base.mode(), "pivot": pivot.node_id if pivot else None, "noeuds": _dicts(near, "distance", "node_id"), "documents": docs,
        "origine": next(iter(_dicts(t["origine"].select("doc_id", "titre", "date_document"), "doc_id")), None),
        "chronologie": _dicts(t["chronologie"], "date_document", "doc_id"),
        "couverture": {"documents": len(docs), "documents_trouves": total, "passages": kept or 0, "noeuds_tronques": cut},
    }


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
