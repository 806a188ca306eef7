"""The registered queries of the knowledge-base operators, each over whole tables, with SQL where it can say the same."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.functions.names import name_key_column, text_fingerprint
from ravelin.operators import audit, enrich, extract, fts, graph, knowledge, resolve, sqlgate, store, vector
from ravelin.plans import star
from ravelin.plans.components import components
from ravelin.plans.config import Config
from ravelin.plans.lineage import broadcast_below, materialise
from ravelin.plans.ontology import Ontology, Relation, default_ontology
from ravelin.plans.tables import TABLES
from ravelin.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# full text, vectors, fusion
QUESTION, PHRASE = "the tion thble", "les que anding"


def _bm25_sql(words: list[str], every: bool, tail: str = "") -> str:
    listed = ", ".join(f"('{w}', {i})" for i, w in enumerate(words))
    return rf"""
WITH q(w, i) AS (VALUES {listed}),
tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\pL\pN]+')) w FROM documents),
dl AS (SELECT doc_id, count(*) dl FROM tk GROUP BY 1),
av AS (SELECT (SELECT sum(dl) FROM dl) * 1.0 / (SELECT count(*) FROM documents) a, (SELECT count(*) FROM documents) n),
tf AS (SELECT doc_id, w, i, count(*) tf FROM tk JOIN q USING (w) GROUP BY ALL), df AS (SELECT w, count(*) df FROM tf GROUP BY 1),
s AS (SELECT tf.doc_id, -list_sum(list(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) ORDER BY i)) AS score, count(*) AS m
      FROM tf JOIN df USING (w) JOIN dl USING (doc_id), av GROUP BY 1),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) - 1 AS rang FROM s {f"WHERE m = {len(words)}" if every else ""})
SELECT doc_id, round(score, 6) AS score, rang::INTEGER AS rang FROM r {tail}"""


def _search(spark, sf_dir, question, k, mode):
    docs = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("texte"))
    index, stats = fts.build_index(docs, text_cols=("texte",))
    return fts.search(index, stats, question, k, mode).select(F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "rang")


@query(_bm25_sql(["the", "thble"], True, "WHERE rang < 10"))
def fts_topk(spark, sf_dir):
    return _search(spark, sf_dir, "the thble", 10, "and")


@query(_bm25_sql(["les", "que"], False))
def fts_or(spark, sf_dir):
    return _search(spark, sf_dir, "Les, que !", None, "or")


@query(_bm25_sql(["the", "and", "of"], True))
def fts_and(spark, sf_dir):
    return _search(spark, sf_dir, "THE and of", None, "and")


_DIST = "list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT v.vec_id, round({_DIST}, 5) AS distance, (row_number() OVER (ORDER BY {_DIST}, v.vec_id) - 1)::INTEGER AS rang FROM embeddings v, q QUALIFY rang < 10")
def knn_l2(spark, sf_dir):
    vectors = star.table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").first()
    return vector.knn(vectors, one.embedding, 10, "vec_id").select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), "rang")


@query(f"SELECT q.vec_id AS query_id, v.vec_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 6), v.vec_id) - 1)::INTEGER AS rang FROM embeddings v, embeddings q QUALIFY rang < 5")
def knn_neighbours(spark, sf_dir):
    vectors = star.table(spark, sf_dir, "embeddings")
    return vector.knn_all(vectors, vectors, 5, "vec_id").select("query_id", F.col("id").alias("vec_id"), "rang")


@query(f"""
WITH a AS (SELECT doc_id AS id, rang FROM ({_bm25_sql(["the", "thble"], True, "WHERE rang < 40")})),
b AS (WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT v.vec_id AS id, row_number() OVER (ORDER BY {_DIST}, v.vec_id) - 1 AS rang FROM embeddings v, q QUALIFY rang < 40)
SELECT id, round(list_sum(list(1.0::DOUBLE / (60 + rang) ORDER BY l)), 9) AS score, arg_min(l, l)::INTEGER AS first_list, arg_min(rang, l)::INTEGER AS first_rank
FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY id""")
def rrf_fusion(spark, sf_dir):
    vectors = star.table(spark, sf_dir, "embeddings")
    near = vector.knn(vectors, vectors.where("vec_id = 0").first().embedding, 40, "vec_id").select("id", "rang")
    found = _search(spark, sf_dir, "the thble", 40, "and").select(F.col("doc_id").alias("id"), "rang")
    return vector.rrf([found, near]).withColumn("score", F.round("score", 9))


# graph
_STAR = Ontology({t: p for t, p in zip(star.TYPES, ("REG", "NAT", "CUS", "SUP", "PRT", "ORD"), strict=True)}, {r: Relation(("*",), ("*",)) for r in ("appartient_a", "situe_en", "passee_par", "contient", "fournie_par")})


def _base(spark, sf_dir, **tables):
    """The star as a base: orders are documents of one passage each, which mention their customer and, when urgent, its nation."""
    chunks, mentions = _order_mentions(spark, sf_dir)
    nodes = star.nodes(spark, sf_dir).withColumns({"attributs": F.lit("{}"), "fiche": F.when(F.col("ordinal") % 3 != 0, F.col("nom"))})
    aliases = star.table(spark, sf_dir, "customer").select(F.concat(F.lit("Client "), "c_custkey").alias("alias"), star.node_id("customer", "c_custkey").alias("node_id"))
    own = {
        "nodes": nodes, "edges": star.edges(spark, sf_dir), "aliases": aliases, "mentions": mentions.withColumn("citation", F.lit("")),
        "chunks": chunks.select("chunk_id", "doc_id", F.lit(0).alias("ordre"), F.lit("").alias("chemin_titres"), F.lit("commande").alias("texte")),
        "documents": chunks.select("doc_id", F.lit("commande").alias("titre"), F.lit("document").alias("type_document"), "date_document"),
    }
    return knowledge.Base(own | tables, Config())


@query(f"WITH {star.NODES_SQL}, {star.edges_sql()} SELECT 'noeud' AS genre, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', type, count(*) FROM edges GROUP BY type")
def schema_counts(spark, sf_dir):
    base = _base(spark, sf_dir)
    return knowledge.schema(base, _STAR).where("genre <> 'meta'").select("genre", F.col("nom").alias("type"), "n")


def _numbered(spark, sf_dir, relations=None):
    """(nodes, edges) by the numbers of the nodes; the ids are put in at the end."""
    return star.nodes(spark, sf_dir, star.number), star.edges(spark, sf_dir, relations, star.number)


@query(f"WITH {star.NODES_SQL}, {star.edges_sql()}, d AS (SELECT de AS node_id, count(*) AS degre FROM und GROUP BY 1) SELECT node_id, type, nom, degre FROM d JOIN nodes USING (node_id) ORDER BY degre DESC, node_id LIMIT 10")
def degree_top10(spark, sf_dir):
    return audit.top_degrees(*_numbered(spark, sf_dir), name=star.named).select("node_id", "type", "nom", "degre")


_LINES = {"contient"}


@query(f"WITH {star.NODES_SQL}, {star.edges_sql(_LINES)} SELECT node_id, type FROM nodes WHERE NOT EXISTS (SELECT 1 FROM und WHERE de = node_id)")
def isolated_nodes(spark, sf_dir):
    """By the order lines alone: orders without a line and what lines don't name."""
    return star.with_names(audit.isolated_nodes(*_numbered(spark, sf_dir, _LINES)).select("node_id", "type"), "node_id")


@query(f"WITH {star.NODES_SQL}, {star.edges_sql()} SELECT source_id, type, cible_id FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes WHERE type <> 'supplier') OR cible_id NOT IN (SELECT node_id FROM nodes WHERE type <> 'supplier')")
def dangling_edges(spark, sf_dir):
    """Against a base that lost its suppliers."""
    nodes, edges = _numbered(spark, sf_dir)
    return star.with_names(audit.dangling_edges(nodes.where("type <> 'supplier'"), edges), "source_id", "cible_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def documents_without_entity(spark, sf_dir):
    docs, labels = star.table(spark, sf_dir, "documents").select("doc_id"), star.table(spark, sf_dir, "labels")
    return audit.documents_without_entity(docs, docs.select("doc_id", F.col("doc_id").alias("chunk_id")), labels.select(F.col("doc_id").alias("chunk_id")))


_START, _START_NUMBER = star.id_of("nation", 7), star.number_of("nation", 7)
_LEVELS = f"""n0 AS (SELECT '{_START}' AS id), n1 AS (SELECT DISTINCT vers AS id FROM und JOIN n0 ON de = id WHERE vers NOT IN (SELECT id FROM n0)),
n2 AS (SELECT DISTINCT vers AS id FROM und JOIN n1 ON de = id WHERE vers NOT IN (SELECT id FROM n0 UNION ALL SELECT id FROM n1))"""


@query(f"WITH {star.edges_sql()}, {_LEVELS} SELECT id AS node_id, 0 AS distance FROM n0 UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2")
def voisins_nodes(spark, sf_dir):
    return star.with_names(graph.neighbourhood(_numbered(spark, sf_dir)[1], _START_NUMBER, 2)[0], "node_id")


@query(f"WITH {star.edges_sql()}, {_LEVELS}, i AS (SELECT id FROM n0 UNION ALL SELECT id FROM n1) SELECT DISTINCT source_id, type, cible_id FROM edges WHERE source_id IN (SELECT id FROM i) OR cible_id IN (SELECT id FROM i)")
def voisins_edges(spark, sf_dir):
    return star.with_names(graph.neighbourhood(_numbered(spark, sf_dir)[1], _START_NUMBER, 2)[1], "source_id", "cible_id")


_FROM, _TO = star.id_of("customer", 1), star.id_of("supplier", 3)
_PARENT = "SELECT vers AS id, min(de || '|' || relation || '|' || sens) AS p FROM und JOIN {front} f ON de = f.id WHERE vers NOT IN (SELECT id FROM {seen}) GROUP BY 1"
_STEPS = "p0 AS (SELECT '" + _FROM + "' AS id, '' AS p), s0 AS (SELECT id FROM p0), " + ", ".join(
    f"p{k} AS ({_PARENT.format(front=f'p{k - 1}', seen=f's{k - 1}')}), s{k} AS (SELECT id FROM s{k - 1} UNION ALL SELECT id FROM p{k})" for k in range(1, 5)
)
_BACK = ", ".join(f"t{k} AS (SELECT {k} AS etape, id AS vers, p FROM p{k} WHERE id IN " + (f"(SELECT split_part(p, '|', 1) FROM t{k + 1})" if k < 4 else f"('{_TO}')") + (f" OR (id = '{_TO}')" if k < 4 else "") + ")" for k in range(4, 0, -1))


@query(f"WITH {star.edges_sql()}, {_STEPS}, {_BACK}, t AS ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(1, 5))}) SELECT etape, split_part(p, '|', 1) AS de, split_part(p, '|', 2) AS relation, split_part(p, '|', 3) AS sens, vers FROM t")
def chemin(spark, sf_dir):
    return star.with_names(graph.shortest_path(_numbered(spark, sf_dir)[1], star.number_of("customer", 1), star.number_of("supplier", 3), 4, star.named), "de", "vers")


_PLACES = {"appartient_a", "situe_en"}
_REGION = star.id_of("region", 0)


def _order_mentions(spark, sf_dir):
    """Orders as dated documents of one passage, which mention their customer, and its nation when urgent."""
    orders, customers = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "customer")
    who = orders.select(F.col("o_orderkey").alias("chunk_id"), star.node_id("customer", "o_custkey").alias("node_id"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_document")), who.union(urgent.select("o_orderkey", star.node_id("nation", "c_nationkey")))


_DOSSIER = f"""{star.edges_sql(_PLACES)}, n0 AS (SELECT '{_REGION}' AS id), n1 AS (SELECT DISTINCT vers AS id FROM und JOIN n0 ON de = id),
n2 AS (SELECT DISTINCT vers AS id FROM und JOIN n1 ON de = id WHERE vers NOT IN (SELECT id FROM n0 UNION ALL SELECT id FROM n1)),
reached AS (SELECT id, 1 AS d FROM n1 UNION ALL SELECT id, 2 FROM n2),
m AS (SELECT o_orderkey, {star.sql_id("customer", "o_custkey")} AS id FROM orders UNION ALL SELECT o_orderkey, {star.sql_id("nation", "c_nationkey")} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
docs AS (SELECT o_orderkey AS doc_id, min(d)::INTEGER AS distance FROM m JOIN reached USING (id) GROUP BY 1)"""


def _dossier(spark, sf_dir):
    base = _base(spark, sf_dir, edges=star.edges(spark, sf_dir, _PLACES))
    base.config = dataclasses.replace(base.config, max_noeuds_dossier=2_000_000_000)
    direct = spark.createDataFrame([], "chunk_id long")
    return knowledge.dossier_tables(base, spark.createDataFrame([(_REGION,)], "node_id string"), direct, 2)[0]


@query(f"WITH {_DOSSIER} SELECT doc_id, distance, 1::BIGINT AS n_passages FROM docs")
def dossier_docs(spark, sf_dir):
    return _dossier(spark, sf_dir)["tous"].select("doc_id", "distance", "n_passages")


@query(f"WITH {_DOSSIER} SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_document, doc_id, distance FROM docs JOIN orders ON o_orderkey = doc_id")
def dossier_chronology(spark, sf_dir):
    return _dossier(spark, sf_dir)["chronologie"].select("date_document", "doc_id", "distance")


@query(f"WITH {_DOSSIER}, u AS (SELECT doc_id, 1 AS etape FROM docs WHERE distance > 0 UNION ALL SELECT doc_id, 2 FROM docs WHERE distance > 1) SELECT doc_id, count(*)::INTEGER AS longueur FROM u GROUP BY 1")
def dossier_links(spark, sf_dir):
    """How many steps explain why a document is in the dossier: as many as its distance."""
    return _dossier(spark, sf_dir)["tous"].where("lien IS NOT NULL").select("doc_id", F.size("lien").alias("longueur"))


@query(rf"""WITH {star.NODES_SQL}, hit AS (SELECT node_id, nom, key FROM (SELECT {star.sql_id("customer", "c_custkey")} AS node_id, c_name AS nom, c_custkey AS key FROM customer) WHERE lower(nom) LIKE '%client 1%' OR 'client ' || key LIKE '%client 1%')
SELECT node_id, (row_number() OVER (ORDER BY key, node_id) - 1)::INTEGER AS rang FROM hit QUALIFY rang < 25""")
def lexical_nodes(spark, sf_dir):
    return knowledge.lexical_nodes(_base(spark, sf_dir), "CLIENT 1", 25).select(F.col("id").alias("node_id"), "rang")


@query(f"WITH {star.NODES_SQL}, m AS (SELECT {star.sql_id('customer', 'o_custkey')} AS id FROM orders UNION SELECT {star.sql_id('nation', 'c_nationkey')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT') SELECT node_id, type FROM nodes WHERE node_id NOT IN (SELECT id FROM m)")
def nodes_without_mention(spark, sf_dir):
    base = _base(spark, sf_dir)
    return audit.nodes_without_mention(base.nodes, base.mentions).select("node_id", "type")


_KEYS = " UNION ALL ".join(f"SELECT {key} AS k, '{kind}' AS type FROM {kind}" for _, kind, key, _ in star._NODES)


@query(f"SELECT type, count(*) AS n FROM ({_KEYS}) WHERE k % 3 = 0 GROUP BY 1")
def nodes_without_card(spark, sf_dir):
    return audit.nodes_without_card(_base(spark, sf_dir).nodes).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT \'documents\' AS "table", count(*) AS n FROM documents UNION ALL SELECT \'orders\', count(*) FROM orders UNION ALL SELECT \'lineitem\', count(*) FROM lineitem')
def row_counts(spark, sf_dir):
    return audit.row_counts({t: star.table(spark, sf_dir, t) for t in ("documents", "orders", "lineitem")})


@query(f"WITH {star.edges_sql()} SELECT type, count(*) AS n, type = 'situe_en' AS hors_ontologie FROM edges GROUP BY type")
def type_counts(spark, sf_dir):
    """Against an ontology that doesn't know one of the relations."""
    return audit.type_counts(star.edges(spark, sf_dir), sorted(set(_STAR.relations) - {"situe_en"}))


@query("WITH v AS (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 4 <> 0) SELECT count(*) AS n, count(vec_id) AS avec_vecteur, round(100.0 * count(vec_id) / count(*), 1)::DOUBLE AS pourcentage, 100.0 * count(vec_id) / count(*) < 95 AS alerte FROM documents LEFT JOIN v ON doc_id = vec_id")
def vector_coverage(spark, sf_dir):
    """Documents against vectors of which every fourth is missing."""
    vectors = star.table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"))
    return audit.vector_coverage(star.table(spark, sf_dir, "documents"), vectors, "doc_id")


@query("SELECT vec_id AS id, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def vector_load(spark, sf_dir):
    """Vectors of known owners with the right size: owners are the even documents."""
    vectors = star.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    dim = vectors.select(F.size("embedding")).first()[0]
    good, _ = store.good_vectors(vectors, star.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id"), dim)
    return good.select("id", F.size("embedding").alias("dim"))


@query(f"SELECT {star.sql_id('customer', 'c_custkey')} AS node_id, 'CUSTOMER : ' || c_name || coalesce(chr(10) || left(q, 1500), '') AS contexte FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS q FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def node_contexts(spark, sf_dir):
    """Customers with the priorities of their orders as citations; no passage fits, so the contexts are heads and citations."""
    nodes = star.nodes(spark, sf_dir).where("type = 'customer'")
    orders = star.table(spark, sf_dir, "orders").select(star.node_id("customer", "o_custkey").alias("node_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("citation"))
    return enrich.node_contexts(nodes, orders, orders.select("chunk_id", F.lit("passage").alias("texte")), limit=0)


# load and resolution
@query("SELECT l_orderkey AS source_id, l_partkey AS cible_id, min(l_linenumber)::BIGINT AS ordinal FROM lineitem GROUP BY ALL")
def edge_dedupe(spark, sf_dir):
    rows = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.lit("contient").alias("type"), F.col("l_partkey").alias("cible_id"), F.lit("").alias("chunk_id"), F.lit(None).cast("string").alias("citation"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return resolve.dedupe_edges(rows).select("source_id", "cible_id", "ordinal")


@query("SELECT DISTINCT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::BIGINT AS l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 10)")
def fk_prune(spark, sf_dir):
    """Lines as edges from orders to parts, in a base without the small parts."""
    lines = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.concat_ws("#", F.lit("ligne"), "l_linenumber").alias("type"), F.concat(F.lit("P"), "l_partkey").alias("cible_id"), F.lit("").alias("chunk_id"), F.lit("").alias("citation"))
    nodes = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("node_id")).union(star.table(spark, sf_dir, "part").where("p_size >= 10").select(F.concat(F.lit("P"), "p_partkey")))
    none = {t: spark.createDataFrame([], TABLES[t]) for t in ("documents", "chunks", "aliases", "mentions")}
    kept, _ = store.prune(none | {"nodes": nodes, "edges": lines})
    return kept["edges"].select(F.col("source_id").cast("long").alias("l_orderkey"), F.substring_index("type", "#", -1).cast("long").alias("l_linenumber"), F.expr("substring(cible_id, 2)").cast("long").alias("l_partkey"))


_RULES = Ontology(_STAR.prefixes, _STAR.relations | {"appartient_a": Relation(("nation",), ("region",)), "situe_en": Relation(("customer",), ("nation",)), "liee_a": Relation(("*",), ("*",))})


@query(f"WITH {star.NODES_SQL}, {star.edges_sql()} SELECT source_id, CASE WHEN e.type = 'situe_en' AND a.type <> 'customer' THEN 'liee_a' ELSE e.type END AS type, cible_id FROM edges e JOIN nodes a ON a.node_id = source_id")
def constraint_downgrade(spark, sf_dir):
    """Suppliers are not allowed as sources of situe_en."""
    nodes, ends = _numbered(spark, sf_dir)
    kinds = nodes.select("node_id", "type")
    for side, kind in (("source_id", "source_type"), ("cible_id", "cible_type")):
        ends = ends.join(kinds.select(F.col("node_id").alias(side), F.col("type").alias(kind)), side)
    return star.with_names(resolve.constrain(ends, _RULES).select("source_id", "type", "cible_id"), "source_id", "cible_id")


@query(f"WITH RECURSIVE {star.edges_sql()}, m AS (SELECT min(de) AS id FROM und), r(id) AS (SELECT id FROM m UNION SELECT vers FROM und JOIN r ON de = r.id) SELECT DISTINCT de AS id, CASE WHEN de IN (SELECT id FROM r) THEN (SELECT id FROM m) END AS label FROM und")
def connected_components(spark, sf_dir):
    """Over all relations, by the distributed rounds: chains from lines over orders, customers and nations to regions. All hang together, which the SQL shows by reaching them from the least."""
    found = materialise(components(_numbered(spark, sf_dir)[1], "source_id", "cible_id", one_task=0), "components-numbered")
    least = materialise(found.groupBy("label").agg(F.min(star.named(F.col("id"))).alias("least")), "components-least")  # labels are the least of the ids, not of the numbers
    return found.join(broadcast_below(least, least.count(), 500_000), "label").select(star.named(F.col("id")).alias("id"), F.col("least").alias("label"))


@query()
def fuzzy_pairs(spark, sf_dir):
    names = star.table(spark, sf_dir, "part").select(F.lit("module").alias("type"), name_key_column(F.col("p_name"), F.lit(False), ()).alias("norm"))
    return resolve.fuzzy_pairs(names)


@query()
def resolve_names(spark, sf_dir):
    parts = star.table(spark, sf_dir, "part")
    ents = parts.select(F.lit("module").alias("type"), F.col("p_name").alias("nom"), F.to_json(F.struct("p_brand", "p_size")).alias("attributs"), F.concat(F.lit("P#"), "p_partkey").alias("chunk_id"), F.col("p_type").alias("citation"), F.col("p_partkey").cast("long").alias("ordinal"))
    rels = parts.select(F.lit("concerne").alias("type"), F.lit("action").alias("source_type"), F.col("p_type").alias("source_nom"), F.lit("module").alias("cible_type"), F.col("p_name").alias("cible_nom"), F.concat(F.lit("P#"), "p_partkey").alias("chunk_id"), F.lit("").alias("citation"), F.col("p_partkey").cast("long").alias("ordinal"))
    return resolve.resolve(ents, rels, default_ontology())["edges"]


# text
@query(r"""
SELECT doc_id, CASE """ + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in text.kind_patterns(r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])")) + r""" ELSE 'document' END AS type_document,
       CASE WHEN y <> '' THEN y || '-' || regexp_extract(x, '""" + text.DATE_PATTERN + r"""', 2) || '-' || regexp_extract(x, '""" + text.DATE_PATTERN + r"""', 3) END AS date_document
FROM (SELECT *, regexp_extract(x, '""" + text.DATE_PATTERN + r"""', 1) AS y FROM (SELECT doc_id, lower(source || ' ' || substring(text, 1, 500)) AS t, substring(text, 1, 500) AS x FROM documents))""")
def document_kinds(spark, sf_dir):
    docs = star.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.document_kind(F.col("source"), F.col("text")).alias("type_document"), text.document_date(F.lit(""), F.col("text")).alias("date_document"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ -]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM part")
def name_keys(spark, sf_dir):
    return star.table(spark, sf_dir, "part").select("p_partkey", name_key_column(F.col("p_name"), F.lit(False), ()).alias("norm"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS sha, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '…' ELSE text END AS extrait FROM documents")
def fingerprints_and_excerpts(spark, sf_dir):
    return star.table(spark, sf_dir, "documents").select("doc_id", text_fingerprint(F.coalesce("text", F.lit(""))).alias("sha"), text.excerpt(F.col("text"), 400).alias("extrait"))


@query("SELECT event_id, k AS attribut, json_extract(props, '$.' || k)::VARCHAR AS valeur FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_attributes(spark, sf_dir):
    """Attributes with their values as JSON, by the function that entity resolution uses."""
    return resolve.attributes(star.table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", F.col("k").alias("attribut"), F.col("v").alias("valeur"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'nouveau' WHEN length(text) % 2 = 0 THEN 'inchange' ELSE 'modifie' END AS etat FROM documents")
def manifest_diff(spark, sf_dir):
    """Two runs over the documents: the first saw the labelled ones, and texts of odd length have changed since."""
    docs, labels = star.table(spark, sf_dir, "documents"), star.table(spark, sf_dir, "labels").select("doc_id").distinct()
    now = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("sha256"), F.lit(2).alias("mtime"), F.length("text").alias("taille"), F.lit("max_chunk=2500").alias("config"))
    odd = F.length("text") % 2 != 0
    before = docs.join(labels, "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(odd, F.lit("old")).otherwise(F.sha2("text", 256)).alias("sha256"), F.when(odd, F.lit(1)).otherwise(F.lit(2)).alias("mtime"), F.length("text").alias("taille"), F.lit("max_chunk=2500").alias("config"))
    return files.manifest_diff(now, before)


@query()
def html_to_markdown(spark, sf_dir):
    """Written by way of Arrow batches of few pages, as a worker holds a batch as objects."""
    pages = star.table(spark, sf_dir, "pages").select("page_id", text.html_to_markdown_column(F.col("html")).alias("markdown"))
    return materialise(pages, "markdown", 200)


@query()
def chunks(spark, sf_dir):
    pages = html_to_markdown(spark, sf_dir)
    return files.chunks_of(pages.select(F.col("page_id").alias("doc_id"), "markdown"))


@query("WITH n AS (SELECT c_nationkey AS k, count(*) AS clients FROM customer GROUP BY 1) SELECT n_name, clients FROM nation JOIN n ON k = n_nationkey")
def sql_gate(spark, sf_dir):
    sqlgate.register_views({t: star.table(spark, sf_dir, t) for t in ("customer", "nation")})
    return sqlgate.read_only(spark, "WITH n AS (SELECT c_nationkey AS k, count(*) AS clients FROM customer GROUP BY 1) SELECT n_name, clients FROM nation JOIN n ON k = n_nationkey")


@query("SELECT c_custkey, 'organisation' AS type, c_name AS nom, '{\"segment\":\"' || c_mktsegment || '\"}' AS attributs FROM customer")
def extraction(spark, sf_dir):
    """Passages that hold an answer as JSON go through the offline model, mending and validation."""
    text_of = F.concat(F.lit('Texte {"entites": [{"type": "organisation", "nom": "'), "c_name", F.lit('", "attributs": {"segment": "'), "c_mktsegment", F.lit('"}}, {"type": "inconnu", "nom": "x"}, "y"'))
    passages = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.lit("").alias("chemin_titres"), text_of.alias("texte"))
    ents, _ = extract.validate(extract.ask(passages, default_ontology(), extract.OfflineModel()), default_ontology())
    return ents.select(F.col("chunk_id").cast("long").alias("c_custkey"), "type", "nom", "attributs")


@query()
def embeddings_by_hashing(spark, sf_dir):
    docs = star.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("texte"))
    return enrich.embed(docs)
