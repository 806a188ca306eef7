"""Schemas of the knowledge base and of what passes hand on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _of(spec: str) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "t": TimestampType(), "d": DoubleType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


DOCUMENTS = _of("doc_id:s chemin_source:s titre:s type_document:s date_document:s sha256:s ingere_le:t")
MANIFEST = _of("doc_id:s chemin_source:s titre:s type_document:s date_document:s sha256:s nb_chunks:i mtime:l taille:l config:s")
CHUNKS = _of("chunk_id:s doc_id:s ordre:i chemin_titres:s texte:s")
NODES = _of("node_id:s type:s nom:s attributs:s fiche:s ordinal:l")
ALIASES = _of("alias:s node_id:s")
EDGES = _of("edge_id:l source_id:s type:s cible_id:s chunk_id:s citation:s")
MENTIONS = _of("node_id:s chunk_id:s citation:s")
META = _of("cle:s valeur:s")
VECTORS = StructType([StructField("id", StringType()), StructField("embedding", ArrayType(FloatType()))])
ENTITY = _of("type:s nom:s attributs:s chunk_id:s citation:s")
RELATION = _of("type:s source_type:s source_nom:s cible_type:s cible_nom:s chunk_id:s citation:s")
INCIDENT = _of("niveau:s sujet:s detail:s")
JOURNAL = StructType([
    StructField("passe", StringType()), StructField("statut", StringType()), StructField("fin", StringType()), StructField("duree_s", DoubleType()),
    StructField("compteurs", MapType(StringType(), LongType())), StructField("incidents", ArrayType(INCIDENT)), StructField("incidents_tronques", IntegerType()),
])
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "nodes": NODES, "aliases": ALIASES, "edges": EDGES, "mentions": MENTIONS, "meta": META}
