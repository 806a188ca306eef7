"""A typed graph over the order tables, for queries on data of any size: region, nation, customer, supplier, part, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.names import stable_id
from ravelin.plans.lineage import spread

#: 32-bit ids collide beyond some tens of thousands of nodes.
HEX = 16
_NODES = [("REG", "region", "r_regionkey", "r_name"), ("NAT", "nation", "n_nationkey", "n_name"), ("CUS", "customer", "c_custkey", "c_name"), ("SUP", "supplier", "s_suppkey", "s_name"), ("PRT", "part", "p_partkey", "p_name"), ("ORD", "orders", "o_orderkey", "o_orderpriority")]
#: table, relation, (type, key) of the source, (type, key) of the target
_EDGES = [
    ("nation", "appartient_a", ("nation", "n_nationkey"), ("region", "n_regionkey")), ("customer", "situe_en", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("supplier", "situe_en", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), ("orders", "passee_par", ("orders", "o_orderkey"), ("customer", "o_custkey")),
    ("lineitem", "contient", ("orders", "l_orderkey"), ("part", "l_partkey")), ("lineitem", "fournie_par", ("part", "l_partkey"), ("supplier", "l_suppkey")),
]
_PREFIX = {t: p for p, t, _, _ in _NODES}
TYPES = list(_PREFIX)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return stable_id(_PREFIX[kind], F.concat(F.lit(kind + "|"), F.col(key).cast("string")), HEX)


def id_of(kind: str, key: int) -> str:
    import hashlib

    return f"{_PREFIX[kind]}-{hashlib.sha1(f'{kind}|{key}'.encode()).hexdigest()[:HEX]}"


def number_of(kind: str, key: int) -> int:
    return key * 8 + TYPES.index(kind)


def number(kind: str, key: str) -> Column:
    """A node as a number, key and kind in one: what joins and groups nodes by it moves 8 bytes and not an id of 20 signs."""
    own = F.col(key).cast("long")
    return F.when(F.abs(own) < 1 << 59, own * 8 + TYPES.index(kind)).when(own.isNotNull(), F.raise_error(F.lit(f"{key} is beyond 59 bits")).cast("long"))


def named(number: Column) -> Column:
    """The id (``node_id``) of a node that is given by its number."""
    kind = F.pmod(number, F.lit(8)) + 1
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), kind.cast("int"))
    return stable_id(of(_PREFIX.values()), F.concat(of(f"{t}|" for t in TYPES), F.shiftright(number, 3).cast("string")), HEX)


def with_names(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: named(F.col(c)) for c in columns})


def nodes(spark: SparkSession, sf_dir: str, id_of_node=node_id) -> DataFrame:
    """With ``number`` for ``id_of_node``, nodes go by their numbers."""
    out = None
    for _, kind, key, name in _NODES:
        one = table(spark, sf_dir, kind).select(id_of_node(kind, key).alias("node_id"), F.lit(kind).alias("type"), F.col(name).alias("nom"), F.col(key).cast("long").alias("ordinal"))
        out = one if out is None else out.union(one)
    return out


def edges(spark: SparkSession, sf_dir: str, relations: set[str] | None = None, id_of_node=node_id) -> DataFrame:
    """With ``number`` for ``id_of_node``, edges go by the numbers of their nodes, and have source_id, type and cible_id only."""
    out = None
    for name, relation, (a, ka), (b, kb) in _EDGES:
        if relations and relation not in relations:
            continue
        rows = table(spark, sf_dir, name).select(ka, kb)
        rows = spread(rows, ka, kb).distinct() if name == "lineitem" else rows
        one = rows.select(id_of_node(a, ka).alias("source_id"), F.lit(relation).alias("type"), id_of_node(b, kb).alias("cible_id"))
        out = one if out is None else out.union(one)
    return out if id_of_node is number else out.withColumns({"edge_id": F.concat_ws("|", "source_id", "type", "cible_id"), "chunk_id": F.lit(None).cast("string"), "citation": F.lit("")})


def sql_id(kind: str, key: str) -> str:
    return f"'{_PREFIX[kind]}-' || substr(sha1('{kind}|' || {key}::VARCHAR), 1, {HEX})"


NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT {sql_id(k, key)} AS node_id, '{k}' AS type, {name} AS nom FROM {k}" for _, k, key, name in _NODES) + ")"


def edges_sql(relations: set[str] | None = None) -> str:
    parts = [f"SELECT DISTINCT {sql_id(*a)} AS source_id, '{r}' AS type, {sql_id(*b)} AS cible_id FROM {t}" for t, r, a, b in _EDGES if not relations or r in relations]
    return "edges AS (" + " UNION ALL ".join(parts) + "), und AS (SELECT source_id AS de, cible_id AS vers, type AS relation, '->' AS sens FROM edges UNION ALL SELECT cible_id, source_id, type, '<-' FROM edges)"
