"""Read-only SQL over the tables of a knowledge base, with a bounded answer.

A statement is parsed and its plan walked before anything runs: it may read the registered views and its own CTEs and call Spark's own
functions. Files, other tables, Java methods, scripts, session functions and anything that isn't a query are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_BEGINS = re.compile(r"\s*(select|with)\b", re.IGNORECASE)
#: Plans that write or change something.
_CHANGES = re.compile(r"Insert|Create|Drop|Alter|Command|Truncate|Delete|Update|Merge|Overwrite|AddPartition|SetCatalog|SetNamespace|Script|CallStatement")
#: Functions that reach out of the tables.
_REFUSED = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "user", "session_user", "current_database", "current_schema", "current_catalog", "version", "raise_error", "assert_true", "aes_encrypt", "aes_decrypt", "try_aes_decrypt", "python_worker_logs", "sql_keywords", "collations"})


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(seq) -> str:
    return ".".join(map(str, _items(seq))).lower()


def _walk(node, relations: set[str], functions: set[str], own: set[str], kinds: set[str]) -> None:
    """Names in an unresolved plan or expression: relations, functions, its own CTEs, classes of its nodes."""
    kind = node.getClass().getSimpleName()
    kinds.add(kind)
    if kind in ("UnresolvedRelation", "RelationTimeTravel"):
        relations.add(_parts(node.multipartIdentifier()) if kind == "UnresolvedRelation" else "a version of a table")
    elif kind in ("UnresolvedFunction", "UnresolvedTVFAliases"):
        functions.add(_parts(node.nameParts() if kind == "UnresolvedFunction" else node.name()))
    elif kind == "UnresolvedTableValuedFunction":
        functions.add(_parts(node.name()))
    elif kind == "UnresolvedWith":
        for cte in _items(node.cteRelations()):
            own.add(str(cte._1()).lower())
            _walk(cte._2(), relations, functions, own, kinds)
    children = _items(node.children())
    if hasattr(node, "plan") and "SubqueryExpression" in str([c.getSimpleName() for c in _ancestors(node)]):
        children.append(node.plan())
    if "LogicalPlan" in {c.getSimpleName() for c in _ancestors(node)}:
        children += _items(node.expressions())
    for child in children:
        _walk(child, relations, functions, own, kinds)


def _ancestors(node) -> list:
    found, c = [], node.getClass()
    while c is not None:
        found.append(c)
        c = c.getSuperclass()
    return found


def _known_functions(spark: SparkSession) -> set[str]:
    return {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}


def read_only(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> DataFrame:
    """The frame of a query over ``tables`` (all temporary views, if not given); ValueError for anything else."""
    if not _BEGINS.match(sql):
        raise ValueError("only SELECT or WITH queries")
    relations, functions, own, kinds = set(), set(), set(), set()
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), relations, functions, own, kinds)
    if changing := sorted(k for k in kinds if _CHANGES.search(k)):
        raise ValueError(f"only queries: this statement changes something ({', '.join(changing)})")
    views = {t.lower() for t in tables} if tables is not None else {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    if strange := sorted(relations - views - own):
        raise ValueError(f"no such table here: {', '.join(strange)}")
    if strange := sorted(f for f in functions if f in _REFUSED or f not in _known_functions(spark)):
        raise ValueError(f"function not allowed: {', '.join(strange)}")
    return spark.sql(sql)


def requete_sql(spark: SparkSession, sql: str, max_lignes: int = 100, tables: Iterable[str] | None = None) -> dict:
    """{lignes, tronque} with at most ``max_lignes`` rows (1 to 200), or {erreur}."""
    n = max(1, min(int(max_lignes), 200))
    try:
        rows = read_only(spark, sql, tables).limit(n + 1).collect()
    except (ValueError, PySparkException) as e:
        return {"erreur": str(e)[:1000]}
    return {"lignes": [r.asDict(recursive=True) for r in rows[:n]], "tronque": len(rows) > n}
