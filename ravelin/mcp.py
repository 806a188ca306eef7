"""The seven query tools over standard input and output, as JSON-RPC lines of the Model Context Protocol: python -m ravelin.mcp ROOT."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator

from ravelin.operators import knowledge, sqlgate
from ravelin.plans.ontology import Ontology, default_ontology

PROTOCOL = "2024-11-05"
_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
#: name -> (what it says, its arguments, those that must be given)
TOOLS = {
    "schema": ("Types of nodes and relations with their counts.", {}, []),
    "recherche": ("Passages and nodes for a question.", {"question": _TEXT, "k": _WHOLE, "type_noeud": _TEXT}, ["question"]),
    "fiche": ("One node with aliases, links and sources.", {"node_id": _TEXT}, ["node_id"]),
    "voisins": ("The nodes around a node, up to three steps.", {"node_id": _TEXT, "profondeur": _WHOLE}, ["node_id"]),
    "chemin": ("A shortest path between two nodes.", {"depart": _TEXT, "arrivee": _TEXT, "profondeur_max": _WHOLE}, ["depart", "arrivee"]),
    "dossier": ("Everything about a subject, by document.", {"sujet": _TEXT, "profondeur": _WHOLE, "k": _WHOLE}, ["sujet"]),
    "requete_sql": ("A read-only SELECT over the tables, up to 200 rows.", {"sql": _TEXT, "max_lignes": _WHOLE}, ["sql"]),
}


def calls(base: knowledge.Base, ontology: Ontology) -> dict[str, Callable[[dict], object]]:
    """The tools on a base; bounds on their numbers are put in knowledge and sqlgate."""
    sqlgate.register_views(base.tables)
    return {
        "schema": lambda a: [r.asDict() for r in knowledge.schema(base, ontology).collect()],
        "recherche": lambda a: knowledge.recherche(base, a["question"], a.get("k", 8), a.get("type_noeud")),
        "fiche": lambda a: knowledge.fiche(base, a["node_id"]),
        "voisins": lambda a: knowledge.voisins(base, a["node_id"], a.get("profondeur", 1)),
        "chemin": lambda a: knowledge.chemin(base, a["depart"], a["arrivee"], a.get("profondeur_max", 5)),
        "dossier": lambda a: knowledge.dossier(base, a["sujet"], a.get("profondeur", 2), a.get("k", 6)),
        "requete_sql": lambda a: sqlgate.requete_sql(base.spark, a["sql"], a.get("max_lignes", 100), base.tables),
    }


def answer(request: dict, tools: dict[str, Callable[[dict], object]]) -> dict | None:
    """The reply to one message; None for a notification."""
    number, method, given = request.get("id"), request.get("method"), request.get("params") or {}
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "ravelin", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    name, args = given.get("name"), given.get("arguments") or {}
    if name not in tools:
        return reply | {"error": {"code": -32602, "message": f"no tool {name}"}}
    if missing := [x for x in TOOLS[name][2] if x not in args]:
        return reply | {"error": {"code": -32602, "message": f"missing: {', '.join(missing)}"}}
    try:
        said, failed = tools[name](args), False
    except Exception as e:  # the session goes on
        said, failed = {"erreur": f"{type(e).__name__}: {e}"[:1000]}, True
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(said, ensure_ascii=False, default=str)}], "isError": failed}}


def serve(lines: Iterable[str], tools: dict[str, Callable[[dict], object]]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
            continue
        if isinstance(request, dict) and (reply := answer(request, tools)) is not None:
            yield json.dumps(reply, ensure_ascii=False)


def main() -> None:
    from pyspark.sql import SparkSession

    from ravelin.cli import open_root

    spark = SparkSession.builder.appName("ravelin-mcp").getOrCreate()
    for reply in serve(sys.stdin, calls(open_root(spark, sys.argv[1]), default_ontology())):
        print(reply, flush=True)


if __name__ == "__main__":
    main()
