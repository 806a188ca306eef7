"""Command line: python -m ravelin.cli ROOT build SOURCE, or recherche|fiche|voisins|chemin|dossier|schema|sql|rapport|reset ...; prints JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from ravelin.operators import knowledge, sqlgate
from ravelin.operators.audit import report
from ravelin.operators.enrich import hashing_encoder
from ravelin.operators.store import open_base, reset
from ravelin.plans.build import PASSES, build
from ravelin.plans.config import Config
from ravelin.plans.ontology import default_ontology
from ravelin.sources.jsonl import read_journals


def open_root(spark: SparkSession, root: str, config: Config | None = None) -> knowledge.Base:
    config = config or Config.from_env()
    return knowledge.Base(open_base(spark, root), config, lambda q: hashing_encoder(config.dim_embedding)([q])[0])


def run(spark: SparkSession, args: list[str]):
    p = argparse.ArgumentParser(prog="ravelin")
    p.add_argument("root")
    sub = p.add_subparsers(dest="what", required=True)
    for name, words in {"recherche": ["question"], "fiche": ["noeud"], "voisins": ["noeud"], "chemin": ["depart", "arrivee"], "dossier": ["sujet"], "schema": [], "sql": ["requete"], "reset": [], "build": ["source"], "rapport": []}.items():
        s = sub.add_parser(name)
        for w in words:
            s.add_argument(w)
        if name in ("recherche", "dossier"):
            s.add_argument("-k", type=int, default=8 if name == "recherche" else 6)
        if name == "recherche":
            s.add_argument("--type")
        if name in ("voisins", "dossier"):
            s.add_argument("--profondeur", type=int, default=1 if name == "voisins" else 2)
        if name == "reset":
            s.add_argument("--niveau", choices=["versions", "work", "all"], default="versions")
            s.add_argument("--oui", action="store_true")
    a = p.parse_args(args)
    if a.what == "reset":
        return {"supprimes": reset(spark, a.root, a.niveau)} if a.oui else {"erreur": "--oui confirme la suppression"}
    config = Config.from_env()
    if a.what == "build":
        return {k: v for k, v in build(spark, a.source, a.root, config=config).items() if k != "rapport"}
    if a.what == "rapport":
        return {"rapport": report(open_base(spark, a.root), default_ontology(), read_journals(spark, f"{a.root}/journal"), list(PASSES))}
    base = open_root(spark, a.root, config)
    if a.what == "recherche":
        return knowledge.recherche(base, a.question, a.k, a.type)
    if a.what == "fiche":
        return knowledge.fiche(base, a.noeud)
    if a.what == "voisins":
        return knowledge.voisins(base, a.noeud, a.profondeur)
    if a.what == "chemin":
        return knowledge.chemin(base, a.depart, a.arrivee)
    if a.what == "dossier":
        return knowledge.dossier(base, a.sujet, a.profondeur, a.k)
    if a.what == "sql":
        sqlgate.register_views(base.tables)
        return sqlgate.requete_sql(spark, a.requete, tables=base.tables)
    return [r.asDict() for r in knowledge.schema(base, default_ontology()).collect()]


def main() -> None:
    spark = SparkSession.builder.appName("ravelin").getOrCreate()
    print(json.dumps(run(spark, None), ensure_ascii=False, indent=1, default=str))


if __name__ == "__main__":
    main()
