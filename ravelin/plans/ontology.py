"""The closed ontology: node types with prefixes, relation types with allowed ends, rules for resolving names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: type -> (prefix, description)
_NODES = {
    "personne": ("PER", "a named individual"), "organisation": ("ORG", "a company, team or body"), "reunion": ("REU", "a meeting or committee"),
    "decision": ("DEC", "something decided"), "action": ("ACT", "something to do"), "risque": ("RSQ", "a risk"), "exigence": ("EXG", "a requirement"),
    "test": ("TST", "a test or campaign"), "anomalie": ("ANO", "a defect"), "procedure": ("PRC", "a procedure or manual"),
    "formation": ("FRM", "a training session"), "module": ("MOD", "a functional module"), "jalon": ("JAL", "a milestone"),
}
#: One line for each relation: its allowed ends by prefix.
_RELATIONS = """
decidee_lors_de DEC>REU
decoule_de ACT,DEC>DEC,REU,ANO,RSQ,EXG
participe_a PER,ORG>REU,FRM
responsable_de PER,ORG>ACT,DEC,TST,PRC,MOD,ANO,FRM
appartient_a PER>ORG
concerne DEC,ACT,RSQ,EXG,TST,ANO,PRC,FRM,REU>MOD,JAL
validee_par DEC,EXG,PRC>TST,REU
couverte_par EXG>TST,PRC
detectee_lors_de ANO>TST,REU
bloque RSQ,ANO,ACT>JAL,TST,ACT,MOD
traite_par RSQ,ANO>ACT,DEC
forme_a FRM>PRC,MOD
precede JAL>JAL
liee_a *>*
"""
_TITLES = "m mr mme mlle dr monsieur madame mademoiselle"
FALLBACK = "liee_a"


@dataclass(frozen=True)
class Relation:
    sources: tuple[str, ...]
    cibles: tuple[str, ...]
    description: str = ""


@dataclass(frozen=True)
class Ontology:
    prefixes: dict[str, str]
    relations: dict[str, Relation]
    descriptions: dict[str, str] = field(default_factory=dict)
    titles: tuple[str, ...] = ()
    #: (type, canonical name, alias) that are one entity by decree.
    equivalences: tuple[tuple[str, str, str], ...] = ()

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, p, self.descriptions.get(t, "")) for t, p in self.prefixes.items()]
        return spark.createDataFrame(rows, "type string, prefixe string, description string")

    def relations_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, list(r.sources), list(r.cibles)) for t, r in self.relations.items()]
        return spark.createDataFrame(rows, "type string, sources array<string>, cibles array<string>")


def default_ontology() -> Ontology:
    by_prefix = {p: t for t, (p, _) in _NODES.items()}
    relations = {}
    for line in _RELATIONS.split("\n"):
        if line.strip():
            name, ends = line.split()
            s, c = (tuple(by_prefix.get(x, x) for x in side.split(",")) for side in ends.split(">"))
            relations[name] = Relation(s, c)
    return Ontology({t: p for t, (p, _) in _NODES.items()}, relations, {t: d for t, (_, d) in _NODES.items()}, tuple(_TITLES.split()))


def load_ontology(path: str) -> Ontology:
    """From a YAML file with ``noeuds`` and ``relations`` (both needed) and, if wanted, ``canonisation``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, dict) or not raw.get("noeuds") or not raw.get("relations"):
        raise ValueError(f"not an ontology (noeuds and relations are needed): {path}")
    rules = raw.get("canonisation") or {}
    return Ontology(
        {t: d["prefixe"] for t, d in raw["noeuds"].items()},
        {t: Relation(tuple(d["sources"]), tuple(d["cibles"]), d.get("description", "")) for t, d in raw["relations"].items()},
        {t: d.get("description", "") for t, d in raw["noeuds"].items()},
        tuple(rules.get("titres_a_retirer") or ()),
        tuple((r[0], r[1], r[2]) for r in rules.get("equivalences") or ()),
    )
