import itertools
import json
import random
import re
import sqlite3
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.functions.names import token_set_ratio
from ravelin.operators import audit, enrich, extract, fts, graph, knowledge, resolve, sqlgate, store, vector
from ravelin.plans import lineage, star
from ravelin.plans.components import components
from ravelin.plans.config import Config
from ravelin.plans.ontology import default_ontology
from ravelin.plans.tables import TABLES
from ravelin.sources import files, jsonl
from ravelin.streaming import ingest

ONTO = default_ontology()


def test_bm25_is_that_of_fts5(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["été", "Chat", "k_l", "l", "chien", "k", "a1", "loup"]) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    index, stats = fts.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, texte string"), text_cols=("texte",))
    for question, match in [("ETE loup", '"ETE" "loup"'), ("k_l", '"k_l"'), ("chat k_l a1", '"chat" "k_l" "a1"')]:
        want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.score for r in fts.search(index, stats, question, None, "and").collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in got)
    assert fts.search(index, stats, "a !", 5).count() == 0
    assert fts.search(index, stats, "chat absent", 500, "auto").count() == sum("Chat" in t for t in texts)


def test_postings_are_made_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(fts, "_LOT", 10_000)
    text = lambda i: " ".join(f"mot{(i * 7 + j) % 500}" for j in range(100))
    batches = [pa.RecordBatch.from_pydict({"chunk_id": list(range(k, k + 150)), "_0": [text(i) for i in range(k, k + 150)]}) for k in range(0, 900, 150)]
    lots, terms, seen = 0, [], set()
    tracemalloc.start()
    for part in fts._lots(batches):
        lots, terms = lots + 1, part["mot"].to_pylist()
        assert terms == sorted(terms)
        seen.update((c, p[0]) for c, p, m in zip(part["chunk_id"].to_pylist(), part["positions"].to_pylist(), terms, strict=True) if m == f"mot{(c * 7 + p[0]) % 500}")
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(seen) == 900 * 100 and lots == 9
    assert peak < 30, peak  # all at once takes about a kilobyte for each term of each passage


def test_an_index_is_made_without_a_shuffle(spark):
    plan = fts.postings(spark.createDataFrame([(1, "un deux")], "chunk_id long, texte string"), text_cols=("texte",))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_knn_and_rrf(spark):
    rnd = random.Random(1)
    vs = [(i, [rnd.random() for _ in range(4)]) for i in range(50)] + [(99, [1.0])]
    df = spark.createDataFrame(vs, "id long, embedding array<float>")
    got = [r.id for r in vector.knn(df, vs[0][1], 5).orderBy("rang").collect()]
    want = sorted(range(50), key=lambda i: sum((a - b) ** 2 for a, b in zip(vs[i][1], vs[0][1], strict=True)))[:5]
    assert got == want
    assert vector.knn_all(df.where("id < 50"), df, 5).where("query_id = 0").orderBy("rang").select("id").collect() == [(i,) for i in want]
    a, b = spark.createDataFrame([(1, 0), (2, 1)], "id int, rang int"), spark.createDataFrame([(2, 0), (3, 1)], "id int, rang int")
    fused = {r.id: r.score for r in vector.rrf([a, b]).collect()}
    assert fused == {1: 1 / 60, 2: 1 / 61 + 1 / 60, 3: 1 / 61}


def _edges(spark, pairs):
    return spark.createDataFrame([(str(a), "r", str(b)) for a, b in pairs], "source_id string, type string, cible_id string")


def test_graph_against_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 24), rnd.randint(0, 24)) for _ in range(30)]
    edges = _edges(spark, [*pairs, (1, 1)])
    near = {str(i): set() for i in range(25)}
    for a, b in pairs:
        near[str(a)].add(str(b))
        near[str(b)].add(str(a))
    dist, front = {"0": 0}, ["0"]
    while front:
        front = [y for x in front for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
    nodes, ties = graph.neighbourhood(edges, "0", 2)
    assert {r.node_id: r.distance for r in nodes.collect()} == {k: d for k, d in dist.items() if d <= 2}
    assert {(r.source_id, r.cible_id) for r in ties.collect()} == {(str(a), str(b)) for a, b in pairs if min(dist.get(str(a), 9), dist.get(str(b), 9)) < 2}
    for goal in ("3", "7", "19"):
        steps = graph.shortest_path(edges, "0", goal, 6).orderBy("etape").collect()
        assert len(steps) == (dist[goal] if dist.get(goal, 9) <= 6 else 0)
        assert all(x.vers == y.de for x, y in itertools.pairwise(steps))
    reached, cut = graph.expand(edges, spark.createDataFrame([("0",), ("absent",)], "node_id string"), 3, cap=4)
    assert reached.count() == 4 and cut
    assert graph.shortest_path(edges, "0", "0").count() == 0


def test_levels_are_written_once_and_the_last_is_never_made(spark, monkeypatch):
    tags, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, tag, *a: (tags.append(tag), write(df, tag, *a))[1])
    edges = spark.createDataFrame([(1, "r", 2), (2, "r", 3), (9, "r", 3), (1, "a", 9), *[(2, "r", 100 + i) for i in range(50)]], "source_id long, type string, cible_id long")
    back = graph.shortest_path(edges, 1, 3, 5, lambda c: F.lpad((10 - c).cast("string"), 3, "0")).orderBy("etape").collect()
    assert [(r.de, r.relation, r.sens, r.vers) for r in back] == [(1, "a", "->", 9), (9, "r", "->", 3)]  # 9 is the lesser by name
    assert sorted(tags) == ["graph-edges", "path-end", "path-level", "path-level"]
    tags.clear()
    nodes, ties = graph.neighbourhood(edges, 3, 3)
    assert nodes.count() == 54 and ties.count() == 54 and nodes.dtypes[0] == ("node_id", "bigint")
    assert sorted(tags) == ["graph-edges", *["graph-level"] * 3, "graph-seeds"]


def test_numbers_name_the_same_nodes(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 1, 7, -3, 5_999_999_999, None)], "k long")
    for kind in star.TYPES:
        rows = keys.select("k", star.node_id(kind, "k").alias("a"), star.named(star.number(kind, "k")).alias("b"), star.number(kind, "k").alias("n")).collect()
        assert all(r.a == r.b for r in rows) and rows[1].n == star.number_of(kind, 1) and rows[1].a == star.id_of(kind, 1)
    with pytest.raises(Exception, match="beyond 59 bits"):
        spark.createDataFrame([(1 << 60,)], "k long").select(star.number("part", "k").alias("n")).collect()


def test_tasks_hold_a_bounded_number_of_rows(spark):
    df = spark.range(1000)
    assert lineage.spread(df, "id", rows=100).rdd.getNumPartitions() == 10
    assert lineage.spread(df, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_pruning_spreads_edges_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(store, "spread", lambda df, *c, n: lineage.spread(df, *c, rows=100, n=n))
    none = {t: spark.createDataFrame([], TABLES[t]) for t in ("documents", "chunks", "aliases", "mentions")}
    edges = spark.range(1000).selectExpr("CAST(id % 50 AS STRING) source_id", "'r' type", "CAST(id AS STRING) cible_id", "'' chunk_id", "'' citation")
    kept, _ = store.prune(none | {"nodes": spark.range(900).selectExpr("CAST(id AS STRING) node_id"), "edges": edges})
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept["edges"]._jdf.queryExecution().executedPlan().toString()
        assert kept["edges"].count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    parts = re.findall(r"hashpartitioning\((?:source_id|cible_id)#\d+L?, (\d+)\)", plan)
    assert parts == ["10"] * 4, parts  # ten parts for each side of both joins, and not the four of the session


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for one_task in (0, 500_000):
        got = {r.id: r.label for r in components(spark.createDataFrame(pairs, "a int, b int"), one_task=one_task).collect()}
        assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    import ravelin.plans.components as c

    tags, write = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, tag, *a: (tags.append(tag), write(df, tag, *a))[1])
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + (i * 7) % 40) for i in range(41)]
    got = {r.id: r.label for r in c.components(spark.createDataFrame([*links, links[0], (5, 5), (7777, 7777)], "a long, b long"), one_task=0).collect()}
    assert {i for i in got if got[i] == 0} == set(range(301)) and {i for i in got if i >= 1000} == {x for ab in links[300:] for x in ab}
    assert all(got[a] == got[b] for a, b in links) and all(got[l] == l == min(i for i in got if got[i] == l) for l in set(got.values()))
    assert 1 <= tags.count("component-least") <= 4  # each round needs the edges four times; the steps before took many rounds


def test_fuzzy_pairs_lose_nothing(spark):
    rnd = random.Random(2)
    names = sorted({" ".join("".join(rnd.choice("abn") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 2))) for _ in range(70)})
    got = {(r.a, r.b) for r in resolve.fuzzy_pairs(spark.createDataFrame([("t", n) for n in names], "type string, norm string")).collect()}
    want = set()
    for a in names:
        best = sorted(((-token_set_ratio(a, b), b) for b in names if b > a and token_set_ratio(a, b) >= 80))[:10]
        want |= {(a, b) for _, b in best}
    assert got == want


def test_resolution(spark):
    e = [("personne", "Mme Dupont", '{"role":"x"}', "c1", "q", 1), ("personne", "Duponts", '{"role":"y","age":3}', "c2", "", 2), ("personne", "M. Dupont", "{}", "c1", "q", 3), ("personne", "!!", "{}", "c1", "", 4), ("module", "Paie", "{}", "", "", 5)]
    r = [("responsable_de", "personne", "Dupont", "module", "Paie", "c1", "z", 1), ("responsable_de", "personne", "Dupont", "module", "paie", "c1", "later", 2), ("appartient_a", "module", "Paie", "personne", "Dupont", "c1", "", 3), ("liee_a", "module", "Paie", "module", "PAIE", "c1", "", 4), ("concerne", "risque", "Retard", "module", "Paie", "", "", 5), ("inconnu", "module", "Paie", "personne", "Dupont", "c1", "", 6)]
    out = resolve.resolve(spark.createDataFrame(e, "type string, nom string, attributs string, chunk_id string, citation string, ordinal long"), spark.createDataFrame(r, "type string, source_type string, source_nom string, cible_type string, cible_nom string, chunk_id string, citation string, ordinal long"), ONTO)
    nodes = {n.type: n for n in out["nodes"].collect()}
    assert len(nodes) == 3 and out["nodes"].count() == 3
    assert nodes["personne"].nom == "Mme Dupont" and json.loads(nodes["personne"].attributs) == {"role": "x", "age": 3}
    assert json.loads(nodes["risque"].attributs) == {"implicite": True}
    assert {a.alias for a in out["aliases"].collect()} == {"Duponts", "M. Dupont"}
    assert out["mentions"].count() == 2
    assert sorted((x.type, x.citation) for x in out["edges"].collect()) == [("concerne", ""), ("liee_a", ""), ("responsable_de", "z")]
    assert {c.cle: c.valeur for c in out["counters"].collect()}["implicites"] == 1


class Broken(extract.OfflineModel):
    def chat(self, system, user):
        if "boom" in user:
            raise RuntimeError("down")
        return super().chat(system, user)


def test_extraction_isolates_failures_and_reuses(spark):
    rows = [("a", "", 'x {"entites": [{"type": "module", "nom": "M", "attributs": 3, "citation": "' + "c" * 600 + '"}, "s", {"type": "zzz", "nom": "x"}, {"type": "module", "nom": " "}], "relations": [{"type": "precede", "source_type": "jalon", "source_nom": "a", "cible_type": "jalon", "cible_nom": "b"}]'), ("b", "", "boom"), ("c", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chemin_titres string, texte string")
    answers = extract.ask(chunks, ONTO, Broken()).cache()
    assert {r.chunk_id for r in answers.where("echec IS NOT NULL").collect()} == {"b"}
    ents, rels = extract.validate(answers, ONTO)
    got = ents.collect()
    assert [(r.nom, r.attributs, len(r.citation)) for r in got] == [("M", "{}", 500)] and rels.count() == 1
    again = extract.ask(chunks, ONTO, Broken(), cache=answers)
    assert again.count() == 3 and again.where("echec IS NOT NULL").count() == 1


def test_enrichment(spark):
    nodes = spark.createDataFrame([("n", "module", "Paie")], "node_id string, type string, nom string")
    mentions = spark.createDataFrame([("n", "c1", "q"), ("n", "c1", "q2"), ("n", "c2", "")], "node_id string, chunk_id string, citation string")
    chunks = spark.createDataFrame([("c1", "a" * 3000), ("c2", "b" * 3000)], "chunk_id string, texte string")
    context = enrich.node_contexts(nodes, mentions, chunks, limit=2500)
    got = context.first().contexte
    assert got.startswith("MODULE : Paie\nq | q2\naaa") and "b" not in got and len(got) < 2500
    first = enrich.write_cards(context).cache()

    def fails(_):
        raise RuntimeError("down")

    kept = enrich.write_cards(context, fails, cache=first).first()
    assert kept.fiche == first.first().fiche and kept.echec is None
    stale = enrich.write_cards(context.withColumn("contexte", F.lit("new")), fails, cache=first).first()
    assert stale.fiche == first.first().fiche and "down" in stale.echec
    vecs = enrich.embed(enrich.chunk_texts(chunks.withColumn("chemin_titres", F.lit("t"))), dim=8)
    assert {len(r.embedding) for r in vecs.collect()} == {8}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    t = {
        "documents": spark.createDataFrame([("d1", "p1", "Un", "document", "2024-01-02", "h"), ("d2", "p2", "Deux", "document", None, "h"), ("d3", "p3", "Trois", "document", "2023-05-05", "h")], "doc_id string, chemin_source string, titre string, type_document string, date_document string, sha256 string"),
        "chunks": spark.createDataFrame([("d1#000", "d1", 0, "", "fournisseurs retenus"), ("d2#000", "d2", 0, "", "autre sujet"), ("d3#000", "d3", 0, "", "histoire ancienne"), ("x#000", "gone", 0, "", "x"), (None, "d1", 1, "", "y")], "chunk_id string, doc_id string, ordre int, chemin_titres string, texte string"),
        "nodes": spark.createDataFrame([("DEC-1", "decision", "Choix fournisseurs", "{}", "carte", 1), ("MOD-1", "module", "Achats", "{}", None, 2), ("MOD-2", "module", "Stocks", "{}", None, 3), ("MOD-2", "module", "Stocks", "{}", None, 3)], "node_id string, type string, nom string, attributs string, fiche string, ordinal long"),
        "aliases": spark.createDataFrame([("le choix", "DEC-1"), ("le choix", "DEC-1"), ("z", "absent")], "alias string, node_id string"),
        "mentions": spark.createDataFrame([("DEC-1", "d1#000", "q"), ("MOD-1", "d2#000", ""), ("MOD-2", "d3#000", ""), ("absent", "d1#000", "")], "node_id string, chunk_id string, citation string"),
        "edges": spark.createDataFrame([(1, "DEC-1", "concerne", "MOD-1", "d1#000", "c"), (2, "MOD-1", "liee_a", "MOD-2", "", ""), (3, "MOD-1", "liee_a", "absent", "", ""), (4, "DEC-1", "concerne", "MOD-1", "d1#000", "twice")], "edge_id long, source_id string, type string, cible_id string, chunk_id string, citation string"),
    }
    clean, lost = store.prune(t)
    assert {r.table: r.n for r in lost.collect()} == {"nodes": 1, "chunks": 2, "aliases": 2, "mentions": 1, "edges": 2}
    root = str(tmp_path_factory.mktemp("base"))
    store.publish(spark, root, clean)
    with pytest.raises(Exception):  # noqa: B017
        store.publish(spark, root, clean | {"nodes": clean["nodes"].select(F.raise_error(F.lit("x")).alias("node_id"))})
    return knowledge.Base(store.open_base(spark, root), Config())


def test_search_and_cards(base):
    got = knowledge.recherche(base, "fournisseurs")
    assert got["mode"] == "plein texte seul" and [p["score"] for p in got["passages"]] == [0.0167]
    assert got["passages"][0]["noeuds"][0]["node_id"] == "DEC-1" and got["noeuds"][0]["node_id"] == "DEC-1"
    assert knowledge.recherche(base, "fournisseurs", type_noeud="module")["noeuds"] == []
    f = knowledge.fiche(base, "LE CHOIX")
    assert f["noeud"]["node_id"] == "DEC-1" and f["sortantes"][0]["autre"] == "MOD-1" and f["alias"] == ["le choix"] and len(f["sources"]) == 1
    assert "erreur" in knowledge.fiche(base, "rien")
    c = knowledge.chemin(base, "DEC-1", "MOD-2")
    assert c["longueur"] == 2 and [s["sens"] for s in c["etapes"]] == ["->", "->"]
    assert knowledge.chemin(base, "MOD-2", "MOD-2")["longueur"] == 0
    assert len(knowledge.voisins(base, "Achats")["noeuds"]) == 3


def test_dossier(base):
    d = knowledge.dossier(base, "fournisseurs", profondeur=2)
    assert [(x["doc_id"], x["distance"]) for x in d["documents"]] == [("d1", 0), ("d2", 1), ("d3", 2)]
    assert d["origine"]["doc_id"] == "d1" and [x["doc_id"] for x in d["chronologie"]] == ["d3", "d1"]
    assert d["documents"][0]["lien"] is None and len(d["documents"][2]["lien"]) == 2 and d["pivot"] == "DEC-1"


def test_schema_audit_report(base, spark, tmp_path):
    s = {(r.genre, r.nom): r.n for r in knowledge.schema(base, ONTO).collect()}
    assert s["noeud", "module"] == 2 and s["noeud", "risque"] == 0 and s["relation", "concerne"] == 1
    a = {r.controle: r.n for r in audit.audit(base.tables, ONTO).collect()}
    assert a["noeuds_isoles"] == 0 and a["aretes_orphelines"] == 0 and a["noeuds_sans_fiche"] == 2 and a["documents_sans_entite"] == 0
    with audit.Journal(spark, str(tmp_path), "charge") as j:
        j.count("lignes", 3)
        j.incident("avertissement", "d1", "vide")
    with pytest.raises(RuntimeError), audit.Journal(spark, str(tmp_path), "extrait"):
        raise RuntimeError("stop")
    (tmp_path / "bad.json").write_text("{")
    journals = jsonl.read_journals(spark, str(tmp_path))
    assert audit.global_status(journals, ["charge"]) == "ok" and audit.global_status(journals, ["charge", "extrait"]) == "echec" and audit.global_status(journals, ["x"]) == "absent"
    text = audit.report(base.tables, ONTO, journals, ["charge", "extrait"])
    assert "Statut : echec" in text and "Achats" in text
    assert audit.vector_coverage(base.nodes, spark.createDataFrame([("MOD-1", [1.0])], "id string, embedding array<float>"), "node_id").first().pourcentage == 33.3


def test_sql_gate(base, spark):
    sqlgate.register_views({"nodes": base.nodes})
    assert sqlgate.requete_sql(spark, "SELECT * FROM nodes", 2)["tronque"]
    assert len(sqlgate.requete_sql(spark, " with a as (select 1 x) select * from a")["lignes"]) == 1
    for bad in ("DROP TABLE nodes", "INSERT INTO nodes VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO nodes SELECT * FROM a", "SELECT * FROM nowhere"):
        assert "erreur" in sqlgate.requete_sql(spark, bad)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "CR 2024-01-02.md").write_text("# Titre\n\ncorps")
    (tmp_path / ".cache").write_text("x")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "p.html").write_text("<h1>P</h1><p>q</p>")
    (tmp_path / "vide.txt").write_text(" \n")
    (tmp_path / "rien.txt").write_text("")
    converted = files.convert(files.scan_files(spark, str(tmp_path))).cache()
    state = {r.nom: (r.ok, r.erreur is None) for r in converted.collect()}
    assert state == {"CR 2024-01-02.md": (True, True), "b.bin": (False, False), "p.html": (True, True), "vide.txt": (False, True), "rien.txt": (False, True)}
    docs = files.documents_of(converted)
    assert {(r.titre, r.type_document, r.date_document) for r in docs.collect()} == {("Titre", "compte_rendu", "2024-01-02"), ("P", "document", None)}
    assert {r.ordre for r in files.chunks_of(docs).collect()} == {0}
    now = files.manifest(files.scan_files(spark, str(tmp_path)))
    states = {r.etat for r in files.manifest_diff(now, now.where("taille > 6")).collect()}
    assert states == {"inchange", "nouveau"}
    assert {r.etat for r in files.manifest_diff(files.manifest(files.scan_files(spark, str(tmp_path)), 100), now).collect()} == {"modifie"}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    from pyspark.sql import types as T

    good, bad = jsonl.read_jsonl(spark, str(tmp_path / "l.jsonl"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert good.collect() == [(1,)] and bad.count() == 1


def test_stream_counts_each_document_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(src)
    for _ in range(2):
        ingest.ingest(ingest.read_documents(spark, src, rows.schema), out, ck).awaitTermination()
    assert ingest.latest_passages(spark, out).count() == 2
    spark.createDataFrame([(2, "c")], rows.schema).write.mode("append").parquet(src)
    ingest.ingest(ingest.read_documents(spark, src, rows.schema), out, ck).awaitTermination()
    assert {(r.doc_id, r.texte) for r in ingest.latest_passages(spark, out).collect()} == {("1", "a"), ("2", "c")}


def test_attribute_values_keep_their_types(spark):
    rows = [("a", '{"age":3,"tags":["a",1],"ok":true,"o":{"x":null},"q\\"k":"v\\"","n":null}'), ("b", "[1]"), ("c", "no json"), ("d", None), ("e", "{}")]
    df = spark.createDataFrame(rows, "id string, attributs string")
    got = resolve.attributes(df).groupBy("id").agg(resolve.json_object(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("j")).collect()
    assert {r.id: json.loads(r.j) for r in got} == {"a": json.loads(rows[0][1])}


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System','getProperty','user.dir')", "SELECT java_method('java.lang.System','exit',0)", "SELECT try_reflect('java.lang.System','getProperty','x') FROM secret_ok",
    "SELECT * FROM text.`/etc/hostname`", "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM secret_ok",
    "SELECT * FROM other_table", "SELECT no_such_function(1)", "SELECT id FROM secret_ok WHERE id IN (SELECT value FROM json.`/etc/hostname`)", "SELECT TRANSFORM(id) USING 'cat' AS x FROM secret_ok",
    "WITH x AS (SELECT 1) INSERT INTO secret_ok SELECT * FROM x", "SELECT input_file_name() FROM secret_ok", "DROP VIEW secret_ok",
])
def test_the_sql_gate_refuses(spark, sql):
    sqlgate.register_views({"secret_ok": spark.range(3)})
    assert "erreur" in sqlgate.requete_sql(spark, sql)


def test_the_sql_gate_lets_queries_pass(spark):
    sqlgate.register_views({"secret_ok": spark.range(3)})
    for sql in ("SELECT sum(id) AS s FROM secret_ok WHERE id > 0", "WITH a AS (SELECT id FROM secret_ok) SELECT a.id FROM a JOIN secret_ok b ON a.id = b.id", "SELECT explode(array(1, 2)) AS x", "SELECT upper('a') AS x, row_number() OVER (ORDER BY id) AS r FROM secret_ok", "SELECT * FROM range(3)", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t"):
        assert sqlgate.requete_sql(spark, sql).get("lignes"), (sql, sqlgate.requete_sql(spark, sql))
    assert "erreur" in sqlgate.requete_sql(spark, "SELECT id FROM secret_ok", tables=["nodes"])


def test_nearest_of_many_in_blocks_and_with_ties(spark):
    rnd = random.Random(2)
    vs = [(i, [float(rnd.randint(0, 3)) for _ in range(3)]) for i in range(120)] + [(500, [1.0]), (501, None)]
    df = spark.createDataFrame(vs, "id long, embedding array<float>").repartition(5)
    got = {}
    for r in vector.knn_all(df, df, 4, block_mb=64).collect():
        got.setdefault(r.query_id, []).append((r.rang, r.id))
    for q, v in vs[:120]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(w, v, strict=True)) ** 0.5, i) for i, w in vs[:120])[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert got[500] == [(0, 500)] and 501 not in got


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(f"c{i}", float(i % 7)) for i in range(200)], "chunk_id string, score double").repartition(7)
    got = fts.ranked_whole(df, ["score", "chunk_id"]).orderBy("rang").collect()
    assert [r.rang for r in got] == list(range(200)) and [(r.score, r.chunk_id) for r in got] == sorted((r.score, r.chunk_id) for r in got)
    assert fts.ranked_whole(df.limit(0), ["score", "chunk_id"]).count() == 0
