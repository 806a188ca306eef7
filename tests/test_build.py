"""The build end to end: from files to a published base, then reuse, the tools, the command line and the providers with canned answers."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ravelin import cli, mcp
from ravelin.operators import extract, knowledge, resolve, store
from ravelin.plans.build import build
from ravelin.plans.ontology import default_ontology
from ravelin.sources import files

ANSWER = {
    "entites": [{"type": "personne", "nom": "Mme Durand", "attributs": {"age": 41}, "citation": "Mme Durand pilote"}, {"type": "module", "nom": "Paie", "citation": "le module Paie"}],
    "relations": [{"type": "responsable_de", "source_type": "personne", "source_nom": "Mme Durand", "cible_type": "module", "cible_nom": "Paie", "citation": "pilote"}],
}


class Canned:
    name = "canned"

    def __init__(self, log):
        self.log = str(log)

    def available(self):
        return True

    def chat(self, system, user):
        with open(self.log, "a") as f:
            f.write(user.split("]")[0][1:] + "\n")
        if "illisible" in user:
            raise ValueError("no answer")
        return "```json\n" + json.dumps(ANSWER) + "\n```"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in {"2024-03-05 compte rendu.md": "# Comite\n\nMme Durand pilote le module Paie.\n", ".cache/a.txt": "Note sur la paie et Mme Durand", "_u/b.html": "<h1>Budget</h1><p>Le module Paie avance</p>", "_d.md": "passage illisible", "vide.txt": "", ".hidden": "x", "bin.dat": "a\0b"}.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return root


def test_every_folder_is_entered_and_empty_files_are_there(spark, corpus):
    got = {r.chemin_source: r for r in files.scan_files(spark, str(corpus)).collect()}
    assert got.keys() == {"2024-03-05 compte rendu.md", ".cache/a.txt", "_u/b.html", "_d.md", "vide.txt", "bin.dat"}
    assert got["vide.txt"].taille == 0 and bytes(got[".cache/a.txt"].contenu).startswith(b"Note") and got["_u/b.html"].extension == ".html"
    assert files.scan_files(spark, f"file://{corpus}").count() == 6


def test_build_reuse_and_tools(spark, corpus, tmp_path):
    root, log = str(tmp_path / "base"), tmp_path / "asked"
    first = build(spark, str(corpus), root, model=Canned(log))
    asked = log.read_text().split()
    assert len(asked) == 4 and first["statut"] == "avertissements" and "illisible" not in first["rapport"]
    base = store.open_base(spark, root)
    assert base["documents"].count() == 4 and base["edges"].count() == 3 and base["mentions"].count() == 6
    node = {r.type: r for r in base["nodes"].collect()}
    assert json.loads(node["personne"].attributs) == {"age": 41} and node["module"].nom == "Paie" and node["personne"].fiche.startswith("PERSONNE : Mme Durand")

    (corpus / "_u" / "b.html").write_text("<p>Le module Paie recule</p>")
    os.remove(corpus / ".cache" / "a.txt")
    build(spark, str(corpus), root, model=Canned(log))
    again = log.read_text().split()[4:]
    changed = {r.chemin_source: r.doc_id for r in base["documents"].collect()}
    assert sorted(x.split("#")[0] for x in again) == sorted(changed[x] for x in ("_u/b.html", "_d.md"))  # the changed one and the failure
    now = store.open_base(spark, root)
    assert now["documents"].count() == 3 and now["edges"].count() == 2 and now["chunks"].where(F.col("texte").contains("recule")).count() == 1

    run = lambda *a: cli.run(spark, [root, *a])
    assert run("recherche", "module Paie")["passages"] and run("fiche", "mme durand")["noeud"]["type"] == "personne"
    assert run("chemin", "Mme Durand", "Paie")["longueur"] == 1 and len(run("voisins", "Paie")["noeuds"]) == 2
    assert run("dossier", "Paie")["origine"]["date_document"] == "2024-03-05" and any(r["nom"] == "module" and r["n"] == 1 for r in run("schema"))
    assert run("sql", "SELECT count(*) AS n FROM nodes")["lignes"] == [{"n": 2}] and "# Rapport" in run("rapport")["rapport"] and "Vecteurs de nodes : 2 / 2" in run("rapport")["rapport"]

    tools = mcp.calls(cli.open_root(spark, root), default_ontology())
    sent = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "requete_sql", "arguments": {"sql": "SELECT nom FROM nodes ORDER BY nom"}}}, {"id": 4, "method": "tools/call", "params": {"name": "fiche"}}, {"id": 5, "method": "x"}, {"id": 6, "method": "tools/call", "params": {"name": "chemin", "arguments": {"depart": "Paie", "arrivee": "Mme Durand"}}}]
    got = [json.loads(x) for x in mcp.serve([*map(json.dumps, sent), "", "{"], tools)]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None] and len(got[1]["result"]["tools"]) == 7 == len(tools)
    assert json.loads(got[2]["result"]["content"][0]["text"])["lignes"] == [{"nom": "Mme Durand"}, {"nom": "Paie"}]
    assert "error" in got[3] and "error" in got[4] and json.loads(got[5]["result"]["content"][0]["text"])["longueur"] == 1
    assert run("reset")["erreur"] and run("reset", "--oui")["supprimes"] == 2 and store.current_version(spark, root)
    assert run("reset", "--niveau", "work", "--oui")["supprimes"] == 3 and store.current_version(spark, root) is None and os.path.exists(f"{root}/journal")
    assert run("reset", "--niveau", "all", "--oui")["supprimes"] >= 2


@pytest.fixture
def endpoint():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            self.send_response(200 if self.path in ("/models", "/api/tags") else 404)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            out = {"/chat/completions": {"choices": [{"message": {"content": "{\"a\": 1}"}}]}, "/api/chat": {"message": {"content": "hello"}}, "/embeddings": {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body.get("input", []))))]}, "/api/embed": {"embeddings": [[9.0]] * len(body.get("input", []))}}[self.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"not json" if len(seen) == 1 else json.dumps(out).encode())

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_http_providers(endpoint, monkeypatch):
    monkeypatch.setattr(extract.time, "sleep", lambda s: None)
    url, seen = endpoint
    a = extract.HttpChatModel(url, "m", schema=extract.ANSWER_SCHEMA)
    assert a.available() and a.chat("s", "u") == '{"a": 1}' and len(seen) == 2  # the first answer was malformed
    assert seen[1][1]["response_format"]["json_schema"]["schema"]["required"] == ["entites", "relations"]
    b = extract.OllamaChatModel(url, "m")
    assert b.available() and b.chat("s", "u") == "hello" and seen[-1][1]["format"] == "json" and seen[-1][1]["options"]["num_ctx"] == 8192
    assert extract.HttpEncoder(url, "e")(["x", "y"]) == [[0.0], [1.0]] and extract.HttpEncoder(url, "e", "ollama")(["x"]) == [[9.0]]
    assert not extract.HttpChatModel("http://127.0.0.1:9", "m").available()
    assert extract.card_writer(b)("context") == "hello"


class Judge:
    name = "judge"

    def available(self):
        return True

    def chat(self, system, user):
        lines = user.split("\n")
        return json.dumps({"reponses": ["zz" in x for x in lines][: 1 if "short" in user else 99]})


def test_arbitration_in_lots(spark):
    pairs = spark.createDataFrame([("personne", f"a{i}", f"b{i}{'zz' if i % 3 == 0 else ''}", 85.0) for i in range(60)], "type string, a string, b string, score double")
    got = {r.a for r in extract.arbiter(Judge())(pairs).collect()}
    assert got == {f"a{i}" for i in range(0, 60, 3)}
    few = spark.createDataFrame([("personne", "short", "xzz", 85.0), ("personne", "b", "czz", 85.0)], "type string, a string, b string, score double").coalesce(1)
    assert [r.a for r in extract.arbiter(Judge())(few).collect()] == ["short"]
    ents = spark.createDataFrame([("module", n, "{}", "c", "", i) for i, n in enumerate(["paie rh", "pazzie rh"])], "type string, nom string, attributs string, chunk_id string, citation string, ordinal long")
    rels = spark.createDataFrame([], "type string, source_type string, source_nom string, cible_type string, cible_nom string, chunk_id string, citation string, ordinal long")
    assert resolve.resolve(ents, rels, default_ontology(), arbiter=extract.arbiter(Judge()))["nodes"].count() == 1
    assert knowledge.__doc__
