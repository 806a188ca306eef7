"""The build from a folder of documents to a published knowledge base, with what hasn't changed taken over from the version before.

Passes: normalise (scan, convert, cut), extract, resolve, enrich (cards, vectors), load (prune, publish), report. Each pass leaves a journal. The caches are tables
of the published version: ``texts`` (a document's Markdown, reused while its bytes and the configuration are the same), ``answers``, ``cards`` and
``vectors``, each by its fingerprint. A pass that fails publishes nothing; answers are saved in lots below ``ROOT/work`` and found there by the next try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import audit, enrich, extract, resolve, store
from ravelin.plans.config import Config
from ravelin.plans.lineage import materialise
from ravelin.plans.ontology import Ontology, default_ontology
from ravelin.sources import files, jsonl

PASSES = ("normalise", "extract", "resolve", "enrich", "load")


def _previous(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return store.open_base(spark, root) if store.current_version(spark, root) else {}


def normalise(spark: SparkSession, source: str, before: dict[str, DataFrame], config: Config, converters=None, journal: audit.Journal | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with markdown, states): only new and changed files are converted."""
    found = materialise(files.scan_files(spark, source), "build-files")
    now = files.manifest(found, config.max_chunk)
    old = before.get("texts")
    states = files.manifest_diff(now, old) if old is not None else now.select("doc_id", F.lit("nouveau").alias("etat"))
    states = materialise(states, "build-states")
    todo = found.withColumn("doc_id", files.document_id(F.col("chemin_source"))).join(states.where("etat IN ('nouveau', 'modifie')"), "doc_id", "left_semi").drop("doc_id")
    converted = materialise(files.convert(todo, converters), "build-converted")
    docs = files.documents_of(converted).withColumn("config", F.lit(f"max_chunk={config.max_chunk}"))
    if old is not None:
        kept = old.drop("mtime", "taille").join(states.where("etat IN ('inchange', 'identique')"), "doc_id", "left_semi").join(now.select("doc_id", "mtime", "taille"), "doc_id")
        docs = docs.unionByName(kept.select(*docs.columns))
    docs = materialise(docs, "build-documents")
    if journal:
        for r in states.groupBy("etat").count().collect():  # at most five rows
            journal.count(r.etat, r["count"])
        for r in converted.where("NOT ok").select("chemin_source", "erreur").limit(journal.limit).collect():
            journal.incident("erreur" if r.erreur else "avertissement", r.chemin_source, r.erreur or "empty document")
    return docs, states


def build(spark: SparkSession, source: str, root: str, ontology: Ontology | None = None, config: Config | None = None, model: extract.ChatModel | None = None, encoder: Callable | None = None, writer: Callable[[str], str] | None = None, converters=None, arbiter=None) -> dict:
    """Builds and publishes a version of the base at ``root`` from the files below ``source``; {version, statut, rapport}."""
    ontology, config, model = ontology or default_ontology(), config or Config(), model or extract.OfflineModel()
    root, before = root.rstrip("/"), _previous(spark, root)
    journal = lambda name: audit.Journal(spark, f"{root}/journal", name, config)
    if not model.available():
        raise RuntimeError(f"the model {model.name} doesn't answer")
    with journal("normalise") as j:
        texts, _ = normalise(spark, source, before, config, converters, j)
        chunks = materialise(files.chunks_of(texts, config.max_chunk, config.small_chunk), "build-chunks")
        j.count("passages", chunks.count())
    with journal("extract") as j:
        work = f"{root}/work/answers"
        saved = store.read_if_there(spark, work, extract._ANSWERS)
        cache = saved.unionByName(before["answers"]).dropDuplicates(["chunk_id", "sha"]) if "answers" in before else saved
        answers = extract.ask_in_lots(chunks, ontology, model, lambda df: store.append(df, work), config, materialise(cache.where("echec IS NULL"), "build-cache"))
        answers = materialise(answers, "build-answers")
        j.count("reponses", answers.where("echec IS NULL").count())
        for r in answers.where("echec IS NOT NULL").select("chunk_id", "echec").limit(config.max_incidents).collect():
            j.incident("erreur", r.chunk_id, r.echec)
    with journal("resolve") as j:
        # the order of first sight: documents by id, passages by their place
        order = chunks.select("chunk_id", (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) * 65536 + F.col("ordre")).alias("rang"))
        entities, relations = extract.validate(answers, ontology, order)
        graph = resolve.resolve(entities, relations, ontology, config, arbiter)
        for r in graph["counters"].collect():
            j.count(r.cle, r.valeur)
    with journal("enrich") as j:
        contexts = enrich.node_contexts(graph["nodes"], graph["mentions"], chunks, config.max_contexte)
        cards = materialise(enrich.write_cards(contexts, writer or enrich.template_card, model.name, before.get("cards")), "build-cards")
        nodes = graph["nodes"].drop("fiche").join(cards.select("node_id", "fiche"), "node_id", "left")
        vectors = {}
        for name, rows in (("chunks_vec", enrich.chunk_texts(chunks)), ("nodes_vec", enrich.node_texts(nodes))):
            vectors[name] = materialise(enrich.embed(rows, encoder, config.embedding_model, config.dim_embedding, before.get(name)), f"build-{name}")
        for r in cards.where("echec IS NOT NULL").select("node_id", "echec").limit(config.max_incidents).collect():
            j.incident("erreur", r.node_id, r.echec)
        j.count("fiches", cards.where("fiche IS NOT NULL").count())
    with journal("load") as j:
        documents = texts.select("doc_id", "chemin_source", "titre", "type_document", "date_document", "sha256").withColumn("ingere_le", F.current_timestamp())
        tables, lost = store.prune({"documents": documents, "chunks": chunks, "nodes": nodes, "aliases": graph["aliases"], "mentions": graph["mentions"], "edges": graph["edges"]})
        for name, owner, key in (("chunks_vec", "chunks", "chunk_id"), ("nodes_vec", "nodes", "node_id")):
            tables[name], bad = store.good_vectors(vectors[name], tables[owner].select(key), config.dim_embedding)
            j.count(f"rejets_{name}", bad.count())
        for r in lost.collect():
            j.count(f"rejets_{r.table}", r.n)
        version = store.publish(spark, root, tables | {"texts": texts, "answers": answers.where("echec IS NULL"), "cards": cards})
        store.remove(spark, work)
    base = store.open_base(spark, root)
    journals = jsonl.read_journals(spark, f"{root}/journal")
    rapport = audit.report(base, ontology, journals, list(PASSES))
    store.write_text(spark, f"{root}/rapport.md", rapport)
    return {"version": version, "statut": audit.global_status(journals, list(PASSES)), "rapport": rapport}
