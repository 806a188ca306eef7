"""Extraction by a pluggable model: prompt, answers in Arrow batches, mending, validation under the ontology, reuse by fingerprint."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.json_repair import first_object
from ravelin.functions.names import text_fingerprint
from ravelin.plans.config import Config
from ravelin.plans.ontology import Ontology

_NUL = "\0"
T_ = TypeVar("T_")


class ChatModel(Protocol):
    name: str

    def available(self) -> bool: ...

    def chat(self, system: str, user: str) -> str: ...


class OfflineModel:
    """No model at all: the answer is the JSON object that the passage itself holds, or an empty one. For tests and dry runs."""

    name = "offline-template"

    def available(self) -> bool:
        return True

    def chat(self, system: str, user: str) -> str:
        at = user.find("{")
        return user[at:] if at >= 0 else '{"entites": [], "relations": []}'


def _post(url: str, body: dict, timeout: float, tries: int, read: Callable[[dict], T_]) -> T_:
    """What ``read`` makes of the answer; a failed call and an answer of another form are tried again, 2 and 4 seconds later."""
    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(call, timeout=timeout) as answer:
                return read(json.load(answer))
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            if attempt == tries:
                raise
            time.sleep(2 * attempt)
    raise AssertionError("unreachable")


def _reachable(url: str) -> bool:
    try:
        with urllib.request.urlopen(url, timeout=3) as answer:
            return answer.status == 200
    except (OSError, ValueError):
        return False


class HttpChatModel:
    """A chat endpoint with the usual ``/chat/completions`` form; with a schema, answers are bound to it. Three tries, 2 and 4 seconds apart."""

    def __init__(self, base_url: str, name: str, timeout: float = 900.0, tries: int = 3, schema: dict | None = None, max_tokens: int = 4096):
        self.base_url, self.name, self.timeout, self.tries, self.schema, self.max_tokens = base_url.rstrip("/"), name, timeout, tries, schema, max_tokens

    def available(self) -> bool:
        return _reachable(f"{self.base_url}/models")

    def chat(self, system: str, user: str) -> str:
        body = {"model": self.name, "temperature": 0, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.schema is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": self.schema}}
        return _post(f"{self.base_url}/chat/completions", body, self.timeout, self.tries, lambda a: a["choices"][0]["message"]["content"])


class OllamaChatModel:
    """The other common form: ``/api/chat`` without a stream, its context size and answer length as options."""

    def __init__(self, base_url: str, name: str, timeout: float = 900.0, tries: int = 3, as_json: bool = True, num_ctx: int = 8192, num_predict: int = 4096):
        self.base_url, self.name, self.timeout, self.tries, self.as_json = base_url.rstrip("/"), name, timeout, tries, as_json
        self.options = {"temperature": 0, "num_ctx": num_ctx, "num_predict": num_predict}

    def available(self) -> bool:
        return _reachable(f"{self.base_url}/api/tags")

    def chat(self, system: str, user: str) -> str:
        body = {"model": self.name, "stream": False, "options": self.options, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return _post(f"{self.base_url}/api/chat", body | ({"format": "json"} if self.as_json else {}), self.timeout, self.tries, lambda a: a["message"]["content"])


#: What an extraction answer is bound to.
ANSWER_SCHEMA = {"type": "object", "required": ["entites", "relations"], "properties": {k: {"type": "array", "items": {"type": "object"}} for k in ("entites", "relations")}}


def arbiter(model: ChatModel, lot: int = 25):
    """An arbiter of doubtful pairs of names by a model, asked in lots: true for one entity. What isn't answered, or fails, is no."""
    system = "For each numbered pair of names of one type, say if both name the same entity. Answer as a JSON object: {\"reponses\": [true or false, ...]}, one for each pair, in order."

    def decide(pairs: DataFrame) -> DataFrame:
        if not model.available():
            return pairs.limit(0)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), lot):
                    part = pdf.iloc[lo : lo + lot]
                    asked = "\n".join(f"{i}. [{r.type}] {r.a} / {r.b}" for i, r in enumerate(part.itertuples(index=False), 1))
                    try:
                        said = first_object(model.chat(system, asked)).get("reponses")
                    except Exception:  # a lot that fails joins nothing
                        said = None
                    said = said if isinstance(said, list) else []
                    yield part[[i < len(said) and said[i] is True for i in range(len(part))]]

        return pairs.mapInPandas(run, pairs.schema)

    return decide


def card_writer(model: ChatModel) -> Callable[[str], str]:
    """A writer of cards by a model; an empty answer is a failure, so that the old card stays."""

    def write(context: str) -> str:
        said = model.chat("Write a short factual card about the entity from the quoted passages only, without anything they don't say.", context).strip()
        if not said:
            raise ValueError("empty answer")
        return said

    return write


class HttpEncoder:
    """Vectors from an endpoint: ``/embeddings`` (put in order by index) or, as ``ollama``, ``/api/embed``; lots are the caller's."""

    def __init__(self, base_url: str, name: str, form: str = "openai", timeout: float = 300.0, tries: int = 3):
        self.base_url, self.name, self.form, self.timeout, self.tries = base_url.rstrip("/"), name, form, timeout, tries

    def available(self) -> bool:
        return _reachable(f"{self.base_url}/{'models' if self.form == 'openai' else 'api/tags'}")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        def read(answer: dict) -> list[list[float]]:
            found = [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])] if self.form == "openai" else answer["embeddings"]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found

        return _post(f"{self.base_url}/{'embeddings' if self.form == 'openai' else 'api/embed'}", {"model": self.name, "input": texts}, self.timeout, self.tries, read)


def system_prompt(ontology: Ontology) -> str:
    kinds = "\n".join(f"* {t}: {ontology.descriptions.get(t, '')}" for t in ontology.prefixes)
    ties = "\n".join(f"* {n}: {' / '.join(r.sources)} to {' / '.join(r.cibles)}" for n, r in ontology.relations.items())
    return f"List the entities and the relations that the passage states, as one JSON object.\nEntity types:\n{kinds}\nRelation types:\n{ties}\nKeys: entites (type, nom, attributs, citation), relations (type, source_type, source_nom, cible_type, cible_nom, citation)."


def fingerprints(chunks: DataFrame, ontology: Ontology, model: ChatModel) -> DataFrame:
    """Adds sha: of the text, the prompt and the model together."""
    setting = text_fingerprint(F.lit(system_prompt(ontology) + _NUL + model.name))
    return chunks.withColumn("sha", text_fingerprint(F.concat("texte", F.lit(_NUL), setting)))


_ANSWERS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("reponse", T.StringType()), T.StructField("echec", T.StringType())])


def ask(chunks: DataFrame, ontology: Ontology, model: ChatModel, config: Config | None = None, cache: DataFrame | None = None) -> DataFrame:
    """chunk_id, sha, reponse (the JSON object), echec: a row for each passage. Successes of ``cache`` with the same sha are taken over; failures
    are asked again. A task has up to ``config.concurrence`` calls open at once; tasks are as many as the passages' partitions, so a cluster isn't held to one funnel."""
    config = config or Config()
    todo, prompt, limit = fingerprints(chunks, ontology, model), system_prompt(ontology), config.max_chars_prompt
    done = None
    if cache is not None:
        good = cache.where(F.col("echec").isNull()).select("chunk_id", "sha", "reponse", "echec")
        done = good.join(todo.select("chunk_id", "sha"), ["chunk_id", "sha"], "left_semi")
        todo = todo.join(good.select("chunk_id", "sha"), ["chunk_id", "sha"], "left_anti")

    def one(r) -> tuple:
        try:
            answer = first_object(model.chat(prompt, f"[{r.chunk_id}] {r.chemin_titres or ''}\n{(r.texte or '')[:limit]}"))
            return r.chunk_id, r.sha, json.dumps(answer, ensure_ascii=False), None
        except Exception as e:  # a failed passage is a row of its own
            return r.chunk_id, r.sha, None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, config.concurrence)) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, pdf.itertuples(index=False))), columns=_ANSWERS.names)

    asked = todo.select("chunk_id", "chemin_titres", "texte", "sha").mapInPandas(run, _ANSWERS)
    return asked if done is None else asked.unionByName(done)


def ask_in_lots(chunks: DataFrame, ontology: Ontology, model: ChatModel, save: Callable[[DataFrame], DataFrame], config: Config | None = None, cache: DataFrame | None = None, lots: int = 8) -> DataFrame:
    """``ask`` in ``lots`` by a hash of the passage; ``save`` writes each lot before the next is asked and gives it back, so a job that is
    lost loses one lot of answers: what was saved comes in again by ``cache``."""
    out = None
    for i in range(lots):
        part = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(lots)) == i)
        own = cache.where(F.pmod(F.xxhash64("chunk_id"), F.lit(lots)) == i) if cache is not None else None
        got = save(ask(part, ontology, model, config, own))
        out = got if out is None else out.unionByName(got)
    return out


_STR = "string"
_ENTITIES = "array<string>"


def _items(answers: DataFrame, field: str, names: list[str]) -> DataFrame:
    each = answers.where(F.col("reponse").isNotNull()).select("chunk_id", F.posexplode(F.from_json(F.get_json_object("reponse", f"$.{field}"), _ENTITIES)).alias("i", "x"))
    cols = [F.trim(F.get_json_object("x", f"$.{n}")).alias(n) for n in names]
    rows = each.select("chunk_id", "i", *cols, F.get_json_object("x", "$.attributs").alias("attributs"), F.substring(F.coalesce(F.get_json_object("x", "$.citation"), F.lit("")), 1, 500).alias("citation"))
    return rows.withColumn("ordinal", F.xxhash64("chunk_id").bitwiseAND(F.lit(0x7FFFFFFFFFFF0000)) + F.col("i"))


def validate(answers: DataFrame, ontology: Ontology, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): items that are objects of a known type with names; attributs that are no object become {}; citations end at 500 characters.

    ``order`` (chunk_id, rang) gives the order of passages for "first seen"; without it an order by hash of the passage.
    """
    ent = _items(answers, "entites", ["type", "nom"]).where(F.col("type").isin(*ontology.prefixes) & (F.length("nom") > 0))
    ent = ent.withColumn("attributs", F.when(F.startswith(F.trim("attributs"), F.lit("{")), F.col("attributs")).otherwise("{}"))
    rel = _items(answers, "relations", ["type", "source_type", "source_nom", "cible_type", "cible_nom"])
    rel = rel.where(F.col("type").isin(*ontology.relations) & (F.length("source_nom") > 0) & (F.length("cible_nom") > 0) & F.col("source_type").isin(*ontology.prefixes) & F.col("cible_type").isin(*ontology.prefixes))
    if order is not None:
        ranks = order.select("chunk_id", F.col("rang").cast("long").alias("_rang"))
        ent, rel = (d.join(ranks, "chunk_id").withColumn("ordinal", F.col("_rang") * 100_000 + F.col("i")).drop("_rang") for d in (ent, rel))
    return ent.drop("i"), rel.drop("i", "attributs")
