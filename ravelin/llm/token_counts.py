"""Token counts of sections and fields, attributed by offsets.

A text is encoded once and as a whole, because cutting it first changes the tokens at the cuts. Tokens and sections are
then intervals of the same byte line (a token's length is that of its bytes), and an interval join gives each token to a
section. A token that crosses a boundary goes by the rule:

* ``start``: to the section that holds its first byte (the default);
* ``majority``: to the section that holds most of its bytes, the earlier one of equals;
* ``share``: to each section in proportion to its bytes, as a fraction.

Under every rule the counts of a text's sections add up to the tokens of the whole text. The vocabulary file is read on the driver and
broadcast; it has one size for any corpus. Encoding runs in Arrow batches in the scan's stage: no shuffle.

Sections are lines; a line's end belongs to the line. Fields are columns, joined by ``joiner``, which belongs to the field
before it. Defined cases: a null or empty text has one section without tokens; a null field is an empty one; repeated rows give
repeated rows; a null ``doc_id`` is carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import DOUBLE, INT, LONG, STRING, pick, schema

#: A rank file: a base64 token and its number a line. The path is a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "share")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Built once in a worker from broadcast ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.bytes_of[number] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, byte after the last) of each token of the whole text."""
        length = self.bytes_of[self.encoding.encode_to_numpy(text, disallowed_special=())]
        ends = np.cumsum(length)
        return ends - length, ends


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``cuts`` has the sections' first bytes and the end of the text."""
    sections = len(cuts) - 1
    if not len(starts) or not sections:
        return np.zeros(sections)
    first = np.searchsorted(cuts[:-1], starts, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=sections).astype(float)
    last = np.searchsorted(cuts[:-1], ends - 1, side="right") - 1
    inside = first == last
    out = np.bincount(first[inside], minlength=sections).astype(float)
    for a, b, i, j in zip(starts[~inside], ends[~inside], first[~inside], last[~inside], strict=True):
        own = np.minimum(cuts[i + 1 : j + 2], b) - np.maximum(cuts[i : j + 1], a)
        if rule == "share":
            out[i : j + 1] += own / (b - a)
        else:
            out[i + int(np.argmax(own))] += 1
    return out


def line_cuts(raw: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    inner = ends[ends < len(raw)]
    return np.r_[0, inner, len(raw)].astype(np.int64)


def _shared_encoder(spark, path: str):
    ranks, held = spark.sparkContext.broadcast(read_ranks(path)), {}

    def get() -> Encoder:
        if "e" not in held:
            held["e"] = Encoder(ranks.value)
        return held["e"]

    return get


def token_count_column(spark, text, vocabulary: str = VOCABULARY):
    """Tokens of each whole text, 0 for null; the text is encoded in Arrow batches in the scan's stage."""
    encoder = _shared_encoder(spark, vocabulary)

    @F.pandas_udf(LONG)
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder().encoding
        return pd.Series([len(enc.encode_to_numpy(t, disallowed_special=())) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count(text)


def section_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), first_byte, n_bytes, n_tokens (a double under the rule ``share``), a row for each line of each text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    encoder = _shared_encoder(docs.sparkSession, vocabulary)

    def count(batches):
        enc = encoder()
        for pdf in batches:
            cuts, counts = [], []
            for t in pdf["text"]:
                raw = t.encode() if isinstance(t, str) else b""
                c = line_cuts(raw) if raw else np.zeros(2, np.int64)
                cuts.append(c)
                counts.append(attribute(*enc.spans(t), c, rule) if raw else np.zeros(1))
            if not len(pdf):
                continue
            n = np.array([len(c) for c in counts])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64").repeat(n).reset_index(drop=True), "section": np.concatenate([np.arange(k, dtype=np.int32) for k in n]),
                "first_byte": np.concatenate([c[:-1] for c in cuts]), "n_bytes": np.concatenate([np.diff(c) for c in cuts]), "n": np.concatenate(counts),
            })

    own = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = own.mapInPandas(count, schema(doc_id=LONG, section=INT, first_byte=LONG, n_bytes=LONG, n=DOUBLE))
    n = F.col("n") if rule == "share" else F.col("n").cast("long")
    return out.select("doc_id", "section", "first_byte", "n_bytes", n.alias("n_tokens"))


def field_token_counts(rows: DataFrame, fields: list[str], vocabulary: str = VOCABULARY, rule: str = "start", joiner: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """id, field, n_tokens: the fields of a row joined by ``joiner`` are encoded as one text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    encoder = _shared_encoder(rows.sparkSession, vocabulary)
    last = len(fields) - 1

    def count(batches):
        enc = encoder()
        for pdf in batches:
            ids, names, n = [], [], []
            for key, values in zip(pdf["id"], pdf[[f"f{i}" for i in range(len(fields))]].itertuples(index=False), strict=True):
                parts = [(v if isinstance(v, str) else "") + (joiner if i < last else "") for i, v in enumerate(values)]
                cuts = np.r_[0, np.cumsum([len(p.encode()) for p in parts])]
                got = attribute(*enc.spans("".join(parts)), cuts, rule)
                ids += [key] * len(fields)
                names += fields
                n += got.tolist()
            yield pd.DataFrame({"id": pd.array([None if pd.isna(x) else int(x) for x in ids], dtype="Int64"), "field": names, "n": n})

    own = pick(rows, id=id_col, **{f"f{i}": f for i, f in enumerate(fields)})
    own = own.select(F.col("id").cast("long").alias("id"), *[F.col(f"f{i}").cast("string").alias(f"f{i}") for i in range(len(fields))])
    out = own.mapInPandas(count, schema(id=LONG, field=STRING, n=DOUBLE))
    return out.select("id", "field", (F.col("n") if rule == "share" else F.col("n").cast("long")).alias("n_tokens"))


def op8_token_counts(spark, sf_dir):
    return section_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
