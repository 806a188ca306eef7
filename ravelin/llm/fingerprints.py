"""I-Match document fingerprints with randomised lexicon subsets.

Terms of the middle of the inverse-document-frequency range name what a document is about: the very frequent ones say
nothing and the very rare ones are typos. A fingerprint is the hash of a document's distinct lexicon terms in sorted order;
the first uses the whole lexicon, each other one a random subset of it, so that copies that differ in a few terms still
share some fingerprint.

The lexicon can't outgrow memory: a term with idf <= ``idf_hi`` is in at least ``n * exp(-idf_hi)`` documents, so there are at
most ``exp(idf_hi)`` times the mean number of distinct terms, whatever the corpus. It is still counted before it is
broadcast, and beyond ``broadcast_terms`` the terms are joined by a shuffle instead.

Defined cases: null and empty texts, and texts without a lexicon term, have ``n_terms`` 0 and null fingerprints; a subset
that holds none of a document's terms gives a null; repeated rows give repeated rows and count each in the document
frequencies; a null ``doc_id`` is carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import INT, LONG, STRING, pick, schema

IDF_LO, IDF_HI, SUBSETS = 2.0, 6.0, 4
#: A term stays out of a subset when the first byte of md5("subset|term"), in hex, is below this: one in three.
DROP_BELOW = "55"
_TERM = re.compile(r"[^\W_]+")
_FLUSH = 400_000


def _count_terms(batches):
    seen: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if text:
                seen.update(set(_TERM.findall(text.lower())))
        if len(seen) > _FLUSH:
            yield pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "df": list(seen.values())})
            seen = Counter()
    yield pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "df": pd.Series(list(seen.values()), dtype="int64")})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all documents; each task counts its own share first."""
    counts = pick(docs, text=text_col).mapInPandas(_count_terms, schema(term=STRING, df=LONG))
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", idf_lo: float = IDF_LO, idf_hi: float = IDF_HI) -> DataFrame:
    """(term, df) for the terms whose ln(n / df) is in [idf_lo, idf_hi]; n counts all rows."""
    n = docs.count()
    idf = F.log(F.lit(float(n)) / F.col("df"))
    return document_frequencies(docs, text_col).where((idf >= idf_lo) & (idf <= idf_hi))


def _subset_bits(term: str, subsets: int) -> int:
    return 1 | sum(1 << k for k in range(1, subsets + 1) if hashlib.md5(f"{k}|{term}".encode()).hexdigest()[:2] >= DROP_BELOW)


def fingerprint_names(subsets: int = SUBSETS) -> list[str]:
    return [f"fp{k}" for k in range(subsets + 1)]


def _by_broadcast(docs: DataFrame, terms: list[str], subsets: int) -> DataFrame:
    bits = docs.sparkSession.sparkContext.broadcast({t: _subset_bits(t, subsets) for t in terms})
    kind = T.StructType([T.StructField("n_terms", INT), *(T.StructField(f, STRING) for f in fingerprint_names(subsets))])

    @F.pandas_udf(kind)
    def prints(texts: pd.Series) -> pd.DataFrame:
        lex, rows = bits.value, []
        for text in texts:
            found = sorted(lex.keys() & set(_TERM.findall(text.lower()))) if text else []
            row = [len(found)]
            for k in range(subsets + 1):
                part = [t for t in found if lex[t] >> k & 1]
                row.append(hashlib.md5(" ".join(part).encode()).hexdigest() if part else None)
            rows.append(row)
        return pd.DataFrame(rows, columns=["n_terms", *fingerprint_names(subsets)])

    return docs.select("doc_id", prints("text").alias("p")).select("doc_id", "p.*")


def _sorted_hash(terms: Column, k: int) -> Column:
    kept = terms if k == 0 else F.filter(terms, lambda t: F.substring(F.md5(F.concat(F.lit(f"{k}|"), t)), 1, 2) >= DROP_BELOW)
    return F.when(F.size(kept) > 0, F.md5(F.array_join(kept, " ")))


def _by_shuffle(docs: DataFrame, terms: DataFrame, subsets: int) -> DataFrame:
    @F.pandas_udf(T.ArrayType(STRING))
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([list(set(_TERM.findall(t.lower()))) if t else [] for t in texts])

    rows = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    key = [F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("h")]
    found = rows.select(*key, F.explode(distinct_terms("text")).alias("term")).join(terms.select("term"), "term")
    found = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    base = rows.select(*key, "copies").alias("a")
    both = base.join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left")
    got = F.coalesce(F.col("b.terms"), F.array().cast("array<string>"))
    out = both.select(
        F.col("a.doc_id").alias("doc_id"), F.size(got).alias("n_terms"),
        *[_sorted_hash(got, k).alias(f) for k, f in enumerate(fingerprint_names(subsets))],
        F.explode(F.array_repeat(F.lit(0), F.col("a.copies").cast("int"))).alias("_c"),
    )
    return out.drop("_c")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_lo: float = IDF_LO, idf_hi: float = IDF_HI, subsets: int = SUBSETS, broadcast_terms: int = 2_000_000) -> DataFrame:
    """doc_id, n_terms, fp0 (whole lexicon), fp1.. (random subsets), a row for each row of ``docs``."""
    from ravelin.plans.lineage import materialise

    own = pick(docs, doc_id=id_col, text=text_col)
    lex = materialise(lexicon(own, "text", idf_lo, idf_hi).select("term"), "imatch-lexicon")
    if lex.count() > broadcast_terms:
        return _by_shuffle(own, lex, subsets)
    return _by_broadcast(own, [r.term for r in lex.collect()], subsets)


def op9_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FP_SQL = ",\n".join(
    f"md5(nullif(array_to_string(list_sort(list(term) FILTER (WHERE {'true' if k == 0 else f"substr(md5('{k}|' || term), 1, 2) >= '{DROP_BELOW}'"})), ' '), '')) AS fp{k}"
    for k in range(SUBSETS + 1)
)
OP9_SQL = rf"""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
lex AS (SELECT term FROM f WHERE ln((SELECT count(*) FROM documents)::DOUBLE / df) BETWEEN {IDF_LO} AND {IDF_HI}),
g AS (SELECT doc_id, count(*)::INTEGER AS n_terms, {_FP_SQL} FROM t JOIN lex USING (term) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_terms, 0)::INTEGER AS n_terms, {", ".join(f"fp{k}" for k in range(SUBSETS + 1))}
FROM documents d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op9_fingerprints": op9_fingerprints}
SQL = {"op9_fingerprints": OP9_SQL}
