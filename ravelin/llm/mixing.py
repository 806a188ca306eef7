"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are spread over shards by a hash. In a shard each source's documents, in a seeded order, are laid end to end and
cut into blocks of equal tokens; a document belongs to the block that holds its first token. A shard has
``floor(budget * blocks)`` seats, and they go one by one to the source with the highest quotient weight / (2 k - 1), where k
is the number of seats it would then have: integer quotas that stay close to the weights. A source that has no block left
gets no further seat and the seats go on to the next quotients; with a large budget availability, not the weights, then
decides the mix, and ``realised_shares`` reports by how much. The blocks that fill a quota are drawn by a seeded hash.

Tokens are byte-pair tokens of the whole text (``vocabulary``: a rank file; None counts runs of non-blanks, which SQL can do too). They are counted
in one scan, and from then on a document is its id, source, length and hashes: no text is shuffled, but by ``mix`` when those that aren't drawn
are too many to be broadcast (they are counted first).

A shard holds about ``shard_docs`` documents whatever the corpus, so the windows stay small and there are more of them when
there is more data; it follows from the id and the text, so that many rows of one id are spread. Quotas are worked out on (shard, source) totals.

Defined cases: sources without a weight take ``default_weight``; weight 0 or less: never chosen; a null source is a
source of its own, shown as null; null and empty texts have no tokens and are not selected; quotients that tie go by
source name (null first), documents that tie by ``doc_id`` and text; rows that repeat id, source and text count each, are put together in the
block of the first and drawn or not together; an empty
table gives an empty result; extra columns are kept by ``mix`` and ignored by ``mixing_decisions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import pick, row_hashes, word_count
from ravelin.llm.token_counts import VOCABULARY, token_count_column
from ravelin.plans.lineage import broadcast_below, materialise

SEED, SHARD_DOCS, BLOCK_TOKENS, BUDGET, DEFAULT_WEIGHT = 7, 4000, 4096, 0.9, 2.0
_BATCH, _BROADCAST_ROWS = 1000, 1_000_000
#: Target weights; a source that isn't named has the default.
WEIGHTS = {"src0": 3.0, "src3": 1.0, "src7": 4.0}


def _hash32(*parts):
    """An unsigned 32-bit number from md5, which SQL engines share."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _lengths(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str | None, *carried) -> DataFrame:
    """_id, _source, _tokens, _tie and what is carried, for each row, written."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    n = token_count_column(docs.sparkSession, text, vocabulary) if vocabulary else word_count(text)
    return materialise(docs.select(own.alias("_id"), F.col(f"`{source_col}`").alias("_source"), n.alias("_tokens"), F.md5(F.coalesce(text, F.lit(""))).alias("_tie"), *carried), "mix-lengths", _BATCH)


def _decide(rows: DataFrame, weights: dict[str, float], default_weight: float, budget: float, block_tokens: int, seed: int, shard_docs: int) -> DataFrame:
    """A row for each different row of ``rows``; adds _copies, _shard, _block, _selected."""
    n = rows.count()
    shards = max(1, -(-n // shard_docs))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumns({"_each": F.col("_tokens"), "_tokens": F.col("_tokens") * F.col("_copies")})
    placed = rows.withColumns({"_shard": _hash32(F.lit(seed), F.lit("shard"), F.col("_id"), F.col("_tie")) % shards, "_order": _hash32(F.lit(seed), F.lit("order"), F.col("_id"))})
    group = ["_shard", "_skey"]
    placed = placed.withColumn("_skey", F.concat(F.lit("s"), F.coalesce("_source", F.lit(""))))
    placed = placed.withColumn("_skey", F.when(F.col("_source").isNull(), F.lit("")).otherwise(F.col("_skey")))
    upto = Window.partitionBy(*group).orderBy("_order", "_id", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = placed.withColumn("_block", F.floor((F.sum("_tokens").over(upto) - F.col("_tokens")) / block_tokens).cast("long"))

    totals = placed.groupBy(*group).agg(F.sum("_tokens").alias("t"), F.first("_source").alias("s"))
    totals = totals.where(F.col("t") > 0).select(*group, "s", F.ceil(F.col("t") / block_tokens).cast("long").alias("avail"))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    weight = F.coalesce(F.try_element_at(table, F.col("s")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    seats = Window.partitionBy("_shard")
    seat = totals.withColumns({"w": weight, "seats": F.floor(F.sum("avail").over(seats) * F.lit(budget)).cast("long")})
    seat = seat.where(F.col("w") > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("avail"))).alias("k"))
    ranked = seat.withColumn("r", F.row_number().over(Window.partitionBy("_shard").orderBy(F.desc(F.col("w") / (2 * F.col("k") - 1)), "_skey", "k")))
    quota = ranked.where(F.col("r") <= F.col("seats")).groupBy(*group).agg(F.max("k").alias("quota"), F.max("avail").alias("avail"))
    drawn = quota.select(*group, "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("avail") - 1)).alias("b"))
    draw = Window.partitionBy(*group).orderBy(_hash32(F.lit(seed), F.lit("draw"), F.col("_shard"), F.col("_skey"), F.col("b")), "b")
    drawn = drawn.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= F.col("quota"))
    chosen = drawn.groupBy(*group).agg(F.collect_set("b").alias("_chosen"))
    out = blocks.join(chosen, group, "left")
    hit = F.coalesce(F.array_contains("_chosen", F.col("_block")), F.lit(False)) & (F.col("_tokens") > 0)
    return out.withColumn("_selected", hit).drop("_chosen", "_tokens").withColumnRenamed("_each", "_tokens")


def mixing_decisions(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, shard, block, selected, a row for each document."""
    own = _lengths(docs, id_col, text_col, source_col, vocabulary)
    done = _decide(own, WEIGHTS if weights is None else weights, default_weight, budget, block_tokens, seed, shard_docs)
    done = done.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return done.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_shard").alias("shard"), F.col("_block").alias("block"), F.col("_selected").alias("selected"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The selected documents with all their columns."""
    names, hashes = row_hashes(docs, id_col, text_col, source_col)
    own = _lengths(docs, id_col, text_col, source_col, vocabulary, *hashes)
    done = _decide(own, WEIGHTS if weights is None else weights, default_weight, budget, block_tokens, seed, shard_docs)
    out = materialise(done.where(~F.col("_selected")).select(*names).distinct(), "mix-left-out")
    return docs.select("*", *hashes).join(broadcast_below(out, out.count(), _BROADCAST_ROWS), names, "left_anti").drop(*names)


def realised_shares(decisions: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT) -> DataFrame:
    """source, available, selected (tokens), target, share, exhausted: what ``mixing_decisions`` drew of each source against its weight."""
    chosen = F.sum(F.when(F.col("selected"), F.col("n_tokens")).otherwise(0))
    own = decisions.groupBy("source").agg(F.sum("n_tokens").alias("available"), chosen.alias("selected")).where("available > 0")
    weights = WEIGHTS if weights is None else weights
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(name), F.lit(float(w))).otherwise(weight)
    own = own.withColumn("_w", F.greatest(weight, F.lit(0.0)))
    total = own.agg(F.sum("_w").alias("_all_w"), F.sum("selected").alias("_all"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return own.crossJoin(F.broadcast(total)).select("source", "available", "selected", share("_w", "_all_w").alias("target"), share("selected", "_all").alias("share"), (F.col("selected") == F.col("available")).alias("exhausted"))


def op6_mixing(spark, sf_dir):
    return mixing_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_by_words(spark, sf_dir):
    """The same apportionment over counts of words, which SQL can state."""
    return mixing_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=None)


def _sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


_CASES = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())


def mixing_sql(docs: str = "documents") -> str:
    """The same decisions by words in SQL, over a relation with doc_id, text and source."""
    return rf"""
WITH n AS (SELECT greatest(1, ceil(count(*) / {SHARD_DOCS}.0))::BIGINT AS shards FROM {docs}),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tie,
             {_sql_hash(str(SEED), "'shard'", "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")} % shards AS shard, {_sql_hash(str(SEED), "'order'", "coalesce(doc_id::VARCHAR, '')")} AS o,
             CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS skey FROM {docs}, n),
b AS (SELECT *, floor((sum(n_tokens) OVER (PARTITION BY shard, skey ORDER BY o, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) - n_tokens) / {BLOCK_TOKENS}.0)::BIGINT AS block FROM d),
t AS (SELECT shard, skey, any_value(source) AS s, ceil(sum(n_tokens) / {BLOCK_TOKENS}.0)::BIGINT AS avail FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
w AS (SELECT *, CASE s {_CASES} ELSE {DEFAULT_WEIGHT} END::DOUBLE AS w, floor(sum(avail) OVER (PARTITION BY shard)::DOUBLE * {BUDGET}::DOUBLE)::BIGINT AS seats FROM t),
k AS (SELECT *, unnest(range(1, avail + 1)) AS k FROM w WHERE w > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY w / (2 * k - 1) DESC, skey, k) AS r FROM k),
q AS (SELECT shard, skey, max(k) AS quota, max(avail) AS avail FROM r WHERE r <= seats GROUP BY ALL),
x AS (SELECT shard, skey, quota, unnest(range(0, avail)) AS b FROM q),
c AS (SELECT *, row_number() OVER (PARTITION BY shard, skey ORDER BY {_sql_hash(str(SEED), "'draw'", "shard", "skey", "b")}, b) AS r FROM x)
SELECT b.doc_id, b.source, b.n_tokens, b.shard, b.block, (c.b IS NOT NULL AND b.n_tokens > 0) AS selected
FROM b LEFT JOIN c ON b.shard = c.shard AND b.skey = c.skey AND b.block = c.b AND c.r <= c.quota
"""


QUERIES = {"op6_mixing": op6_mixing, "mixing_by_words": mixing_by_words}
SQL = {"mixing_by_words": mixing_sql()}
