"""Near-duplicate groups by BagMinHash signatures, banding, and exact multiset overlap.

Features are the 3-word shingles of the lower-cased words, with their counts as weights. The weight line of a feature is cut at
1, 2, 4, 8, ...; each of these dyadic pieces carries a Poisson process of its own with a rate of its length, whose points have a time, a signature component and a
32-bit mark, the point's place in the piece. A document sees the points below its count, and each component keeps the earliest of them: two documents agree in a component with probability
equal to their weighted Jaccard similarity, without bias (after Ertl, BagMinHash, 2018; the hierarchy is one level of pieces, and the bits of the mark stand for
all further halvings, which has the same law). A piece that begins at or above the count is never drawn. A piece is followed only to the time by
which all components are expected to be filled, so a feature costs about one draw and not one for each component; a
document with an unfilled component is drawn on to twice the time.

Four components make a band. Documents that share a band are candidates; nothing caps a band. Identical multisets are
put together first and only the one with the least id goes on. Then, with the exact multiset Jaccard of the shingles as the judge:

1. each document is compared with the least document of all its bands: in a group of copies nearly all end here;
2. in bands whose documents are not yet all in one group, the ``_HUBS`` least documents with all of other groups, and so on in blocks of the next least until no band
   holds several groups or has documents left. Groups are joined after each block, which ends most bands at once.

So every candidate pair is either in one group already or compared. Groups are the connected components of the pairs
that reach the threshold, and ``group_id`` is the least ``doc_id`` of the group. No step collects a band or a group: least ids and
counts are aggregated before the shuffle, and keys with more than a thousandth of all rows, of which there can't be more than a thousand, are joined by broadcast.

Defined cases: texts without a word, and null texts, have no features: each is a group of its own and is kept; texts of one or
two words have a single shingle; a null ``doc_id`` can't be named in a pair: such rows have a null group and are kept;
rows that repeat a ``doc_id`` are one document, which matches what any of its texts matches, and one row of it is kept: the one with
the least hash of its text, then of all its columns; an
empty table gives an empty result; extra columns are kept by ``near_dedup`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import LONG, free_name, pick
from ravelin.plans.components import components
from ravelin.plans.lineage import broadcast_below, discard, materialise

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 24, 4, 0.5
_WORD = re.compile(r"[^\W_]+")
_CHUNK_CHARS, _BROADCAST_ROWS = 1_000_000, 1_000_000
#: Documents of a band that are compared with all its others at once, the first time and later; a key is hot with more than one in _HOT rows; rows of a batch that hold texts.
_HUBS, _HOT, _SALTS, _BATCH = (8, 64), 1000, 32, 500
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 48-bit shingle hash) for every shingle of every text."""
    words: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _WORD.findall(t.lower())
            lengths[i] = len(found)
            words += found
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    ends = np.cumsum(lengths)
    grams = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(ends - lengths, grams)
    out = np.zeros(len(doc), _U)
    last = ends[doc]
    for k in range(SHINGLE):
        there = at + k < last
        part = np.where(there, h[np.minimum(at + k, len(h) - 1)], _U(k + 1))
        out = _mix(out * _U(0x9E3779B97F4A7C15) + part + _U(k))
    return doc, out >> _U(16)


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, count), sorted by both."""
    doc, h = shingle_hashes(texts)
    if not len(doc):
        return doc, h, np.zeros(0, np.int64)
    out = []
    for lo in range(0, len(texts), 1 << 16):  # 16 bits of document number beside 48 of hash
        i, j = np.searchsorted(doc, [lo, lo + (1 << 16)])
        if i == j:
            continue
        key = np.sort(((doc[i:j] - lo).astype(_U) << _U(48)) | h[i:j])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out.append(((key[first] >> _U(48)).astype(np.int64) + lo, key[first] & _U((1 << 48) - 1), np.diff(np.r_[first, len(key)])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures(doc: np.ndarray, item: np.ndarray, count: np.ndarray, docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures (docs x m, times of the earliest points); rows of documents without items stay infinite."""
    sig = np.full((docs, m), np.inf)
    if not len(doc):
        return sig
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1  # pieces [0,1), [1,2), [2,4), ... that begin below the count
    d, w = np.repeat(doc, levels), np.repeat(count, levels).astype(np.float64)
    level = np.arange(len(d)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    size = np.where(level == 0, 1.0, start)
    seed = _mix(np.repeat(item, levels) * _U(64) + level.astype(_U) + _U(0x1234567))
    total = np.bincount(doc, weights=count, minlength=docs)
    limit = m * (np.log(m) + 3.0) / np.maximum(total, 1.0)
    flat = sig.reshape(-1)
    alive, x, k = np.arange(len(d)), np.zeros(len(d)), 0
    stopped_x, stopped_k = np.zeros(len(d)), np.zeros(len(d), np.int64)
    kk = np.zeros(len(d), np.int64)
    while True:
        while len(alive):
            s = _mix(seed[alive] + kk[alive].astype(_U) * _U(0xD1342543DE82EF95))
            gap = -np.log(((s >> _U(11)).astype(np.float64) + 1.0) / float(1 << 53)) / size[alive]
            x[alive] += gap
            ok = x[alive] <= limit[d[alive]]
            late = alive[~ok]
            stopped_x[late], stopped_k[late] = x[late] - gap[~ok], kk[late]
            alive, s = alive[ok], s[ok]
            kk[alive] += 1
            s2 = _mix(s + _U(0xA0761D6478BD642F))
            component = ((s2 >> _U(32)) % _U(m)).astype(np.int64)
            mark = (s2 & _U(0xFFFFFFFF)).astype(np.float64) / float(1 << 32)
            seen = start[alive] + mark * size[alive] < w[alive]
            hit = alive[seen]
            np.minimum.at(flat, d[hit] * m + component[seen], x[hit])
        short = np.isinf(sig).any(axis=1) & (total > 0)
        if not short.any():
            return sig
        limit[short] *= 2
        alive = np.flatnonzero(short[d])
        x[alive], kk[alive] = stopped_x[alive], stopped_k[alive]


def _bands(sig: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(1), bits.shape[:2])
    for r in range(ROWS):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return out.view(np.int64)


def _chunks(texts: list[str | None]):
    """Slices of about _CHUNK_CHARS characters, whole texts."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= _CHUNK_CHARS:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_SIGNED = T.StructType([T.StructField("features", LONG), T.StructField("digest_a", LONG), T.StructField("digest_b", LONG), T.StructField("bands", T.ArrayType(LONG))])


@F.pandas_udf(_SIGNED)
def _signed(texts: pd.Series) -> pd.DataFrame:
    texts = [t if isinstance(t, str) else None for t in texts]
    parts = []
    for lo, hi in _chunks(texts):
        doc, item, count = multisets(texts[lo:hi])
        n = hi - lo
        total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        digest = []
        for salt in (_U(0x51), _U(0xA7)):
            each, sums = _mix((item << _U(8)) ^ (count.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ salt), np.zeros(n, _U)
            np.add.at(sums, doc, each)
            digest.append(sums.view(np.int64))
        bands = _bands(signatures(doc, item, count, n, BANDS * ROWS)) if len(doc) else np.zeros((n, BANDS), np.int64)
        parts.append(pd.DataFrame({"features": total, "digest_a": digest[0], "digest_b": digest[1], "bands": [b if t else [] for b, t in zip(bands.tolist(), total, strict=True)]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"features": [], "digest_a": [], "digest_b": [], "bands": []})


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    _, item, count = multisets([text or ""])
    return item, count


def _bag_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ia, ca), (ib, cb) = a, b
    if not len(ia) or not len(ib):
        return 0.0
    at = np.minimum(np.searchsorted(ib, ia), len(ib) - 1)
    both = np.where(ib[at] == ia, np.minimum(ca, cb[at]), 0).sum()
    return float(both / (ca.sum() + cb.sum() - both))


def overlap(a: str | None, b: str | None) -> float:
    """Multiset Jaccard similarity of the shingles; 0 without shingles."""
    return _bag_overlap(_bag(a), _bag(b))


@F.pandas_udf(T.DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Rows come in order of ``a``, so its multiset is kept from row to row."""
    out, text, bag = [], None, None
    for x, y in zip(a, b, strict=True):
        if bag is None or x != text:
            text, bag = x, _bag(x)
        out.append(_bag_overlap(bag, _bag(y)))
    return pd.Series(out, dtype="float64")


def _with_keys(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (a row for each value of ``on``, with ``n``, the rows it has). Hot values, at most _HOT by their share, are joined by broadcast."""
    hot, rest = keyed.where(F.col("n") * _HOT > total), keyed.where(F.col("n") * _HOT <= total)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold.join(rest, on))


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the pairs (a, b), those that reach the threshold), written. The texts of documents that are in no pair are not shuffled when the ids fit a measured broadcast."""
    pairs = materialise(pairs, "near-pairs")
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids")
    wanted = texts.join(broadcast_below(ids, ids.count(), _BROADCAST_ROWS), "id", "left_semi")
    right = wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").sortWithinPartitions("a")
    found = materialise(both.where(_overlap("text_a", "text_b") >= threshold).select("a", "b").distinct(), "near-verified", _BATCH)
    discard(ids)
    return pairs, found


def _least(members: DataFrame, hubs: int) -> DataFrame:
    """key, x, lx: the ``hubs`` least documents of each band; first those of each salt, so that no task ranks a whole band."""
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("key", salt).orderBy("id"))).where(F.col("_r") <= hubs)
    own = first.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_r") <= hubs)
    return own.select("key", F.col("id").alias("x"), F.col("label").alias("lx"))


def duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, group_id) of the ids in a group of several, and (id, rows) of every id; null ids are in neither."""
    texts = pick(docs, id=id_col, text=text_col).where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "text")
    signed = materialise(texts.select("id", _signed("text").alias("s")).select("id", "s.*"), "near-signatures", _BATCH)
    counts = materialise(signed.groupBy("id").agg(F.count(F.lit(1)).alias("rows")), "near-ids")
    rows, total = signed.where(F.col("features") > 0), signed.count()
    same_text = ["features", "digest_a", "digest_b"]
    reps = materialise(rows.groupBy(*same_text).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-identical")
    several = reps.where("n > 1")
    same = materialise(_with_keys(rows.select("id", *same_text), several, same_text, total).where("rep < id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "near-same")

    # of a group only the row of the least id has its bands looked at; rows of others are no key of the join
    lone = rows.join(several.select(*same_text, "rep").hint("shuffle_hash"), [*(rows[c].eqNullSafe(several[c]) for c in same_text), rows["id"] == several["rep"]], "left_semi")
    first = rows.join(same.select(F.col("b").alias("id")).distinct(), "id", "left_anti").unionByName(lone).select("id", "bands")
    keyed = materialise(first.select("id", F.explode("bands").alias("key")).distinct(), "near-keys")
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), F.col("id")))
    bands = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n"), mark("a").alias("xa"), mark("b").alias("xb")).where("n > 1")
    # bands with the same documents (by two 64-bit sums) are one
    bands = materialise(bands.groupBy("hub", "n", "xa", "xb").agg(F.min("key").alias("key")).select("key", "hub", "n"), "near-bands")
    members = materialise(_with_keys(keyed, bands, ["key"], keyed.count()).select("key", "hub", "id"), "near-members")
    for done in (reps, keyed):
        discard(done)

    hubs = members.groupBy("id").agg(F.min("hub").alias("hub")).where("hub < id")
    tested, found = _verify(hubs.select(F.col("hub").alias("a"), F.col("id").alias("b")), texts, threshold)
    edges = same.union(found)
    labels = components(edges)

    left, size = members.select("key", "id"), _HUBS[0]
    while True:
        known = materialise(left.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "near-labelled")
        mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
        mixed = materialise(mixed, "near-mixed")
        if mixed.isEmpty():
            break
        n = known.count()
        open_ = _with_keys(known, mixed, ["key"], n).select("key", "id", "label")
        x = materialise(_least(open_, size), "near-hubs")
        tops = x.groupBy("key").agg(F.max("x").alias("top"), F.collect_list(F.struct("x", "lx")).alias("xs"))  # at most _HUBS of each band
        met = _with_keys(open_, mixed.join(tops, "key"), ["key"], n)
        met = met.select("key", "id", "label", F.explode("xs").alias("h")).where((F.col("h.x") < F.col("id")) & (F.col("h.lx") != F.col("label")))
        new = met.select(F.col("h.x").alias("a"), F.col("id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        new, found = _verify(new, texts, threshold)
        tested, edges = tested.union(new), edges.union(found)
        labels = components(edges)
        left = materialise(_with_keys(open_, mixed.join(tops.select("key", "top"), "key"), ["key"], n).where(F.col("id") > F.col("top")).select("key", "id"), "near-left")
        for done in (known, mixed, x):
            discard(done)
        size = _HUBS[1]
    return labels.select(F.col("id").alias("doc_id"), F.col("label").alias("group_id")), counts


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id, group_size, keep: a row for each distinct doc_id, and one for each row without one."""
    groups, counts = duplicate_groups(docs, threshold, id_col, text_col)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    known = counts.select(F.col("id").alias("doc_id")).join(groups.join(sizes, "group_id"), "doc_id", "left")
    group = F.coalesce("group_id", "doc_id")
    out = known.select("doc_id", group.alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == group).alias("keep"))
    none = pick(docs, doc_id=id_col).where(F.col("doc_id").isNull())
    return out.unionByName(none.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep")))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group and all columns."""
    groups, counts = duplicate_groups(docs, threshold, id_col, text_col)
    own = F.col(f"`{id_col}`").cast("long")
    key, a, b = (free_name(docs, n) for n in ("group_key", "first_text", "first_row"))
    gone = materialise(groups.where("group_id < doc_id").select(F.col("doc_id").alias(key)), "near-gone")
    kept = docs.join(broadcast_below(gone, gone.count(), _BROADCAST_ROWS), own == F.col(key), "left_anti")
    again = counts.where("rows > 1")
    if again.isEmpty():
        return kept
    # one row of a repeated id: the least (hash of the text, hash of the row); what still ties is the same row
    marked = kept.withColumns({a: F.xxhash64(F.col(f"`{text_col}`")), b: F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))})
    best = marked.where(own.isNotNull()).groupBy(own.alias(key)).agg(F.min(F.struct(F.col(a), F.col(b))).alias("m")).select(key, F.col(f"m.{a}").alias(f"{a}_least"), F.col(f"m.{b}").alias(f"{b}_least"))
    best = materialise(best.join(again.select(F.col("id").alias(key)), key, "left_semi"), "near-first")
    n = best.count()
    single = kept.join(broadcast_below(best.select(key), n, _BROADCAST_ROWS), own == F.col(key), "left_anti")
    chosen = marked.join(broadcast_below(best, n, _BROADCAST_ROWS), (own == F.col(key)) & (F.col(a) == F.col(f"{a}_least")) & (F.col(b) == F.col(f"{b}_least")), "left_semi")
    return single.unionByName(chosen.drop(a, b).dropDuplicates([id_col]))


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
SQL: dict[str, str] = {}
