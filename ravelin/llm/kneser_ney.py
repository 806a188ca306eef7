"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted are the documents that ``labels`` marks quality 1; a hash of the id puts each in the fitting or in the held-out half. The model counts
every document of the fitting half. Trigram counts are hashed by their middle word into shards of about ``_SHARD_WORDS`` counted words (one holds all
that is around a word, so a frequent word makes a larger one). A shard is a row of packed keys and counts, from which continuation counts, back-off
weights and probabilities are worked out wherever they are needed; only what has an entry for each word of the vocabulary (at most ``2**21 - 3`` words) is gathered.

A document's log-probability is a plain sum over its n-grams. Each word adds ``b1(v) + p1(w)``, as if nothing longer were known; a known bigram
adds ``p2 - b1 - p1``, a known context ``b2``, a known trigram ``p3 - b2 - p2``. So scoring looks such corrections up, and sums them for each document:

* the ``head_ngrams`` most frequent n-grams, which would be the hot keys of a shuffle, are looked up in the worker from a broadcast of that size;
* a Bloom filter of a fixed ``2**_BLOOM_BITS`` bits drops bigrams that the model doesn't have. It holds bigrams only: a trigram is known only if both of its bigrams are, and trigrams would fill it up;
* where one of a word's n-grams is left, its trigram goes, packed with others, to the shard of its middle word, which has all three corrections; the answers are summed by document.
  This is done for up to ``_PARTS`` parts of the documents one after another, so that only a part's n-grams are on disk, in the shuffle and nowhere else. Each part
  shuffles the whole model too, so parts are few.

All terms are whole millionths, so the sums don't depend on their order. A word outside the vocabulary (seen less than twice) is the class <unk>, whose
probability is shared by its members. The per-document score is the perplexity with ``prior_words`` words of the trusted average mixed in, so that a few words are no verdict. A document is
rejected when its score passes the ``quantile`` of the scores of all held-out trusted documents of its language: the model has
memorised the ones it was fitted on, so those would set the limit too low for text it hasn't seen. A language with fewer than
``min_support`` held-out documents takes the limit of all languages together: its own extreme quantile would be its highest score.

Defined cases: null texts and texts without a word have a null perplexity and are rejected; a null or unseen language takes the
threshold of all held-out trusted documents together; labels that repeat or contradict count as trusted only if none says 0; labels
with nulls are no evidence; with no trusted text to fit or to hold out, thresholds are null and every document with words is
kept; a score equal to the threshold is kept; repeated rows give repeated rows; a null ``doc_id`` is carried along; an empty table gives an
empty result; extra columns are kept by ``keep_fluent`` and ignored by ``perplexities``.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import BOOL, INT, LONG, STRING, hash_fraction, pick, row_hashes, schema
from ravelin.plans.lineage import broadcast_below, discard, forget, materialise

QUANTILE, PRIOR_WORDS, MIN_SUPPORT, HEAD_NGRAMS, SHARDS = 0.999, 20, 100, 1 << 20, 32
#: Three word numbers of this many bits make an n-gram key; a bigram's key has 0 in place of the first.
_BITS = 21
_UNK, _BOS, _FIRST = 1, 2, 3
_MASK = (1 << _BITS) - 1
#: Log-probabilities are whole numbers of this many to one.
_UNIT = 1_000_000
_BLOOM_BITS = 26
_SLICE_ROWS, _SLICE_WORDS, _BROADCAST_ROWS = 500, 200_000, 1_000_000
#: Counted words of a shard; most parts of the documents that are scored one after another, and for how many documents there is a further one.
_SHARD_WORDS, _PARTS, _PARTS_FROM = 1_000_000, 3, 20_000
#: Rows of a batch that hold a shard each, or n-grams for one.
_SHARD_ROWS, _ASKED_ROWS = 2, 16
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
_U = np.uint64


@contextmanager
def _setting(spark, values: dict[str, str]):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """``materialise`` in less space; the shuffle files that it took are deleted at once."""
    with _setting(df.sparkSession, _WRITING):
        return materialise(df, tag, batch_rows)


def _packed(x: np.ndarray) -> bytes:
    """The differences of whole numbers, with the sign as last bit, byte plane by byte plane, which is what compresses."""
    d = np.diff(x, prepend=x.dtype.type(0))
    d = (d << 1) ^ (d >> (8 * x.itemsize - 1))
    return d.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    d = np.ascontiguousarray(planes.T).view(np.dtype(kind).str.replace("i", "u"))[:, 0]
    return np.cumsum((d >> 1).view(kind) ^ -(d & 1).view(kind), dtype=kind)


def _swapped(keys: np.ndarray) -> np.ndarray:
    """Trigram keys with the first two words exchanged: in order, they go by the middle word, as shards need them."""
    return ((keys >> _BITS & _MASK) << 2 * _BITS) | (keys >> 2 * _BITS << _BITS) | (keys & _MASK)


def _pair_swapped(keys: np.ndarray) -> np.ndarray:
    return ((keys & _MASK) << _BITS) | (keys >> _BITS)


def _shard_of(middle, shards: int):
    """The shard of a middle word, the same of a column and of an array."""
    x = middle * 0x9E3779B1
    return F.pmod(F.shiftright(x, 16), F.lit(shards)).cast("int") if isinstance(middle, Column) else (x >> 16) % shards


def _count_words(batches):
    seen: Counter = Counter()
    for pdf in batches:
        for t in pdf["text"]:
            if t:
                seen.update(t.split())
    yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})


def _hash_words(batches):
    """The words' hashes, which is all that the driver needs of them."""
    for pdf in batches:
        yield pd.DataFrame({"h": _hashes(pdf["word"].tolist()).view(np.int64)})


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True) if words else np.zeros(0, _U)


def _mix(keys: np.ndarray, odd: int) -> np.ndarray:
    """A 64-bit mixing of n-gram keys."""
    x = keys.astype(_U) * _U(odd)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def word_numbers(vocabulary: np.ndarray, words: list[str]) -> np.ndarray:
    """Numbers of the words; ``vocabulary``: sorted hashes of the words that have one."""
    h = _hashes(words)
    if not len(vocabulary):
        return np.full(len(h), _UNK, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + _FIRST, _UNK).astype(np.int64)


def _numbered(texts, vocabulary):
    """Parts of whole texts: (row of each text, words of each text, all word numbers)."""
    rows, lengths, words = [], [], []
    for i, t in enumerate(texts):
        own = t.split() if isinstance(t, str) else []
        if own:
            rows.append(i)
            lengths.append(len(own))
            words += own
        if len(words) >= _SLICE_WORDS:
            yield np.array(rows), np.array(lengths), word_numbers(vocabulary, words)
            rows, lengths, words = [], [], []
    if rows:
        yield np.array(rows), np.array(lengths), word_numbers(vocabulary, words)


def _contexts(lengths, w):
    """The one and two word numbers before each word; the begin sign before a text."""
    begin = np.zeros(len(w), bool)
    begin[np.cumsum(lengths) - lengths] = True
    v = np.r_[_BOS, w[:-1]]
    v[begin] = _BOS
    u = np.r_[_BOS, v[:-1]]
    u[begin] = _BOS
    return u, v


def _counter(vocabulary):
    def count(batches):
        for pdf in batches:
            for _, lengths, w in _numbered(pdf["text"], vocabulary.value):
                u, v = _contexts(lengths, w)
                keys, n = np.unique((u << 2 * _BITS) | (v << _BITS) | w, return_counts=True)
                yield pd.DataFrame({"key": keys, "n": n})

    return count


def _lots(batches, rows: int):
    """The same rows in batches of at least so many, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class _Lookup:
    """key -> two numbers, for as many keys as are broadcast: sorted by a hash, with the first place of each hash prefix."""

    def __init__(self, keys: np.ndarray, delta: np.ndarray, context: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        h = _mix(keys, 0x9E3779B97F4A7C15) >> _U(64 - self.bits)
        order = np.argsort(h, kind="stable")
        self.keys, self.delta, self.context = keys[order], delta[order].astype(np.int32), context[order].astype(np.int32)
        self.first = np.searchsorted(h[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        h = (_mix(keys, 0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.first[h], self.first[h + 1]
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            open_, at, end = open_[more], at[more], end[more]
        return out


def _bloom_place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the 64-bit block, the bits of the key in it)"""
    h = _mix(keys, 0xD1342543DE82EF95)
    bits = (_U(1) << (h & _U(63))) | (_U(1) << ((h >> _U(6)) & _U(63))) | (_U(1) << ((h >> _U(12)) & _U(63)))
    return (h >> _U(64 - _BLOOM_BITS + 6)).astype(np.int64), bits


def _bloom_part(batches):
    """The filter of a partition's keys, as one row."""
    own = np.zeros(1 << (_BLOOM_BITS - 6), _U)
    for pdf in batches:
        np.bitwise_or.at(own, *_bloom_place(pdf["key"].to_numpy(np.int64)))
    yield pd.DataFrame({"bits": [own.tobytes()]})


class Shared:
    """What every worker has of the model: of one size for any corpus."""

    def __init__(self, vocabulary: np.ndarray, p1: np.ndarray, b1: np.ndarray, unknown: int, start: int, head: _Lookup, bloom: np.ndarray):
        self.vocabulary, self.p1, self.b1, self.unknown, self.start, self.head, self.bloom = vocabulary, p1, b1, unknown, start, head, bloom

    def score(self, lengths: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: the known part of each sum, and (number of the text, trigram) of each word that the shards have to be asked about."""
        u, v = _contexts(lengths, w)
        ends = np.cumsum(lengths)
        each = self.b1[v].astype(np.int64) + self.p1[w]
        each[w == _UNK] += self.unknown
        pair = (v << _BITS) | w
        trigram = (u << 2 * _BITS) | pair
        followed = np.ones(len(w), bool)
        followed[ends - 1] = False
        asked = np.zeros(len(w), bool)
        at = self.head.find(pair)
        hit = np.flatnonzero(at >= 0)
        each[hit] += self.head.delta[at[hit]] + np.where(followed[hit], self.head.context[at[hit]], 0)
        left = np.flatnonzero(at < 0)
        block, bits = _bloom_place(pair[left])
        left = left[(self.bloom[block] & bits) == bits]
        asked[left] = True
        asked[left[followed[left]] + 1] = True  # there it is the context
        known = at >= 0
        known[left] = True
        context = np.r_[True, known[:-1]]
        context[ends - lengths] = True
        at = self.head.find(trigram)
        hit = np.flatnonzero(at >= 0)
        each[hit] += self.head.delta[at[hit]]
        asked |= (at < 0) & known & context
        doc = np.repeat(np.arange(len(lengths)), lengths)
        return np.add.reduceat(each, ends - lengths) + self.start, doc[asked], trigram[asked]


class _Block:
    """A shard: trigrams (first two words exchanged, in order) with n, contexts from ``first`` on, bigrams with n2 (different words before) and raw (n), middle words from ``words`` on."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n.astype(np.int64)
        self.first = _runs(key >> _BITS)
        self.pair, self.of_pair, kinds = np.unique((key >> 2 * _BITS << _BITS) | (key & _MASK), return_inverse=True, return_counts=True)
        self.raw = np.bincount(self.of_pair, weights=self.n).astype(np.int64)
        self.n2 = np.where(self.pair >> _BITS == _BOS, self.raw, kinds)
        self.words = _runs(self.pair >> _BITS)

    @classmethod
    def read(cls, key: bytes, n: bytes) -> _Block:
        return cls(_unpacked(key, np.int64), _unpacked(n, np.int32))

    @property
    def contexts(self) -> np.ndarray:
        """Of each context: middle word, then the one before."""
        return self.key[self.first] >> _BITS

    def corrections(self, p1: np.ndarray, q1: np.ndarray, d2: list[float], d3: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(of trigrams, of bigrams, of contexts, log-probability of each trigram)"""
        size = np.diff(np.r_[self.words, len(self.pair)])
        t2, bow = _back_off(_spread(self.n2, self.words), d2)
        p2 = (self.n2 - _held(self.n2, d2)) / np.repeat(t2, size) + np.repeat(bow, size) * p1[self.pair & _MASK]
        own = np.diff(np.r_[self.first, len(self.key)])
        t3, bow2 = _back_off(_spread(self.n, self.first), d3)
        p3 = (self.n - _held(self.n, d3)) / np.repeat(t3, own) + np.repeat(bow2, own) * p2[self.of_pair]
        q2, q3, b2 = _whole(p2), _whole(p3), _whole(bow2)
        return q3 - np.repeat(b2, own) - q2[self.of_pair], q2 - q1[self.pair & _MASK] - np.repeat(_whole(bow), size), b2, q3


class _Tail:
    """What a shard adds to the sums: its corrections without those of the head, which the workers have."""

    def __init__(self, block: _Block, shared: Shared, rule: tuple, least: int):
        self.key, self.pair, self.contexts = block.key, block.pair, block.contexts
        self.d3, self.d2, self.b2, _ = block.corrections(rule[0], shared.p1, *rule[1:])
        self.d3[block.n >= least], self.d2[block.raw >= least] = 0, 0
        self.b2[(shared.head.find(_pair_swapped(self.contexts)) >= 0) | (self.contexts == (_BOS << _BITS | _BOS))] = 0

    def sums(self, keys: np.ndarray) -> np.ndarray:
        """Of trigrams (first two words exchanged)."""
        out = np.zeros(len(keys), np.int64)
        for known, values, asked in ((self.key, self.d3, keys), (self.pair, self.d2, (keys >> 2 * _BITS << _BITS) | (keys & _MASK)), (self.contexts, self.b2, keys >> _BITS)):
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            out += np.where(known[at] == asked, values[at], 0)
        return out


class Model:
    """``shared`` for every worker, ``shards`` (s, key, n), ``rule`` (p1, d2, d3) and ``least``, the least count of the head, for what they add; ``mean_log`` of the counted words (natural)."""

    def __init__(self, shared: Shared, shards: DataFrame, count: int, rule: tuple, least: int, mean_log: float):
        self.shared, self.shards, self.count, self.rule, self.least, self.mean_log, self._written = shared, shards, count, rule, least, mean_log, [shards]

    def discard(self) -> None:
        """Deletes what scoring wrote on the way; to be called when the scores are written elsewhere."""
        for df in self._written:
            discard(df)
        self._written = []

    def sums(self, texts: DataFrame) -> DataFrame:
        """``texts`` (text and what is carried along) with n_words and log_p (in millionths) in place of the text, written."""
        spark, shards, least = texts.sparkSession, self.count, self.least
        shared, rule = spark.sparkContext.broadcast(self.shared), spark.sparkContext.broadcast(self.rule)
        carried = [c for c in texts.columns if c != "text"]
        own = texts.select(F.monotonically_increasing_id().alias("_row"), *carried, "text")
        counted = T.StructType([*own.schema.fields[:-1], T.StructField("n_words", LONG), T.StructField("log_p", LONG)])
        counted = T.StructType([T.StructField(f.name, f.dataType, True) for f in counted])
        kind = T.StructType([*counted.fields, *schema(_s=INT, _asked=BOOL, _x=T.BinaryType(), _y=T.BinaryType()).fields])

        def run(batches):
            """A row for each text, and for each slice and shard one with the trigrams to ask about (row numbers and keys, in order of the keys)."""
            m = shared.value
            for part in _lots(batches, _SLICE_ROWS):
                texts, number = part.column(part.num_columns - 1).to_pylist(), part.column(0).to_numpy()
                n, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                asked = []
                for rows, lengths, w in _numbered(texts, m.vocabulary):
                    n[rows] = lengths
                    known[rows], doc, key = m.score(lengths, w)
                    key = _swapped(key)
                    s = _shard_of(key >> 2 * _BITS, shards)
                    order = np.lexsort((key, s))
                    s, key, row = s[order], key[order], number[rows[doc[order]]]
                    for a, b in zip(first := _runs(s), np.r_[first[1:], len(s)], strict=True) if len(s) else ():
                        asked.append((int(s[a]), _packed(row[a:b]), _packed(key[a:b])))
                own, yes = [*part.columns[:-1], pa.array(n), pa.array(known)], pa.array(np.ones(max(len(texts), len(asked)), bool))
                none = [pa.nulls(len(texts), pa.binary())] * 2
                yield pa.RecordBatch.from_arrays([*own, pa.array((number % shards).astype(np.int32)), yes[: len(texts)], *none], names=kind.names)
                if asked:
                    s, rows, keys = zip(*asked, strict=True)
                    empty = [pa.nulls(len(s), c.type) for c in own]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(s, pa.int32()), yes[: len(s)], pa.array(rows, pa.binary()), pa.array(keys, pa.binary())], names=kind.names)

        def answer(batches):
            """Rows come by shard, the shard itself first; those of texts are passed on."""
            at, tail = None, None
            for batch in batches:
                is_text = batch.column("_x").is_null()
                own = batch.filter(is_text).columns[: len(counted)]
                yield pa.RecordBatch.from_arrays(own, names=counted.names)
                s, asked = batch.column("_s").to_numpy(), batch.column("_asked").to_pylist()
                for i in np.flatnonzero(~is_text.to_numpy(zero_copy_only=False)):
                    x, y = (batch.column(c)[i].as_buffer() for c in ("_x", "_y"))
                    if not asked[i]:
                        at, tail = s[i], _Tail(_Block.read(x, y), shared.value, rule.value, least)
                    elif s[i] == at:  # else no trigram has such a middle word
                        row, place = np.unique(_unpacked(x, np.int64), return_inverse=True)
                        d = np.zeros(len(row), np.int64)
                        np.add.at(d, place, tail.sums(_unpacked(y, np.int64)))
                        empty = [pa.nulls(len(row), c.type) for c in own[1:-1]]
                        yield pa.RecordBatch.from_arrays([pa.array(row), *empty, pa.array(d)], names=counted.names)

        parts = max(1, min(_PARTS, -(-texts.count() // _PARTS_FROM)))  # the driver keeps something of every job
        model = self.shards.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in counted], F.col("s").alias("_s"), F.lit(False).alias("_asked"), F.col("key").alias("_x"), F.col("n").alias("_y"))
        done = []
        for part in range(parts):
            found = own.where(F.pmod(F.xxhash64(F.lit("part"), *carried), F.lit(parts)) == part).mapInArrow(run, kind)
            met = model.union(found).repartition("_s").sortWithinPartitions("_s", "_asked").mapInArrow(answer, counted)
            sums = met.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in carried], F.max("n_words").alias("n_words"), F.sum("log_p").alias("log_p"))
            done.append(_written(sums.drop("_row"), "kn-known", _ASKED_ROWS))
            forget(spark)
        shared.destroy()
        rule.destroy()
        self._written += done
        return reduce(DataFrame.union, done)


def _discounts(counts: dict[int, int]) -> list[float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times, kept in (0, count]."""
    n = [max(counts.get(i, 0), 1) for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]


def _held(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(n, 3) - 1]


def _back_off(counts: list[np.ndarray], d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(total, weight of what is shorter) of contexts, from ``_spread``."""
    total, *m = counts
    return total, sum(x * y for x, y in zip(d, m, strict=True)) / total


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * _UNIT).astype(np.int64)


def _runs(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values of sorted ``groups`` begins."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])


def _spread(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each run: the sum of n, and how many are 1, 2, and more."""
    return [np.add.reduceat(x, first, dtype=np.int64) for x in (n, n == 1, n == 2, n > 2)]


_LONGS, _BYTES = T.ArrayType(LONG), T.BinaryType()
_SHARDS = schema(s=INT, key=_BYTES, n=_BYTES, w=_LONGS, n1=_LONGS, v=_LONGS, t2=_LONGS, m1=_LONGS, m2=_LONGS, m3=_LONGS, seen2=_LONGS, seen3=_LONGS)
_FACTS = schema(l=LONG, n=LONG, u=LONG, start=LONG, often=_LONGS, times=_LONGS)


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard as a row: its trigrams, how many bigrams end with each word (w, n1), the counts of its middle words (v, t2, m), and how many bigrams and trigrams are seen 1 to 4 times."""
    key, inverse = np.unique(_swapped(pdf["key"].to_numpy()), return_inverse=True)
    b = _Block(key, np.bincount(inverse, weights=pdf["n"].to_numpy()).astype(np.int32))
    w, n1 = np.unique(b.pair & _MASK, return_counts=True)
    t2, *m = _spread(b.n2, b.words)
    seen = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (b.n2, b.n)]
    values = [int(pdf["s"].iloc[0]), _packed(key), _packed(b.n.astype(np.int32)), w, n1, b.pair[b.words] >> _BITS, t2, *m, *seen]
    return pd.DataFrame({name: [x] for name, x in zip(_SHARDS.names, values, strict=True)})


def _blocks(batches):
    for pdf in batches:
        for key, n in zip(pdf["key"], pdf["n"], strict=True):
            yield _Block.read(key, n)


def estimate(counts: DataFrame, vocabulary: np.ndarray, rare: int, head_ngrams: int = HEAD_NGRAMS, shards: int = SHARDS, spent: tuple[DataFrame, ...] = ()) -> Model:
    """The model from trigram counts (key, n), which may repeat a key. ``rare``: how many different words are <unk>. ``spent``: written tables to delete when the counts are read.

    Lower orders count the different words before an n-gram; bigrams at the begin of a text keep their own counts. Trigrams are sharded by their middle word,
    so that their bigrams and contexts are whole in a shard: one shuffle.
    """
    spark, kinds = counts.sparkSession, len(vocabulary) + 1
    middle = F.shiftright("key", _BITS).bitwiseAND(F.lit(_MASK))
    own = _written(counts.withColumn("s", _shard_of(middle, shards)).groupBy("s").applyInPandas(_shard, _SHARDS), "kn-shards")
    for done in spent:
        discard(done)
    table = own.select("key", "n")

    size = len(vocabulary) + _FIRST
    words = own.select(F.explode(F.arrays_zip("w", "n1")).alias("x")).groupBy("x.w").agg(F.sum("x.n1").alias("n1")).toArrow()  # at most a row for each word number, as is the next
    n1 = np.zeros(size, np.int64)
    n1[words["w"].to_numpy()] = words["n1"].to_numpy()
    seen2, seen3 = (dict(enumerate(own.agg(*[F.sum(F.col(c)[i]) for i in range(4)]).first(), 1)) for c in ("seen2", "seen3"))
    d1, d2, d3 = _discounts(dict(enumerate(np.bincount(n1, minlength=5)[:5].tolist()))), _discounts(seen2), _discounts(seen3)
    held = np.where(n1 > 0, _held(np.maximum(n1, 1), d1), 0.0)
    p1 = np.maximum(n1 - held, 0) / n1.sum() + held.sum() / n1.sum() / kinds
    held_back = sum(F.lit(d) * F.col(m) for d, m in zip(d2, ("m1", "m2", "m3"), strict=True)) / F.col("t2")
    contexts = own.select(F.inline(F.arrays_zip("v", "t2", "m1", "m2", "m3"))).select("v", held_back.alias("bow")).toArrow()
    bow = np.ones(size)
    bow[contexts["v"].to_numpy()] = contexts["bow"].to_numpy()
    q1, b1 = (_whole(x).astype(np.int32) for x in (p1, bow))
    del words, contexts
    rule = spark.sparkContext.broadcast((p1, q1, d2, d3))

    def facts(batches):
        for b in _blocks(batches):
            _, _, b2, q3 = b.corrections(*rule.value)
            often, times = np.unique(np.concatenate([b.n[b.n > 1], b.raw[b.raw > 1]]), return_counts=True)
            start = b2[b.contexts == (_BOS << _BITS | _BOS)]
            yield pd.DataFrame({"l": [int((b.n * q3).sum())], "n": [int(b.n.sum())], "u": [int(b.n[b.key & _MASK == _UNK].sum())], "start": [int(start.sum())], "often": [often], "times": [times]})

    def frequent(batches):
        for b in _blocks(batches):
            delta3, delta2, _, _ = b.corrections(*rule.value)
            three, two = b.n >= least, b.raw >= least
            yield pd.DataFrame({"key": np.r_[_swapped(b.key[three]), b.pair[two]], "delta": np.r_[delta3[three], delta2[two]]})

    def frequent_contexts(batches):
        for b in _blocks(batches):
            key = _pair_swapped(b.contexts)
            there = pairs.value.find(key) >= 0
            yield pd.DataFrame({"key": key[there], "context": b.corrections(*rule.value)[2][there]})

    def tail_pairs(batches):
        """Contexts are among them: what comes before a word has been counted as a bigram itself."""
        for b in _blocks(batches):
            yield pd.DataFrame({"key": b.pair[b.raw < least]})

    def gathered(df: DataFrame) -> pa.Table:
        """Written first: batches of few shards in would mean as few rows in those that the driver gets."""
        there = _written(df, "kn-gathered", _SHARD_ROWS)
        try:
            return there.toArrow()
        finally:
            discard(there)

    known = _written(table.mapInPandas(facts, _FACTS), "kn-facts", _SHARD_ROWS)
    least, room = 1 << 62, head_ngrams
    for x in known.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("times")).orderBy(F.desc("often")).collect():  # a row for each different count
        if x.times > room:
            break
        least, room = x.often, room - x.times
    head = gathered(table.mapInPandas(frequent, schema(key=LONG, delta=LONG)))  # at most head_ngrams rows
    key, delta = (head[c].to_numpy() for c in ("key", "delta"))
    order = np.argsort(key)
    key, delta = key[order], delta[order]
    nothing = np.zeros(len(key), np.int32)
    pairs = spark.sparkContext.broadcast(_Lookup(key[key < 1 << 2 * _BITS], nothing[key < 1 << 2 * _BITS], nothing[key < 1 << 2 * _BITS]))
    also = gathered(table.mapInPandas(frequent_contexts, schema(key=LONG, context=LONG)))  # no more than the head's bigrams
    context = nothing.copy()
    context[np.searchsorted(key, also["key"].to_numpy())] = also["context"].to_numpy()
    bloom = np.zeros(1 << (_BLOOM_BITS - 6), _U)
    bits = _written(table.coalesce(4).mapInPandas(lambda batches: _bloom_part(tail_pairs(batches)), schema(bits=T.BinaryType())), "kn-bloom", _SHARD_ROWS)
    for part in bits.toLocalIterator():  # four of a fixed size, one by one
        bloom |= np.frombuffer(part.bits, _U)
    lookup = _Lookup(key, delta, context)
    del head, also
    pa.default_memory_pool().release_unused()

    unk_log = -float(np.log(max(rare, 1)))
    r = known.agg(F.sum("l").alias("l"), F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum("start").alias("start")).first()
    for done in (rule, pairs):
        done.destroy()
    for done in (known, bits):
        discard(done)
    return Model(Shared(vocabulary, q1, b1, round(unk_log * _UNIT), r.start, lookup, bloom), own, shards, (p1, d2, d3), least, (r.l / _UNIT + unk_log * r.u) / r.n)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels say are good and none says are bad."""
    own = pick(labels, id="doc_id", q="quality").where("id IS NOT NULL AND q IS NOT NULL")
    return own.groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")


def _half(trusted: DataFrame, held_out: bool) -> DataFrame:
    side = hash_fraction(F.lit("half"), F.col("id")) >= 0.5
    return trusted.where(side if held_out else ~side)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model of the trusted documents; None when there is no trusted text."""
    spark = docs.sparkSession
    texts = pick(docs, id=id_col, text=text_col)
    ids = _written(_half(trusted_ids(labels), held_out=False), "kn-ids")
    train = _written(texts.join(broadcast_below(ids, ids.count(), _BROADCAST_ROWS), "id", "left_semi").select("text"), "kn-train")
    words = _written(train.mapInPandas(_count_words, schema(word=STRING, n=LONG)).groupBy("word").agg(F.sum("n").alias("n")), "kn-words")
    kinds, often, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)), F.sum("n")).first()
    if not kinds:
        return None
    most = (1 << _BITS) - _FIRST
    common = words.where("n > 1").select("word") if often <= most else words.where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word")
    vocabulary = np.sort(common.mapInPandas(_hash_words, schema(h=LONG)).toArrow()["h"].to_numpy().view(_U))
    shared = spark.sparkContext.broadcast(vocabulary)
    model = estimate(train.mapInPandas(_counter(shared), schema(key=LONG, n=LONG)), vocabulary, kinds - len(vocabulary), shards=max(SHARDS, -(-total // _SHARD_WORDS)), spent=(ids, train, words))
    shared.destroy()
    forget(spark)
    return model


def _perplexity(model: Model, prior_words: int):
    return F.when(F.col("n_words") > 0, F.exp(-(F.col("log_p") / float(_UNIT) + prior_words * model.mean_log) / (F.col("n_words") + prior_words)))


def _thresholds(scores: DataFrame, quantile: float, min_support: int) -> DataFrame:
    """lang, threshold from (lang, perplexity) of the trusted documents; the language null stands for all together.

    By rank and not by ``percentile_approx``, whose answer depends on the order of the rows."""
    together = F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang"))
    own = scores.where("perplexity IS NOT NULL").select(F.inline(F.array(together, F.struct(F.lit(False).alias("all"), "lang"))), "perplexity").where("all OR lang IS NOT NULL")
    group = Window.partitionBy("all", "lang")
    ranked = own.withColumns({"n": F.count(F.lit(1)).over(group), "rank": F.row_number().over(group.orderBy("perplexity"))})
    is_it = F.col("rank") == F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(quantile))))
    return ranked.where(is_it & (F.col("all") | (F.col("n") >= min_support))).select("lang", F.col("perplexity").alias("threshold"))


def _threshold_of(lang, thresholds: list) -> Column:
    """As a conditional expression: there are as many thresholds as languages."""
    fallback = next((r.threshold for r in thresholds if r.lang is None), None)
    named = [x for r in thresholds if r.lang is not None for x in (F.lit(r.lang), F.lit(r.threshold))]
    rest = F.lit(fallback).cast("double")
    return F.coalesce(F.try_element_at(F.create_map(*named), lang), rest) if named else rest


def perplexities(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_words: int = PRIOR_WORDS, min_support: int = MIN_SUPPORT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep, a row for each document."""
    own = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(own, labels, "doc_id")
    if model is None:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        null = F.lit(None).cast("double")
        return own.select("doc_id", "lang", words.alias("n_words"), null.alias("perplexity"), null.alias("threshold"), (words > 0).alias("keep"))
    scored = model.sums(own.select("doc_id", "lang", "text"))
    scored = materialise(scored.select("doc_id", "lang", "n_words", _perplexity(model, prior_words).alias("perplexity")), "kn-scores")
    model.discard()
    trusted = scored.join(_half(trusted_ids(labels), held_out=True), F.col("doc_id") == F.col("id"), "left_semi")
    threshold = _threshold_of(F.col("lang"), _thresholds(trusted, quantile, min_support).collect())
    out = scored.withColumn("threshold", threshold)
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull()))


def keep_fluent(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_words: int = PRIOR_WORDS, min_support: int = MIN_SUPPORT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones, all columns; the model and the thresholds come from the trusted of ``all_docs``.

    The verdict on a row is found again by two 64-bit hashes of its id, text and language. Rejected hashes are broadcast when they are few, counted.
    """
    source = pick(all_docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(source, labels, "doc_id")
    if model is None:
        return docs.where(F.coalesce(F.col(f"`{text_col}`").rlike(r"\S"), F.lit(False)))
    ids = _written(_half(trusted_ids(labels), held_out=True), "kn-held")
    theirs = F.col("doc_id") == F.col("id")
    # ids beyond a broadcast are joined to scores and not to texts, which would all be shuffled
    few = ids.count() <= _BROADCAST_ROWS
    held = source.join(F.broadcast(ids), theirs, "left_semi") if few else source.where(hash_fraction(F.lit("half"), F.col("doc_id")) >= 0.5)
    held = model.sums(held.select("doc_id", "lang", "text"))
    held = held.select("doc_id", "lang", _perplexity(model, prior_words).alias("perplexity"))
    trusted = held if few else held.join(ids, theirs, "left_semi")
    limit = _threshold_of(F.col("lang"), _thresholds(trusted, quantile, min_support).collect())
    discard(ids)
    names, hashes = row_hashes(docs, id_col, text_col, lang_col)
    scored = model.sums(docs.select(*hashes, F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")))
    ppl = _perplexity(model, prior_words)
    bad = materialise(scored.where(~F.coalesce(ppl <= limit, ppl.isNotNull())).select(*names).distinct(), "kn-rejected")
    model.discard()
    return docs.select("*", *hashes).join(broadcast_below(bad, bad.count(), _BROADCAST_ROWS), names, "left_anti").drop(*names)


def op5_quality_classifier(spark, sf_dir):
    return perplexities(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
