"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

A bin is a training sequence of ``capacity`` tokens. A set of documents that fits in one bin dominates another when the other's
documents can be grouped so that each group is no longer than a document of the first: some optimal packing then uses the
first. For the longest document j left, the reduction looks at what fits beside it: nothing (j is alone); one document
that fills the bin exactly, or when no two others fit, the longest that fits; when two others fit but not three, the longest
single document if it is as long as any two that fit, or the best pair if that pair dominates every other. What is
fixed leaves the instance, and passes repeat until nothing is. Best-fit decreasing packs the remainder. All this
works on counts of lengths, so many documents of one length cost no more than one.

Lengths are byte-pair tokens of the whole text (``vocabulary``: a rank file; None counts runs of non-blanks), so a bin fits a context of
``capacity`` tokens, and ``start`` is the piece's first token. Documents are spread over shards of about ``shard_tokens`` tokens by a hash of their id, text and copy; bins don't cross shards, so a shard is
one task of fixed size and more data gives more shards, also when one row is repeated without end. Documents beyond the capacity are cut: full pieces are bins of
their own and the rest is packed as an item.

Defined cases: null and empty texts have no tokens and one row with a null bin; documents of equal length are taken by ``doc_id``
(nulls first) and text; repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import INT, LONG, pick, schema, word_count
from ravelin.llm.token_counts import VOCABULARY, token_count_column
from ravelin.plans.lineage import materialise

CAPACITY, SHARD_TOKENS = 2048, 4_000_000
_COPIES, _BATCH = 1000, 1000


class _Lengths:
    """A multiset of lengths, by distinct length in ascending order."""

    def __init__(self, lengths):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.keys = sorted(self.count)

    def take(self, x: int, n: int = 1) -> None:
        self.count[x] -= n
        if not self.count[x]:
            del self.count[x]
            del self.keys[bisect_left(self.keys, x)]

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for x in self.keys:
            out += [x] * min(self.count[x], n - len(out))
            if len(out) == n:
                break
        return out

    def largest_upto(self, limit: int) -> int | None:
        i = bisect_right(self.keys, limit)
        return self.keys[i - 1] if i else None

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two with the largest sum within ``room``; of equal sums the one with the longest."""
        best, lo, hi = None, 0, bisect_right(self.keys, room) - 1
        while lo <= hi:
            a, b = self.keys[lo], self.keys[hi]
            if a + b > room:
                hi -= 1
                continue
            if (lo < hi or self.count[a] > 1) and (best is None or a + b > sum(best)):
                best = (b, a)
            lo += 1
        return best

    def longest_second(self, room: int) -> int:
        """The longest s for which some r >= s has r + s within ``room``."""
        s = self.largest_upto(room // 2)
        if s is None:
            return 0
        if self.count[s] > 1:
            return s
        i = bisect_left(self.keys, s)
        if i + 1 < len(self.keys) and self.keys[i + 1] + s <= room:
            return s
        return self.keys[i - 1] if i else 0


def dominating_set(left: _Lengths, j: int, capacity: int) -> list[int] | None:
    """The others of a provably dominating set with j, which is already taken out of ``left``; None when there's no proof."""
    room = capacity - j
    few = left.smallest(3)
    if not few or few[0] > room:
        return []
    one = left.largest_upto(room)
    if one == room or len(few) < 2 or few[0] + few[1] > room:
        return [one]
    if len(few) == 3 and sum(few) <= room:
        return None
    a, b = left.best_pair(room)
    if one >= a + b:
        return [one]
    if one == a and left.longest_second(room) <= b:
        return [a, b]
    return None


def reduce_instance(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """(bins fixed by dominance, lengths that remain in descending order)."""
    left, fixed, changed = _Lengths(lengths), [], True
    while changed:
        changed = False
        for j in reversed(list(left.keys)):
            while left.count.get(j):
                left.take(j)
                others = dominating_set(left, j, capacity)
                if others is None:
                    left.count[j] = left.count.get(j, 0) + 1
                    if left.count[j] == 1:
                        left.keys.insert(bisect_left(left.keys, j), j)
                    break
                for x in others:
                    left.take(x)
                fixed.append([j, *others])
                changed = True
    return fixed, [x for x in reversed(left.keys) for _ in range(left.count[x])]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each length, longest first, into the open bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for x in lengths:
        i = bisect_left(rooms, x)
        if i == len(rooms):
            bins.append([x])
            b, room = len(bins) - 1, capacity - x
        else:
            old = rooms[i]
            b = by_room[old].pop()
            if not by_room[old]:
                del by_room[old]
                del rooms[i]
            bins[b].append(x)
            room = old - x
        if room > 0:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append(b)
    return bins


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    fixed, rest = reduce_instance(lengths, capacity)
    return fixed + best_fit(rest, capacity)


def _pack_shard(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id", "tie"], ascending=[False, True, True], na_position="first", kind="stable")
        ids, n = pdf["doc_id"].tolist(), pdf["n"].to_numpy(np.int64)
        rows: list[tuple] = []  # doc_id, piece, start, length, bin
        waiting: dict[int, list[tuple]] = {}
        bins = 0
        for d, size in zip(ids, n.tolist(), strict=True):
            if size == 0:
                rows.append((d, 0, 0, 0, None))
                continue
            full, rest = divmod(size, capacity)
            for p in range(full):
                rows.append((d, p, p * capacity, capacity, bins))
                bins += 1
            if rest:
                waiting.setdefault(rest, []).append((d, full, full * capacity))
        for x in waiting.values():
            x.reverse()
        for content in pack_lengths([x for x, w in waiting.items() for _ in w], capacity):
            for x in content:
                rows.append((*waiting[x].pop(), x, bins))
            bins += 1
        d, piece, start, length, b = (list(c) for c in zip(*rows, strict=True))
        return pd.DataFrame({"shard": np.full(len(rows), pdf["shard"].iloc[0], np.int64), "bin": pd.array(b, dtype="Int64"), "doc_id": pd.array([None if pd.isna(x) else int(x) for x in d], dtype="Int64"), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "n_tokens": np.array(length, np.int64)})

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """shard, bin (numbered in its shard), doc_id, piece, start, n_tokens: a row for each piece of each document."""
    own = pick(docs, doc_id=id_col, text=text_col)
    n = token_count_column(docs.sparkSession, F.col("text"), vocabulary) if vocabulary else word_count(F.col("text"))
    own = materialise(own.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.xxhash64("text").alias("tie")), "pack-lengths", _BATCH)
    total = own.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    # copies of a row are numbered in blocks, so that a row which is a third of the table is spread before it is written out
    same = own.groupBy("doc_id", "n", "tie").agg(F.count(F.lit(1)).alias("k"))
    blocks = same.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / _COPIES))))
    blocks = blocks.repartition("doc_id", "tie", "b")
    last = F.least(F.col("k"), (F.col("b") + 1) * _COPIES) - 1
    each = blocks.select("doc_id", "n", "tie", F.explode(F.sequence(F.col("b") * _COPIES, last)).alias("copy"))
    placed = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "copy"), F.lit(shards))).drop("copy")
    return placed.groupBy("shard").applyInPandas(_pack_shard(capacity), schema(shard=LONG, bin=LONG, doc_id=LONG, piece=INT, start=LONG, n_tokens=LONG))


def op3_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
