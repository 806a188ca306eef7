"""Quality rules: a decision list learned by sequential covering, emitted as an ordered Spark conditional expression.

Each document has a handful of statistics, all built-in Spark expressions over its whole text. From labelled documents (at most
``max_fit_rows`` of them, a documented bound, by a hash of the id) rules are learned one after another: a rule is grown as a
conjunction of at most ``max_conditions`` thresholds (4), each the one with the best gain on the growing part, out of all that part two values; it is then pruned from its end to the
length that does best on the part held back for pruning; it stays if it covers enough bad documents there with enough
precision; what it covers is taken out and the next rule is learned, ``max_rules`` (24) at most. Limits on rules and conditions are those of the fitted list; they
don't depend on the data's size, and the rest is what no rule rejects. The list is emitted as CASE WHEN ... in that
order, so it runs in the scan's own stage: no shuffle and no Python.

Defined cases: null texts count as empty, and an empty text has the statistics 0, or 1 for the distinct shares; such rows go
through the rules like any other; labels with nulls are no evidence, and a document labelled both ways counts as bad;
without bad or without good labels there are no rules and all is kept; examples that tie are taken by id, of thresholds with equal gain the first statistic and the lowest threshold wins; repeated
rows give repeated rows; a null ``doc_id`` is carried along; an empty table gives an empty result; extra columns are kept
by ``keep_passing`` and ignored by ``rule_decisions``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import bounded_sample, hash_fraction, pick
from ravelin.plans.lineage import materialise

MAX_FIT_ROWS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 12_000, 24, 4, 0.97, 3


def statistics(text: Column) -> dict[str, Column]:
    """The named statistics of a text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.split(F.trim(t), r"\s+")
    n_words = F.when(F.trim(t) == "", 0).otherwise(F.size(words))

    def share(count: Column, of: Column, empty: float = 0.0) -> Column:
        return F.when(of > 0, count / of).otherwise(F.lit(empty))

    def removed(pattern: str) -> Column:
        return chars - F.length(F.regexp_replace(t, pattern, ""))

    return {
        "n_words": n_words.cast("double"),
        "mean_word": share(chars, n_words),
        "upper_share": share(removed(r"[A-ZÀ-ÖØ-Þ]+"), chars),
        "symbol_share": share(removed(r"[^\p{L}\p{N}\s.,;:'\"()?-]+"), chars),
        "digit_share": share(removed(r"[0-9]+"), chars),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words, 1.0),
        "stops_per_word": share(removed(r"[.,;:!?]+"), n_words),
        "distinct_lines": share(F.size(F.array_distinct(F.split(t, "\n"))), F.size(F.split(t, "\n")), 1.0),
    }


STATISTICS = ["n_words", "mean_word", "upper_share", "symbol_share", "digit_share", "distinct_words", "stops_per_word", "distinct_lines"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.statistic]
        return v >= self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold with the largest gain in information on the bad among the rows inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best, found = 1e-9, None
    base = np.log2(p0 / (p0 + n0))
    for name, values in x.items():
        v, b = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        edge = np.flatnonzero(v[1:] != v[:-1])
        if not len(edge):
            continue
        p_low, n_low = np.cumsum(b)[edge], np.cumsum(~b)[edge]
        middle = (v[edge] + v[edge + 1]) / 2
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float(f"{middle[k]:.6g}"))
    return found


def grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int = MAX_CONDITIONS) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (bad & inside).any() and (~bad & inside).any():
        c = _best_condition(x, bad, inside)
        if c is None:
            break
        rule += (c,)
        inside &= c.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on the pruning part; of equals the longest."""
    best, kept = -2.0, rule
    for k in range(len(rule), 0, -1):
        at = covered(rule[:k], x)
        p, n = int((bad & at).sum()), int((~bad & at).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, rule[:k]
    return kept


def simplify(rule: Rule) -> Rule:
    """The same rule with only the tightest threshold for each statistic and side."""
    tight: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = tight.get((c.statistic, c.above))
        if old is None or (c.threshold > old.threshold if c.above else c.threshold < old.threshold):
            tight[c.statistic, c.above] = c
    return tuple(tight.values())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION, min_covered: int = MIN_COVERED) -> list[Rule]:
    """The decision list for the bad class; ``pruning`` marks the rows that are held back from growing."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        g, p = left & ~pruning, left & pruning
        if not (bad & g).any() or not (~bad & g).any():
            break
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            break
        rule = prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        at = covered(rule, x)
        hit, wrong = int((bad & at & p).sum()), int((~bad & at & p).sum())
        if int((bad & at & left).sum()) < min_covered or hit < 1 or hit / (hit + wrong) < min_precision:
            break
        rules.append(simplify(rule))
        left &= ~at
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """1, 2, ... for the first rule that holds, null if none does, over columns named like the statistics."""
    if not rules:
        return F.lit(None).cast("int")
    cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {i}" for i, r in enumerate(rules, 1))
    return F.expr(f"CAST(CASE {cases} END AS INT)")


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list learned from the labelled among ``docs``."""
    own = pick(labels, id="doc_id", q="quality").where("id IS NOT NULL AND q IS NOT NULL").groupBy("id").agg(F.min("q").alias("q"))
    sample = bounded_sample(own, "id", None, max_fit_rows)
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id")  # at most max_fit_rows ids
    stats = texts.select("id", "q", *[c.alias(n) for n, c in statistics(F.col("text")).items()], (hash_fraction(F.lit("prune"), F.col("id")) < 1 / 3).alias("pruning"))
    got = materialise(stats, "rules-fit").toPandas().sort_values(["id", *STATISTICS], kind="stable")
    if not len(got):
        return []
    x = {n: got[n].to_numpy(np.float64) for n in STATISTICS}
    return learn(x, got["q"].to_numpy() == 0, got["pruning"].to_numpy(bool), min_precision=min_precision)


def rule_decisions(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, max_fit_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, rule (the number of the rule that rejects, or null), keep, a row for each document."""
    rules = fit(docs, labels, max_fit_rows, id_col, text_col) if rules is None else rules
    own = pick(docs, doc_id=id_col, text=text_col)
    stats = own.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return stats.withColumn("rule", rule_number(rules)).withColumn("keep", F.col("rule").isNull())


def keep_passing(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` without those that a rule rejects, all columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), *[c.alias(n) for n, c in statistics(F.col(f"`{text_col}`")).items()])
    return rows.where(rule_number(rules).isNull()).select("whole_row.*")


def op2_quality_rules(spark, sf_dir):
    return rule_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
