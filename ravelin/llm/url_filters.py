"""URL filter rules by a sort-merge range join.

A URL becomes a canonical key with its host reversed (``https://M.Shop.example.com:443/a?b#c`` is ``com,example,shop,m,)/a?b``), so
that a domain with all its subdomains, a host and a path prefix are each one key prefix, that is one interval of keys.
Rules and URLs are split at the same key boundaries; a rule goes to each range that its interval meets. In a range both are
sorted together and swept once: intervals of prefixes are nested or apart, so a stack holds the rules that are open, and its
top is the most specific one. A hot host is split over ranges by its paths, so it is no hot task.

Boundaries come from a hash sample of about ``boundary_sample`` keys. They steer only where the work is done, never the result.

A host in brackets (an IPv6 address) is one label. Defined cases: a null URL, or one without ``scheme://host``, has a null key and the action ``invalid``; a URL that no rule holds has a
null rule and the default action; of rules with the same prefix the lowest ``rule_id`` wins; repeated pages give repeated
rows; a null ``page_id`` is carried along; without rules every valid URL has the default action; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import INT, LONG, STRING, hash_fraction, pick, schema

_PARTS = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)(?::[0-9]*)?([^#]*)"
DEFAULT_ACTION = "keep"
#: (rule_id, key prefix, action). A prefix that ends in ``,`` is a domain with its subdomains, in ``,)/`` one host, longer ones are paths.
RULES: list[tuple[int, str, str]] = [
    (1, "com,example,casino-win,", "block"),
    (2, "com,example,free-bets,", "block"),
    (3, "com,example,ads-track,", "block"),
    (4, "com,example,casino-win,m,)/en/1", "keep"),
    (5, "net,example,", "review"),
    (6, "net,example,tiontion,)/", "keep"),
    (7, "net,example,tiontion,)/en/", "review"),
    (8, "net,example,tiontion,)/en/7", "block"),
    (9, "com,example,tionsh,blog,)/", "review"),
    (10, "com,example,tionsh,blog,)/en/", "keep"),
    (11, "com,example,tionsh,blog,)/de/", "block"),
    (12, "org,example,", "keep"),
    (13, "org,example,tionble,)/fr/", "block"),
    (14, "net,example,", "block"),
]
_TOP = "\U0010ffff"


def url_key(url: Column) -> Column:
    """The canonical key, null when the URL has no ``scheme://host``."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _PARTS, 1)), r"\.+$", "")
    rest = F.regexp_extract(u, _PARTS, 2)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",)"), rest))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one key range, sorted by key with rules before URLs."""
    stack: list[tuple[str, int, str]] = []
    for pdf in batches:
        rule, action, depth, keep = [], [], [], []
        for i, (key, kind, rid, act) in enumerate(zip(pdf["key"], pdf["kind"], pdf["rule_id"], pdf["action"], strict=True)):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, int(rid), act))
            else:
                keep.append(i)
                top = stack[-1] if stack else (None, None, None)
                rule.append(top[1])
                action.append(top[2])
                depth.append(len(stack))
        out = pdf.iloc[keep][["page_id", "key"]].reset_index(drop=True)
        out["rule_id"], out["action"], out["n_active"] = pd.array(rule, dtype="Int64"), pd.Series(action, dtype=object), pd.array(depth, dtype="Int32")
        yield out


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default_action: str = DEFAULT_ACTION, ranges: int | None = None, boundary_sample: int = 10_000) -> DataFrame:
    """page_id, url_key, rule_id, action, n_active (how many rules hold the URL), a row for each page.

    ``rules``: rule_id, prefix, action; rows with a null or empty prefix are no rules.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pick(pages, page_id=id_col, url=url_col).select(F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("key"))
    valid = keyed.where(F.col("key").isNotNull())
    n = valid.count()
    sample = sorted(r.key for r in valid.select("key").where(hash_fraction(F.col("key")) * n < boundary_sample).collect()) if n else []
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf(INT)
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    none = F.lit(None)
    urls = valid.select(range_of("key").alias("pid"), "key", F.lit(1).alias("kind"), "page_id", none.cast("long").alias("rule_id"), none.cast("string").alias("action"))
    own = pick(rules, rule_id="rule_id", prefix="prefix", action="action").where(F.length("prefix") > 0)
    opened = own.select(
        F.explode(F.sequence(range_of("prefix"), range_of(F.concat("prefix", F.lit(_TOP))))).alias("pid"),
        F.col("prefix").alias("key"), F.lit(0).alias("kind"), none.cast("long").alias("page_id"), F.col("rule_id").cast("long").alias("rule_id"), "action",
    )
    together = opened.unionByName(urls).repartitionById(len(cuts) + 1, F.col("pid")).sortWithinPartitions("pid", "key", "kind", F.desc("rule_id"))
    swept = together.mapInPandas(_sweep, schema(page_id=LONG, key=STRING, rule_id=LONG, action=STRING, n_active=INT))
    held = swept.select("page_id", F.col("key").alias("url_key"), "rule_id", F.when(F.col("rule_id").isNull(), F.lit(default_action)).otherwise(F.col("action")).alias("action"), "n_active")
    bad = keyed.where(F.col("key").isNull()).select("page_id", F.col("key").alias("url_key"), none.cast("long").alias("rule_id"), F.lit("invalid").alias("action"), F.lit(0).alias("n_active"))
    return held.unionByName(bad)


def op4_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id long, prefix string, action string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_RULE_ROWS = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
OP4_SQL = f"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(trim(url), '{_PARTS}', 1)), '\\.+$', '') AS host,
                  regexp_extract(trim(url), '{_PARTS}', 2) AS rest FROM pages),
k AS (SELECT page_id, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ',)'
             || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS url_key FROM p),
rules(rule_id, prefix, action) AS (VALUES {_RULE_ROWS}),
m AS (SELECT k.page_id, k.url_key, r.rule_id, r.action,
             row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.prefix) DESC, r.rule_id) AS rn,
             count(r.rule_id) OVER (PARTITION BY k.page_id) AS n
      FROM k LEFT JOIN rules r ON starts_with(k.url_key, r.prefix))
SELECT page_id, url_key, rule_id::BIGINT AS rule_id, CASE WHEN url_key IS NULL THEN 'invalid' ELSE coalesce(action, '{DEFAULT_ACTION}') END AS action,
       n::INTEGER AS n_active
FROM m WHERE rn = 1
"""

QUERIES = {"op4_url_filters": op4_url_filters}
SQL = {"op4_url_filters": OP4_SQL}
