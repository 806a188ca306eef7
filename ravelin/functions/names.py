"""Names: canonical keys, stable ids, ASCII case folding, token-set similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ODD = re.compile(r"[^\w\s-]")


def name_key(name: str | None, titles: Iterable[str] = ()) -> str | None:
    """Lower case, no accents, punctuation to blanks (``_`` and ``-`` stay), titles dropped, single blanks."""
    if name is None:
        return None
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    drop = set(titles)
    return " ".join(w for w in _ODD.sub(" ", plain.lower()).split() if w not in drop)


def name_key_column(name: Column, is_person: Column, titles: Iterable[str]) -> Column:
    """``name_key`` over a column; titles are dropped where ``is_person`` holds. NFKD isn't among Spark's functions, hence Arrow batches."""
    titles = tuple(titles)

    @F.pandas_udf(T.StringType())
    def keys(names: pd.Series, person: pd.Series) -> pd.Series:
        return pd.Series([name_key(n, titles if p else ()) for n, p in zip(names, person, strict=True)], dtype=object)

    return keys(name, F.coalesce(is_person, F.lit(False)))


def fold(text: str) -> str:
    """Lower case without accents, for full-text terms."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def ascii_fold(text: Column) -> Column:
    """A-Z to a-z and nothing else: the case rule of NOCASE and LIKE in the source data."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_nocase(text: Column, needle: str) -> Column:
    """LIKE '%needle%' without ASCII case; ``%`` and ``_`` in the needle stay wild, a backslash is an ordinary sign."""
    pattern = "%" + needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%"
    return F.call_function("like", ascii_fold(text), F.lit(pattern.replace("\\", "\\\\")))


def stable_id(prefix: Column | str, key: Column, hex_digits: int = 8) -> Column:
    """PREFIX-<first hex digits of sha1(key)>; take 16 digits beyond some tens of thousands of nodes."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(key), 1, hex_digits))


def text_fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0..100: equal tokens are put aside, what remains is compared, and each side is compared with the common part."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = x & y
    if common and (x <= y or y <= x):
        return 100.0
    base = " ".join(sorted(common))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    n = len(base) + bool(base)  # the blank that joins it counts as equal
    size = 2 * n + len(left) + len(right)
    best = 100.0 * (1 - (len(left) + len(right) - 2 * _lcs(left, right)) / size)
    if base:
        best = max(best, *(200.0 * len(base) / (2 * len(base) + 1 + len(rest)) for rest in (left, right)))
    return best
