"""Language spans of mixed-language text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script, by the code-point range of its first letter (outside the listed ranges by the first word of the letter's Unicode name), leaves the languages that are written in it. A script that no trained language
uses stands for one language, if it is tied to one, and needs no score. Among the others each word has a score for each language: its log-probability
under a smoothed character-trigram model over the letters themselves, of which there may be any number, as of languages. Viterbi then finds the labels of all words of the whole text at once, with a penalty for each change of language, so a
stray foreign-looking word doesn't break a span but a foreign sentence is one.

A trigram's log-probability is a sum: what its last letter would have alone, and corrections for a known pair and a known trigram. So the
model is three sparse tables (letters, pairs, trigrams), each entry with the languages that have it, and grows with the trigrams seen and not with letters times languages.

The models are fitted on at most ``max_train_docs`` documents of each language of the ``lang`` column (a documented bound, by a hash of the id), of which the ids
are broadcast up to a counted number; Spark sums the trigram counts. Labelling runs in Arrow batches in the
scan's stage, for many documents in step; there is no shuffle of texts.

Defined cases: null texts and texts without a letter have the language ``und``, no word and no span; training rows with a null
text or language are skipped; without training rows only the scripts that stand for one language are told and the rest is ``und``; of equal
scores the earlier language in alphabetical order wins, and of equal paths the one that stays; repeated rows give
repeated rows; a null ``doc_id`` is carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import DOUBLE, INT, LONG, STRING, bounded_sample, pick, schema
from ravelin.plans.lineage import broadcast_below, materialise

MAX_TRAIN_DOCS, PENALTY = 1500, 14.0
_BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: (script, the language that it stands for when no trained one is written in it, ranges of code points in hex).
_SCRIPTS = """
Latin - 41-24F 1E00-1EFF 2C60-2C7F A720-A7FF AB30-AB6F FB00-FB06 FF21-FF5A
Greek el 370-3FF 1F00-1FFF
Cyrillic ru 400-52F 1C80-1C8F 2DE0-2DFF A640-A69F
Armenian hy 531-58F FB13-FB17
Hebrew he 590-5FF FB1D-FB4F
Arabic ar 600-6FF 750-77F 870-8FF FB50-FDFF FE70-FEFE
Syriac syr 700-74F
Thaana dv 780-7BF
Nko nqo 7C0-7FF
Devanagari hi 900-97F A8E0-A8FF
Bengali bn 980-9FF
Gurmukhi pa A00-A7F
Gujarati gu A80-AFF
Oriya or B00-B7F
Tamil ta B80-BFF
Telugu te C00-C7F
Kannada kn C80-CFF
Malayalam ml D00-D7F
Sinhala si D80-DFF
Thai th E00-E7F
Lao lo E80-EFF
Tibetan bo F00-FFF
Myanmar my 1000-109F A9E0-A9FF AA60-AA7F
Georgian ka 10A0-10FF 1C90-1CBF 2D00-2D2F
Hangul ko 1100-11FF 3130-318F A960-A97F AC00-D7FF
Ethiopic am 1200-139F 2D80-2DDF AB00-AB2F
Cherokee chr 13A0-13FF AB70-ABBF
Canadian iu 1400-167F 18B0-18FF
Khmer km 1780-17FF
Mongolian mn 1800-18AF
Tifinagh zgh 2D30-2D7F
Kana ja 3040-30FF 31F0-31FF FF66-FF9F 1B000-1B16F
Bopomofo zh 3100-312F 31A0-31BF
Han zh 2E80-2FDF 3005-3007 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF
Yi ii A000-A4CF
Javanese jv A980-A9DF
"""
SCRIPTS = sorted((*(int(x, 16) for x in r.split("-")), name, None if lang == "-" else lang) for name, lang, *ranges in map(str.split, _SCRIPTS.strip().split("\n")) for r in ranges)
_FROM = [s[0] for s in SCRIPTS]
_BITS = 21
#: The strength of the lower order in each interpolation.
_PRIOR = 4.0
_FULL_ENTRIES = 4_000_000


@lru_cache(maxsize=1 << 16)
def _script_of_letter(letter: str) -> str | None:
    i = bisect_right(_FROM, ord(letter)) - 1
    if i >= 0 and ord(letter) <= SCRIPTS[i][1]:
        return SCRIPTS[i][2]
    name = unicodedata.name(letter, "")
    return name.split(" ")[0].split("-")[0].title() or None


def script_of(word: str) -> str | None:
    return _script_of_letter(word[0])


class _Sparse:
    """key -> (language, first value, second value) entries. ``rows``: key, lang, a, b, of any order."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((lang, key))
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.keys, self.at = key[first], np.r_[first, len(key)].astype(np.int64)
        self.lang, self.a, self.b = lang[order].astype(np.int16), a[order].astype(np.float32), b[order].astype(np.float32)

    def rows(self, languages: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries as (key x language) arrays, with zeros for what isn't there and a last row of zeros for no key."""
        size = np.diff(self.at)
        flat = np.repeat(np.arange(len(size)), size) * languages + self.lang
        return tuple(np.bincount(flat, weights=v, minlength=(len(size) + 1) * languages).astype(np.float32).reshape(-1, languages) for v in (self.a, self.b))

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, i, -1)

    def add(self, out: np.ndarray, word: np.ndarray, found: np.ndarray, values: np.ndarray) -> None:
        """Adds the entries at ``found`` (-1: none) to out[word, language]."""
        word, found = word[found >= 0], found[found >= 0]
        size = self.at[found + 1] - self.at[found]
        entry = np.arange(size.sum()) + np.repeat(self.at[found] - (np.cumsum(size) - size), size)
        flat = np.repeat(word, size) * out.shape[1] + self.lang[entry]
        out += np.bincount(flat, weights=values[entry], minlength=out.size).reshape(out.shape)


class Model:
    def __init__(self, languages: list[str], base: np.ndarray, letters: _Sparse, pairs: _Sparse, trigrams: _Sparse, scripts: dict[str, list[str]]):
        """``base``: log-probability of an unknown letter in each language; ``scripts``: languages written in a script."""
        self.trained, self.base, self.letters, self.pairs, self.trigrams = languages, base, letters, pairs, trigrams
        alone = {name: [lang] for _, _, name, lang in SCRIPTS if lang and name not in scripts}
        self.scripts = scripts | alone
        self.states = [*languages, *sorted({x[0] for x in alone.values()} - set(languages)), "und"]
        column = {s: i for i, s in enumerate(self.states)}
        self.masks = {}
        for name, langs in self.scripts.items():
            self.masks[name] = np.full(len(self.states), -1e4)
            self.masks[name][[column[x] for x in langs]] = 0.0
        tables = (letters, pairs, trigrams)
        # few languages: an entry for each of them costs less than a list of those that have one; the scores are the same
        self.full = [t.rows(len(languages)) for t in tables] if languages and sum(len(t.keys) + 1 for t in tables) * len(languages) <= _FULL_ENTRIES else None
        self.unknown = np.full(len(self.states), -1e4)
        self.unknown[column["und"]] = 0.0

    def score(self, words: list[str]) -> np.ndarray:
        """(word x state) scores; -10,000 for languages that the script rules out."""
        out = np.array([self.masks.get(script_of(w), self.unknown) for w in words]).reshape(len(words), len(self.states))
        if not self.trained or not words:
            return out
        text = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        edge = text == 10
        b = np.r_[10, text[:-1]]
        inner = b != 10
        a = np.where(inner, np.r_[10, 10, text[:-2]], 10)
        word = np.cumsum(edge) - edge
        last, pair = self.letters.find(text), self.pairs.find((b << _BITS) | text)
        # what stands before a sign is what was found one sign earlier, but at the begin of a word
        before = np.r_[self.letters.find(np.array([10])), last[:-1]]
        context = np.where(inner, np.r_[-1, pair[:-1]], self.pairs.find(np.array([(10 << _BITS) | 10]))[0])
        trigram = self.trigrams.find((a << 2 * _BITS) | (b << _BITS) | text)
        size = np.bincount(word, minlength=len(words))
        if self.full is not None:
            (la, lb), (pa, pb), (ta, _) = self.full
            each = la[last] + lb[before] + pa[pair] + pb[context] + ta[trigram]
            got = np.add.reduceat(each, np.cumsum(size) - size, axis=0, dtype=np.float64)
        else:
            got = np.zeros((len(words), len(self.trained)))
            for table, found, values in ((self.letters, last, self.letters.a), (self.letters, before, self.letters.b), (self.pairs, pair, self.pairs.a), (self.pairs, context, self.pairs.b), (self.trigrams, trigram, self.trigrams.a)):
                table.add(got, word, found, values)
        out[:, : len(self.trained)] += got + size[:, None] * self.base
        return out


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best state of each word of each document; ``scores``: (words x states) of each. Documents go in step, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    live = int((sizes > 0).sum())
    if not live:
        return out
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([scores[i] for i in order])
    now = flat[starts[:live]].copy()
    came = np.zeros(flat.shape, np.int16)
    own = np.arange(flat.shape[1], dtype=np.int16)
    state = np.zeros(live, np.int16)
    n = live
    for t in range(1, sizes[0]):
        n = int(np.searchsorted(-sizes[:n], -t, side="left"))
        if n < len(now):  # these have had their last word
            state[n : len(now)] = now[n:].argmax(axis=1)
            now = now[:n]
        best = now.argmax(axis=1)
        jump = now[np.arange(n), best][:, None] - penalty
        stay = now >= jump
        at = starts[:n] + t
        came[at] = np.where(stay, own, best[:, None])
        now = np.where(stay, now, jump) + flat[at]
    state[:n] = now.argmax(axis=1)
    labels = np.zeros(len(flat), np.int16)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(np.searchsorted(-sizes[:live], -t, side="left"))
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = came[at, state[:n]]
    for k, i in enumerate(order[:live]):
        out[i] = labels[starts[k] : starts[k] + sizes[k]]
    return out


def _count_trigrams(batches):
    chars: Counter = Counter()
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            for w in _WORD.findall(text.lower()):
                s = f"\n\n{w}\n"
                chars.update((lang, s[i : i + 3]) for i in range(len(s) - 2))
                chars[lang, "=" + (script_of(w) or "")] += 1
    yield pd.DataFrame({"lang": pd.Series([k[0] for k in chars], dtype=object), "gram": pd.Series([k[1] for k in chars], dtype=object), "n": pd.Series(list(chars.values()), dtype="int64")})


def estimate(rows: pd.DataFrame) -> Model:
    """From counts (lang, gram, n): trigrams of letters, the edge of a word being a line's end, and, behind a ``=``, scripts of words."""
    rows = rows.sort_values(["lang", "gram"], kind="stable")
    is_gram = ~rows["gram"].str.startswith("=")  # no letter is one
    written, grams = rows[~is_gram], rows[is_gram]
    languages = sorted(set(grams["lang"]))
    scripts: dict[str, list[str]] = {}
    for lang, part in written.groupby("lang"):
        for name, n in zip(part["gram"], part["n"], strict=True):
            if name != "=" and n >= 0.05 * part["n"].sum() and lang in languages:
                scripts.setdefault(name.removeprefix("="), []).append(lang)
    lang = np.searchsorted(np.array(languages, dtype=object), grams["lang"].to_numpy(dtype=object)).astype(np.int64) if len(grams) else np.zeros(0, np.int64)
    signs = np.frombuffer("".join(grams["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, 3)
    n3 = grams["n"].to_numpy(np.float64)

    def summed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, languages, sums, place of each row) of the different (key, language)."""
        order = np.lexsort((lang, key))
        k, g = key[order], lang[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])] if len(k) else np.zeros(0, bool)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], g[new], np.bincount(place, weights=n3, minlength=int(new.sum())), place

    a, b, c = signs.T
    k1, g1, n1, at1 = summed(c)
    kb, gb, nb, atb = summed(b)
    k2, g2, n2, at2 = summed((b << _BITS) | c)
    kc, gc, nc, atc = summed((a << _BITS) | b)
    count = len(languages)
    total, kinds = np.bincount(lang, weights=n3, minlength=count), np.bincount(g1, minlength=count) + 1
    below = total + 0.5 * kinds
    p1 = (n1 + 0.5) / below[g1]
    p2 = (n2 + _PRIOR * p1[_first_of(at2, at1, len(k2))]) / (nb[_first_of(at2, atb, len(k2))] + _PRIOR)
    p3 = (n3 + _PRIOR * p2[at2]) / (nc[atc] + _PRIOR)
    base = np.log(0.5 / below)
    back1, back2 = np.log(_PRIOR / (nb + _PRIOR)), np.log(_PRIOR / (nc + _PRIOR))
    d1 = np.log(p1) - base[g1]
    d2 = np.log(p2) - back1[_first_of(at2, atb, len(k2))] - np.log(p1)[_first_of(at2, at1, len(k2))]
    d3 = np.log(p3) - back2[atc] - np.log(p2)[at2]
    none = lambda x: np.zeros(len(x))
    letters = _Sparse(np.r_[k1, kb], np.r_[g1, gb], np.r_[d1, none(kb)], np.r_[none(k1), back1])
    pairs = _Sparse(np.r_[k2, kc], np.r_[g2, gc], np.r_[d2, none(kc)], np.r_[none(k2), back2])
    return Model(languages, base, letters, pairs, _Sparse((a << 2 * _BITS) | (b << _BITS) | c, lang, d3, none(d3)), scripts)


def _first_of(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """A value of each group, in all of whose rows it is the same."""
    out = np.zeros(size, np.int64)
    out[group] = values
    return out


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    own = pick(docs, id=id_col, lang=lang_col, text=text_col).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sample = materialise(bounded_sample(own.select("id", "lang"), "id", "lang", max_train_docs).distinct(), "lid-sample")
    train = own.join(broadcast_below(sample, sample.count(), _BROADCAST_ROWS), ["id", "lang"], "left_semi")
    counts = train.select("lang", "text").mapInPandas(_count_trigrams, schema(lang=STRING, gram=STRING, n=LONG)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return estimate(materialise(counts, "lid-counts").toPandas())


_SPAN = T.StructType([T.StructField("start", INT), T.StructField("end", INT), T.StructField("lang", STRING), T.StructField("n_words", INT)])
_RESULT = schema(doc_id=LONG, lang=STRING, n_words=LONG, n_spans=INT, lang_share=DOUBLE, spans=T.ArrayType(_SPAN))
_CHUNK_WORDS, _CACHE_WORDS = 300_000, 600_000


def _places(text: str, first: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Where the spans of words begin and end in the text. One span needs only the first and the last letter."""
    if len(first) > 1:
        at = [w.span() for w in _WORD.finditer(text)]
        return [(at[a][0], at[b - 1][1]) for a, b in zip(first, ends, strict=True)]
    end = len(text)
    while not _WORD.match(text, end - 1, end):
        end -= 1
    return [(_WORD.search(text).start(), end)]


def _labeller(shared, penalty: float):
    def label(batches):
        m: Model = shared.value
        und = len(m.states) - 1
        index: dict[str, int] = {}
        table = np.zeros((0, len(m.states)), np.float32)

        def chunk(ids, texts, words):
            nonlocal index, table
            if len(index) > _CACHE_WORDS:
                index, table = {}, table[:0]
            new = sorted({w for own in words for w in own if w not in index})
            if new:
                index |= {w: len(table) + i for i, w in enumerate(new)}
                table = np.concatenate([table, m.score(new).astype(np.float32)])
            used = table
            rows = [np.fromiter(map(index.__getitem__, own), np.int64, len(own)) for own in words]
            found = viterbi([used[r] for r in rows], penalty)
            out = []
            for key, text, states in zip(ids, texts, found, strict=True):
                n = len(states)
                if not n:
                    out.append((key, "und", 0, 0, None, []))
                    continue
                cuts = np.flatnonzero(states[1:] != states[:-1]) + 1
                first, ends = np.r_[0, cuts], np.r_[cuts, n]
                count = np.bincount(states, minlength=und + 1)
                top = int(count.argmax())
                spans = [{"start": a, "end": b, "lang": m.states[states[i]], "n_words": int(j - i)} for (a, b), i, j in zip(_places(text, first, ends), first, ends, strict=True)]
                out.append((key, m.states[top], n, len(spans), float(count[top] / n), spans))
            frame = pd.DataFrame(out, columns=_RESULT.names)
            frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64")
            return frame

        for pdf in batches:
            ids, texts, words, held = [], [], [], 0
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text if isinstance(text, str) else ""
                own = list(map(str.lower, _WORD.findall(text)))
                ids.append(key)
                texts.append(text)
                words.append(own)
                held += len(own)
                if held >= _CHUNK_WORDS:
                    yield chunk(ids, texts, words)
                    ids, texts, words, held = [], [], [], 0
            if ids:
                yield chunk(ids, texts, words)

    return label


def language_spans(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY, max_train_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang (of most words), n_words, n_spans, lang_share, spans (start and end in characters, lang, n_words), a row for each document."""
    model = fit(docs, max_train_docs, id_col, text_col, lang_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(_labeller(shared, penalty), _RESULT)


def op1_language_id(spark, sf_dir):
    return language_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
