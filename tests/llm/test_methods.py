"""Each method against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from ravelin.llm import fingerprints, kneser_ney, language_id, mixing, near_dedup, packing, quality_rules, recurrent_lm, token_counts, url_filters


# 1
def test_viterbi_is_the_best_of_all_paths():
    rnd = np.random.default_rng(1)
    many = [rnd.normal(size=(n, 3)) * 3 for n in (5, 0, 1, 4)]
    for scores, got in zip(many, language_id.viterbi(many, 2.0), strict=True):
        worth = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        paths = np.array(np.meshgrid(*[range(3)] * len(scores))).reshape(len(scores), -1).T if len(scores) else []
        assert len(got) == len(scores) and (not len(scores) or worth(got.tolist()) == pytest.approx(max(worth(p.tolist()) for p in paths)))


def test_language_accuracy_and_mixed_text(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(d)
    got = language_id.language_spans(d, model).join(d.select("doc_id", d.lang.alias("truth")), "doc_id").where("n_words >= 5")
    assert got.where("lang = truth").count() / got.count() > 0.97
    by = {lang: d.where(f"lang = '{lang}' AND n_chars BETWEEN 400 AND 3000").first().text for lang in ("en", "de")}
    mixed = docs(spark, [(1, by["en"] + " " + by["de"] + " Привет мир Привет мир Привет мир", "en", "s")])
    spans = language_id.language_spans(mixed, model).first().spans
    assert [s.lang for s in spans][0] == "en" and "de" in [s.lang for s in spans] and spans[-1].lang == "ru"
    text = mixed.first().text
    assert text[spans[-1].start : spans[-1].end] == "Привет мир Привет мир Привет мир"


@pytest.mark.parametrize("full", [0, 4_000_000])
def test_trigram_scores_against_the_formula(spark, monkeypatch, full):
    """A plain interpolation by dictionaries, for words known and new, in both forms of the tables."""
    monkeypatch.setattr(language_id, "_FULL_ENTRIES", full)
    texts = [(1, "banana band bandana nab", "xx"), (2, "cabana cab dab banal", "yy"), (3, "баба дед", "zz")]
    model = language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    counts = {}
    for _, t, lang in texts:
        c = counts.setdefault(lang, Counter())
        for w in t.split():
            s = f"\n\n{w}\n"
            c.update(s[i : i + 3] for i in range(len(s) - 2))
    for word in ("banana", "cab", "zebra", "nn"):
        got = model.score([word, "дед"])[0]
        for i, lang in enumerate(model.trained):
            c, want = counts[lang], 0.0
            part = lambda at, x, c=c: sum(n for g, n in c.items() if g[at] == x)
            s = f"\n\n{word}\n"
            for k in range(len(s) - 2):
                g = s[k : k + 3]
                p1 = (part(slice(2, 3), g[2]) + 0.5) / (c.total() + 0.5 * (len({x[2] for x in c}) + 1))
                p2 = (part(slice(1, 3), g[1:]) + 4 * p1) / (part(slice(1, 2), g[1]) + 4)
                want += math.log((c[g] + 4 * p2) / (part(slice(0, 2), g[:2]) + 4))
            assert got[i] == pytest.approx(want if lang != "zz" else want - 1e4, abs=1e-3)


def test_three_hundred_languages_of_many_scripts(spark):
    """More languages than a byte counts, more letters than an alphabet holds; ties go to the first in the alphabet."""
    rnd = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(3000)]
    rows, words = [], {}
    for k in range(300):
        letters = rnd.sample(han, 40) if k % 3 == 0 else rnd.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçåøß", 12) if k % 3 == 1 else rnd.sample([chr(0x0C05 + i) for i in range(40)], 15)
        own = ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(60)]
        words[f"l{k:03}"] = own
        rows.append((k, " ".join(own * 3), f"l{k:03}"))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = docs(spark, [(k, " ".join(own[:20]), "", "s") for k, own in enumerate(words.values())] + [(900, "𐌰𐌱𐌲 ગુજરાતી ગુજરાતી", "", "s")])
    got = {r.doc_id: r for r in language_id.language_spans(asked, model).collect()}
    assert len(model.states) > 300 and sum(got[k].lang == f"l{k:03}" for k in range(300)) >= 297
    assert got[900].lang == "gu" and [s.lang for s in got[900].spans][0] == "und"
    twins = language_id.fit(spark.createDataFrame([(1, "abc abd", "q"), (2, "abc abd", "p")], "doc_id long, text string, lang string"))
    assert language_id.language_spans(docs(spark, [(1, "abc abd", "", "s")]), twins).first().lang == "p"


# 2
def test_rules_are_found_and_sql_agrees(spark):
    rnd = random.Random(4)
    good = [(i, ". ".join(prose(rnd.random(), 8) for _ in range(5)), 1) for i in range(300)]
    bad = [(300 + i, prose(i, 40).upper() if i % 2 else "%% ## @@ " * 20 + prose(i, 4), 0) for i in range(120)]
    d = docs(spark, [(i, t, "en", "s") for i, t, _ in good + bad])
    lab = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(d, lab)
    got = quality_rules.rule_decisions(d, lab, rules).collect()
    assert sum(r.keep == (r.doc_id < 300) for r in got) / len(got) > 0.98
    x = {n: np.array([r[n] for r in got]) for n in quality_rules.STATISTICS}
    first = np.zeros(len(got), int)
    for k, rule in reversed(list(enumerate(rules, 1))):
        first[quality_rules.covered(rule, x)] = k
    assert [r.rule or 0 for r in got] == first.tolist()


def test_growing_and_pruning_against_a_naive_learner():
    """Conditions by trying every threshold row by row; the pruned beginning by trying each; ties to the first statistic and the lowest threshold."""
    rnd = np.random.default_rng(3)
    for _ in range(20):
        x = {n: rnd.integers(0, 9, 60).astype(float) for n in ("a", "b")}
        bad = (x["a"] > 5) & (x["b"] < 4) | (rnd.random(60) < 0.1)
        inside, rule = np.ones(60, bool), ()
        while len(rule) < 4 and (bad & inside).any() and (~bad & inside).any():
            base, best, found = math.log2((bad & inside).sum() / inside.sum()), 1e-9, None
            for name in x:
                values = sorted(set(x[name][inside]))
                for above in (False, True):
                    for lo, hi in zip(values, values[1:], strict=False):
                        c = quality_rules.Condition(name, above, (lo + hi) / 2)
                        at = inside & c.holds(x)
                        p = int((bad & at).sum())
                        gain = p * (math.log2(p / at.sum()) - base) if p else -1.0
                        if gain > best + 1e-12:
                            best, found = gain, c
            if found is None:
                break
            rule += (found,)
            inside &= found.holds(x)
        assert quality_rules.grow(x, bad) == rule
        if rule:
            y = {n: rnd.integers(0, 9, 60).astype(float) for n in x}
            worse = (y["a"] > 5) & (y["b"] < 4)
            worth = []
            for k in range(1, len(rule) + 1):
                at = quality_rules.covered(rule[:k], y)
                p, n = int((worse & at).sum()), int((~worse & at).sum())
                worth.append(((p - n) / (p + n) if p + n else -1.0, k))
            assert quality_rules.prune(rule, y, worse) == rule[: max(worth)[1]]


# 3
def _fewest(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rnd = random.Random(8)
    for _ in range(150):
        cap, lengths = 20, sorted((rnd.randint(2, 20) for _ in range(rnd.randint(1, 8))), reverse=True)
        fixed, rest = packing.reduce_instance(lengths, cap)
        assert sorted([x for b in fixed for x in b] + rest) == sorted(lengths) and all(sum(b) <= cap for b in fixed)
        assert len(fixed) + _fewest(rest, cap) == _fewest(lengths, cap)
        assert len(packing.pack_lengths(lengths, cap)) <= _fewest(lengths, cap) + 1


def test_packing_round_trip(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(d, capacity=128, shard_tokens=20_000).collect()
    encoder = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    size = {r.doc_id: len(encoder.spans(r.text)[0]) for r in d.collect()}
    pieces, bins = {}, Counter()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        bins[r.shard, r.bin] += r.n_tokens
    assert max(bins.values()) <= 128 and pieces.keys() == size.keys()
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == size[i]


# 4
def test_url_rules_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = spark.createDataFrame(url_filters.RULES, "rule_id long, prefix string, action string")
    for ranges in (1, 7):
        for r in url_filters.filter_urls(pages, rules, ranges=ranges).collect():
            hits = [x for x in url_filters.RULES if r.url_key.startswith(x[1])]
            best = max(hits, key=lambda x: (len(x[1]), -x[0]), default=(None, "", "keep"))
            assert (r.rule_id, r.action, r.n_active) == (best[0], best[2], len(hits))


def test_addresses_in_brackets_are_hosts_of_their_own(spark):
    urls = ["http://[::1]:80/a", "http://u:p@[2001:db8::7]/b?c#d", "http://[::2]", "http://1.2.3.4:8/x"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filters.url_key(F.col("u")).alias("k")).collect()]
    assert got == ["[::1],)/a", "[2001:db8::7],)/b?c", "[::2],)/", "4,3,2,1,)/x"]


# 5
@pytest.mark.parametrize("head", [0, 8, 1 << 20])
def test_kneser_ney_against_the_formula(spark, head):
    rnd = random.Random(2)
    texts = [[rnd.choice("abcde") for _ in range(rnd.randint(1, 12))] for _ in range(60)]
    vocabulary = np.sort(kneser_ney._hashes(list("abcde")))
    number = dict(zip("abcde", kneser_ney.word_numbers(vocabulary, list("abcde")).tolist(), strict=True))
    unk, bos = kneser_ney._UNK, kneser_ney._BOS
    c3 = Counter()
    for t in texts:
        w = [bos, bos, *(number[x] for x in t)]
        c3.update(zip(w, w[1:], w[2:], strict=False))
    c2 = Counter((v, w) for _, v, w in c3)
    for _, v, w in c3:
        if v == bos:
            c2[v, w] = sum(k for (a, b, c), k in c3.items() if (b, c) == (v, w))
    c1 = Counter(w for _, w in c2)

    def level(counts, context, w, lower):
        d = kneser_ney._discounts(Counter(counts.values()))
        own = {k: n for k, n in counts.items() if k[:-1] == context}
        if not own:
            return lower
        total = sum(own.values())
        n = own.get((*context, w), 0)
        held = sum(d[min(k, 3) - 1] for k in own.values())
        return (n - d[min(n, 3) - 1] if n else 0) / total + held / total * lower

    kinds = len(number) + 1
    p = lambda u, v, w: level(c3, (u, v), w, level(c2, (v,), w, level({(k,): n for k, n in c1.items()}, (), w, 1 / kinds)))
    counts = spark.createDataFrame([((u << 42) | (v << 21) | w, n) for (u, v, w), n in c3.items()], "key long, n long")
    model = kneser_ney.estimate(counts, vocabulary, 4, head)
    asked = ["a b c", "e e e e e", "d a b", "a", "a new b b word", "e d c b a a b c d e"]
    got = model.sums(spark.createDataFrame(list(enumerate(asked)), "id long, text string"))
    for r in got.collect():
        padded = [bos, bos, *(number.get(x, unk) for x in asked[r.id].split())]
        want = sum(math.log(p(*padded[i : i + 3])) - math.log(4) * (padded[i + 2] == unk) for i in range(len(padded) - 2))
        assert r.n_words == len(padded) - 2 and r.log_p / 1e6 == pytest.approx(want, abs=1e-4)
    trained = sum(n * math.log(p(*k)) for k, n in c3.items()) / c3.total()
    assert model.mean_log == pytest.approx(trained, abs=1e-6)
    assert sum(p(number["a"], number["b"], w) for w in (unk, *number.values())) == pytest.approx(1.0)


def test_the_model_counts_every_trusted_document_of_its_half(spark, monkeypatch):
    d = spark.range(16_000).selectExpr("id AS doc_id", "'one two three' AS text")
    lab = d.selectExpr("doc_id", "1 AS quality")
    monkeypatch.setattr(kneser_ney, "estimate", lambda counts, *_, **__: counts.agg({"n": "sum"}).first()[0])
    half = kneser_ney._half(kneser_ney.trusted_ids(lab), held_out=False).count()
    assert half > 7_000 and kneser_ney.fit(d, lab) == 3 * half


def test_scoring_in_parts_gives_the_same_sums(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a b c d {i % 7} e a b", "en") for i in range(300)], "doc_id long, text string, lang string")
    lab = d.selectExpr("doc_id", "1 AS quality")
    columns = ("doc_id", "n_words", "perplexity", "threshold", "keep")
    whole = kneser_ney.perplexities(d, lab).select(*columns).orderBy("doc_id").collect()
    monkeypatch.setattr(kneser_ney, "_PARTS_FROM", 10)
    assert kneser_ney.perplexities(d, lab).select(*columns).orderBy("doc_id").collect() == whole and len(whole) == 300


def test_keep_fluent_scores_what_it_needs_in_as_many_parts_as_it_takes(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a b c d {i % 7} e a b" if i % 50 else "x y z", "en") for i in range(300)], "doc_id long, text string, lang string")
    lab = d.where("doc_id < 100").selectExpr("doc_id", "1 AS quality")
    want = {r.doc_id for r in kneser_ney.perplexities(d, lab).where("keep").collect()}
    asked, parts, sums, written = [], [], kneser_ney.Model.sums, kneser_ney._written
    monkeypatch.setattr(kneser_ney.Model, "sums", lambda self, texts: asked.append(texts.count()) or sums(self, texts))
    monkeypatch.setattr(kneser_ney, "_written", lambda df, tag, *rest: parts.append(tag) or written(df, tag, *rest))
    monkeypatch.setattr(kneser_ney, "_PARTS_FROM", 100)
    held = kneser_ney._half(kneser_ney.trusted_ids(lab), held_out=True).count()
    assert {r.doc_id for r in kneser_ney.keep_fluent(d, d, lab).collect()} == want
    assert asked == [held, 300] and parts.count("kn-known") == 1 + 3
    monkeypatch.setattr(kneser_ney, "_BROADCAST_ROWS", 0)  # then scores are joined
    assert {r.doc_id for r in kneser_ney.keep_fluent(d, d, lab).collect()} == want and asked[2] > held


def test_the_filter_is_not_filled_by_trigrams(spark):
    rnd = np.random.default_rng(5)
    u, v, w = rnd.integers(3, 803, 60_000), rnd.integers(3, 103, 60_000), rnd.integers(3, 43, 60_000)
    counts = spark.createDataFrame(pd.DataFrame({"key": (u << 42) | (v << 21) | w, "n": 1}))
    model = kneser_ney.estimate(counts, np.arange(1_000, dtype=np.uint64), 1, 0)
    assert 0 < np.unpackbits(model.shared.bloom.view(np.uint8)).sum() <= 3 * len(np.unique((v << 21) | w))
    model.discard()


def test_scoring_moves_what_is_asked_once(spark, monkeypatch):
    texts = [prose(i, 120) for i in range(600)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = kneser_ney.fit(d, d.where("doc_id % 2 = 0").selectExpr("doc_id", "1 AS quality"))
    sizes, written = [], kneser_ney._written

    def seen(df, *rest):
        out = written(df, *rest)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(kneser_ney, "_written", seen)
    monkeypatch.setattr(kneser_ney, "_PARTS_FROM", 10)
    got = {r.doc_id: r.n_words for r in model.sums(d.select("doc_id", "lang", "text")).collect()}
    assert got == dict.fromkeys(range(600), 120)
    assert len(sizes) <= 3 and sum(sizes) < 60 * len(texts)  # of a text there is a row of numbers, and no n-grams
    model.discard()


def test_packed_numbers_come_back():
    for x in (np.array([5, 3, 3, 2**63 - 1, 0, -(2**62)]), np.array([7, -1, 2**31 - 1], np.int32), np.zeros(0, np.int64)):
        assert (kneser_ney._unpacked(kneser_ney._packed(x), x.dtype.type) == x).all()


def test_the_model_on_disk_is_small(spark):
    rnd = np.random.default_rng(3)
    words = rnd.integers(3, 300, (60_000, 3))
    keys = (words[:, 0] << 42) | (words[:, 1] << 21) | words[:, 2]
    counts = spark.createDataFrame(pd.DataFrame({"key": keys, "n": 1}))
    model = kneser_ney.estimate(counts, np.arange(300, dtype=np.uint64), 1)
    files = {f.removeprefix("file://") for df in model._written for f in df.inputFiles()}
    assert sum(map(os.path.getsize, files)) < 8 * len(np.unique(keys))
    model.discard()


def test_a_rare_language_takes_the_common_threshold(spark):
    scores = spark.createDataFrame([("en", float(i)) for i in range(200)] + [("xx", 5.0)] * 3 + [(None, 7.0)], "lang string, perplexity double")
    got = {r.lang: r.threshold for r in kneser_ney._thresholds(scores, 0.99, 100).collect()}
    assert got.keys() == {"en", None} and kneser_ney._thresholds(scores, 0.99, 1).count() == 3


def test_thresholds_are_exact_in_any_order_of_rows(spark):
    x = np.random.default_rng(4).lognormal(8, 1, 6_000)
    want = {"en": np.sort(x[:5_000])[4_994], None: np.sort(x)[5_993]}
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(x))
        scores = spark.createDataFrame(pd.DataFrame({"lang": np.where(order < 5_000, "en", None), "perplexity": x[order]}), "lang string, perplexity double").repartition(seed + 1)
        assert {r.lang: r.threshold for r in kneser_ney._thresholds(scores, 0.9989, 100).collect()} == want


def test_classifier_keeps_clean_text(spark, sf):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = kneser_ney.perplexities(d, lab).join(lab, "doc_id")
    assert got.where("quality = 1 AND keep").count() / got.where("quality = 1").count() > 0.99
    assert got.where("quality = 0 AND NOT keep").count() > 0.3 * got.where("quality = 0").count()


# 6
def test_mixing_quotas(spark):
    rows = [(i, prose(i, 50), "en", f"src{i % 3}") for i in range(300)]
    weights = {"src0": 3.0, "src1": 1.0, "src2": 0.0}
    d = docs(spark, rows)
    got = mixing.mixing_decisions(d, weights, budget=0.4, block_tokens=200, shard_docs=10_000).collect()
    avail = {s: -(-sum(r.n_tokens for r in got if r.source == s) // 200) for s in ("src0", "src1", "src2")}
    seats, quota = math.floor(sum(avail.values()) * 0.4), Counter()
    for _ in range(seats):
        open_ = [s for s in ("src0", "src1") if quota[s] < avail[s]]
        if open_:
            quota[max(open_, key=lambda s: weights[s] / (2 * quota[s] + 1))] += 1
    blocks = {(r.source, r.block) for r in got if r.selected}
    assert Counter(s for s, _ in blocks) == quota
    assert {r.doc_id for r in mixing.mix(d, weights, budget=0.4, block_tokens=200, shard_docs=10_000).collect()} == {r.doc_id for r in got if r.selected}


def test_mixing_by_tokens_against_brute_force(spark, sf):
    """The registered query: tokens by the encoder, blocks by walking the documents, seats one by one, the seeded draw."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    enc = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    h32 = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
    size = mixing.BLOCK_TOKENS
    by = {}
    for r in d.collect():
        by.setdefault(r.source, []).append((h32(mixing.SEED, "order", r.doc_id), r.doc_id, len(enc.spans(r.text)[0]) if r.text else 0))
    block, avail = {}, {}
    for source, rows in by.items():
        at = 0
        for _, doc_id, n in sorted(rows):
            block[doc_id] = (source, at // size, n)
            at += n
        avail[source] = -(-at // size)
    quota = Counter()
    for _ in range(math.floor(sum(avail.values()) * mixing.BUDGET)):
        weight = lambda s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT)
        quota[min((s for s in avail if quota[s] < avail[s]), key=lambda s: (-weight(s) / (2 * quota[s] + 1), s))] += 1
    drawn = {(s, b) for s in avail for b in sorted(range(avail[s]), key=lambda b: (h32(mixing.SEED, "draw", 0, f"s{s}", b), b))[: quota[s]]}
    got = mixing.QUERIES["op6_mixing"](spark, sf).collect()
    assert len(got) == len(block) and {r.doc_id: (r.source, r.block, r.n_tokens) for r in got} == block
    assert all(r.selected == ((r.source, r.block) in drawn and r.n_tokens > 0) for r in got)


def test_mixing_of_repeated_rows(spark):
    rows = [(i // 3, prose(i // 3, 30), "en", "s") for i in range(60)] + [(7, prose(99, 30), "en", "s")]
    got = mixing.mixing_decisions(docs(spark, rows), budget=0.5, block_tokens=400).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    kept = Counter(r.doc_id for r in mixing.mix(docs(spark, rows), budget=0.5, block_tokens=400).collect())
    assert kept == Counter(r.doc_id for r in got if r.selected) and all(n in (1, 3, 4) for n in kept.values())


def test_realised_shares_with_production_parameters(spark):
    hot = ["src4"] * 40 + [f"src{i}" for i in (0, 3, 7, 9) for _ in range(10)]
    got = mixing.mixing_decisions(docs(spark, [(i, prose(i, 2_000), "en", s) for i, s in enumerate(hot)]), vocabulary=None)  # by words, so that each block has a document's begin
    weights = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in set(hot)}
    rows = got.collect()
    avail = {s: -(-sum(r.n_tokens for r in rows if r.source == s) // 4096) for s in weights}
    quota = Counter()
    for _ in range(math.floor(sum(avail.values()) * 0.9)):
        quota[max((s for s in avail if quota[s] < avail[s]), key=lambda s: weights[s] / (2 * quota[s] + 1))] += 1
    assert Counter(s for s, _ in {(r.source, r.block) for r in rows if r.selected}) == quota
    shares = {r.source: r for r in mixing.realised_shares(got).collect()}
    taken = sum(r.n_tokens for r in rows if r.selected)
    for s, r in shares.items():
        assert r.target == pytest.approx(weights[s] / sum(weights.values()))
        assert r.share == pytest.approx(sum(x.n_tokens for x in rows if x.selected and x.source == s) / taken)
        assert r.exhausted == (quota[s] == avail[s])
    assert shares["src4"].share > 1.5 * shares["src4"].target and shares["src7"].exhausted and shares["src7"].share < shares["src7"].target


# 7
def test_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(5)
    for _ in range(4):
        a, b = (dict(zip(rnd.choice(400, 150, replace=False).tolist(), rnd.integers(1, 20, 150).tolist(), strict=True)) for _ in range(2))
        b |= {k: v for k, v in list(a.items())[:100]}
        rows = sorted((d, k, v) for d, x in enumerate((a, b)) for k, v in x.items())
        doc, item, count = (np.array(c) for c in zip(*rows, strict=True))
        sig = near_dedup.signatures(doc, item.astype(np.uint64) * np.uint64(7919), count, 2, 4096)
        keys = a.keys() | b.keys()
        truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 4096)


@pytest.mark.parametrize("hot, hubs", [(near_dedup._HOT, near_dedup._HUBS), (3, (1, 1))])
def test_near_duplicates_against_all_pairs(spark, sf, monkeypatch, hot, hubs):
    """Also with every key hot, and with bands taken up one document at a time."""
    monkeypatch.setattr(near_dedup, "_HOT", hot if hot > 3 else 100_000)
    monkeypatch.setattr(near_dedup, "_HUBS", hubs)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    bags = {i: Counter(zip(*(near_dedup.shingle_hashes([t])[1].tolist(),), strict=True)) for i, t in text.items()}
    want = set()
    for a, b in combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        if both and both / sum((bags[a] | bags[b]).values()) >= near_dedup.THRESHOLD:
            want.add((a, b))
    group = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(d).collect()}
    assert len(want) > 5 and sum(group[a] == group[b] for a, b in want) >= 0.9 * len(want)
    root = {i: i for i in text}
    for a, b in sorted(want):
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    assert all(root[i] == root[g] for i, g in group.items())


def test_a_repeated_id_keeps_the_same_row_every_time(spark):
    rows = [(1, prose(1, 50), "en", "s"), (1, prose(2, 50), "en", "s"), (1, prose(2, 50), "de", "s"), (2, prose(3, 50), "en", "s"), (2, prose(3, 50), "en", "s")]
    got = [sorted(map(tuple, near_dedup.near_dedup(docs(spark, rows[::step]).repartition(n)).collect()), key=str) for step, n in ((1, 1), (-1, 5))]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2]


# 8
@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution(spark, sf, rule):
    rows = [(-1, "alpha beta\n\n  gamma ünï😀\n\ndelta"), (-2, ""), (-3, "x"), (-4, "a\n" * 50 + "    \n   b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    enc = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    got = {}
    for r in token_counts.section_token_counts(d, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        raw, parts = text.encode(), got[doc_id]
        want = Counter()
        cut = [(r.first_byte, r.first_byte + r.n_bytes) for r in parts]
        for a, b in zip(*enc.spans(text), strict=True) if text else []:
            inside = [max(0, min(b, y) - max(a, x)) for x, y in cut]
            if rule == "start":
                want[next(i for i, (x, y) in enumerate(cut) if x <= a < y)] += 1
            elif rule == "majority":
                want[int(np.argmax(inside))] += 1
            else:
                for i, n in enumerate(inside):
                    want[i] += n / (b - a)
        assert b"".join(raw[x:y] for x, y in cut) == raw
        assert [float(r.n_tokens) for r in parts] == pytest.approx([want[i] for i in range(len(parts))])
    if rule == "start":
        fields = token_counts.field_token_counts(spark.createDataFrame([(1, "a b", None, "c")], "doc_id long, x string, y string, z string"), ["x", "y", "z"]).collect()
        assert sum(r.n_tokens for r in fields) == len(enc.spans("a b\n\nc")[0])


# 9
def test_fingerprints_by_both_ways(spark):
    rows = [(i, prose(i // 2, 40) + (" extra" if i % 2 else ""), "en", "s") for i in range(40)] + [(99, None, "en", "s"), (5, prose(2, 40), "en", "s")]
    d = docs(spark, rows)
    a = sorted(map(tuple, fingerprints.fingerprints(d, idf_lo=0.1, idf_hi=3.0).collect()), key=repr)
    b = sorted(map(tuple, fingerprints.fingerprints(d, idf_lo=0.1, idf_hi=3.0, broadcast_terms=0).collect()), key=repr)
    assert a == b
    df = Counter(w for _, t, _, _ in rows if t for w in set(t.split()))
    lex = {w for w, n in df.items() if 0.1 <= math.log(len(rows) / n) <= 3.0}
    first = next(x for x in a if x[0] == 0)
    terms = sorted(lex & set(rows[0][1].split()))
    assert first[1] == len(terms) and first[2] == hashlib.md5(" ".join(terms).encode()).hexdigest()


# 10
def test_gradients_against_differences():
    p = {k: v.astype(np.float64) for k, v in recurrent_lm.initial(np.ones(12), 3, 4, 5, seed=2).items()}
    old, recurrent_lm._f = recurrent_lm._f, np.float64
    try:
        lengths, words = np.array([5, 3, 4]), np.random.default_rng(0).integers(0, 12, 12)
        s = recurrent_lm.Streams(lengths, words, 2, 12)
        live = len(s.loads)
        args = (s.input, s.target, s.fresh, s.doc >= 0, np.zeros((live, 5)))
        g, _, lp = recurrent_lm.gradients(p, *args)
        for k in p:
            full = np.zeros_like(p[k])
            if k == "E":
                full[g[k][0]] = g[k][1]
            else:
                full = g[k]
            for at in [tuple(np.random.default_rng(i).integers(0, n) for n in p[k].shape) for i in range(6)]:
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += 1e-6
                assert -(recurrent_lm.gradients(q, *args)[2] - lp) / 1e-6 == pytest.approx(full[at], abs=1e-4)
    finally:
        recurrent_lm._f = old


def test_windows_are_longer_where_few_streams_are_left():
    lengths = np.array([1_000, *[20] * 63])
    s = recurrent_lm.Streams(lengths, np.zeros(lengths.sum(), np.int32), 64, 12)
    got = list(s.windows(16))
    assert [x for at, _ in got for x in range(at.start, at.stop)] == list(range(1_000))
    assert all(at.stop - at.start >= 16 or at.stop == 1_000 for at, _ in got) and len(got) <= 4  # 63 of 16 positions
    assert all(live == (s.loads > at.start).sum() for at, live in got)


def test_words_are_counted_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "_FLUSH", 10)
    lots = list(recurrent_lm._count_words([pd.DataFrame({"text": [f"A{i} b{i} c" for i in range(100)]})]))
    assert max(map(len, lots)) <= 13 and sum(x["n"].sum() for x in lots) == 300


def test_softmax_of_any_logits():
    for scale in (1, 50, 300):
        x = (np.random.default_rng(1).standard_normal((40, 9)) * scale).astype(np.float32)
        wide = x.astype(np.float64)
        want = wide.max(axis=1) + np.log(np.exp(wide - wide.max(axis=1, keepdims=True)).sum(axis=1))
        prob, lse = recurrent_lm._softmax(x)
        assert lse == pytest.approx(want, rel=1e-5) and recurrent_lm._log_sum(x) == pytest.approx(want, rel=1e-5)
        assert prob == pytest.approx(np.exp(wide - want[:, None]), abs=1e-5)


def test_state_is_carried_and_words_sum_to_one():
    p = recurrent_lm.initial(np.arange(12.0), 3, 4, 5, seed=3)
    lengths, words = np.array([30, 2, 17]), np.random.default_rng(1).integers(0, 12, 49)
    a = recurrent_lm.score(p, lengths, words, streams=2, window=4)
    assert a == pytest.approx(recurrent_lm.score(p, lengths, words, streams=3, window=100), abs=1e-3)
    h = np.random.default_rng(2).normal(size=(12, 5)).astype(np.float32)
    one = np.repeat(h[:1], 12, axis=0)
    assert np.exp(recurrent_lm.log_probabilities(p, one, np.arange(12))).sum() == pytest.approx(1.0, abs=1e-4)


def test_likelihood_by_plain_recursion():
    """Unit by unit, one document after another, with whole softmaxes."""
    rng = np.random.default_rng(4)
    p = recurrent_lm.initial(np.arange(1.0, 13.0), 3, 4, 5, seed=9)
    lengths = np.array([7, 1, 12, 40, 3])
    units = rng.integers(0, 12, lengths.sum())
    want, at, n = [], 0, 5
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    for size in lengths:
        h, x, total = np.zeros(n), p["E"][12], 0.0
        for u in units[at : at + size]:
            g = h @ p["U"]
            z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
            c = np.tanh(x[2 * n :] + r * g[2 * n :])
            h = (1 - z) * c + z * h
            k, slot = divmod(int(u), 4)
            total += log_softmax(h @ p["C"] + p["c"])[k] + log_softmax(p["W"][k] @ h + p["w"][k])[slot]
            x = p["E"][u]
        want.append(total)
        at += size
    for streams, window in ((1, 5), (3, 4), (64, 24)):
        assert recurrent_lm.score(p, lengths, units, streams, window) == pytest.approx(want, abs=1e-3)


def test_training_beats_word_frequencies(spark):
    rnd = random.Random(6)
    nxt = {w: rnd.sample("abcdefgh", 2) for w in "abcdefgh"}

    def chain(n):
        out = ["a"]
        while len(out) < n:
            out.append(rnd.choice(nxt[out[-1]]))
        return " ".join(out)

    d = docs(spark, [(i, chain(300), "en", "s") for i in range(80)])
    bits = recurrent_lm.document_log_likelihood(d, classes=4, slots=4, hidden=12, train_rate=0.9, rounds=2, group_words=30_000, rate=0.1).agg({"bits_per_word": "avg"}).first()[0]
    assert bits < 2.2  # without context about 3 bits, at best 1


def test_production_defaults_train_on_every_document(spark):
    rnd = random.Random(8)
    nxt = {w: rnd.sample("abcdefgh", 2) for w in "abcdefgh"}

    def chain(n):
        out = ["a"]
        while len(out) < n:
            out.append(rnd.choice(nxt[out[-1]]))
        return out

    rows = [chain(4_000) for _ in range(30)]
    counts = Counter(w for r in rows for w in r)
    unigram = -sum(n / counts.total() * math.log2(n / counts.total()) for n in counts.values())
    got = recurrent_lm.document_log_likelihood(docs(spark, [(i, " ".join(r), "en", "s") for i, r in enumerate(rows)])).agg({"bits_per_word": "avg"}).first()[0]
    assert got < 0.75 * unigram
    for text in ("a b", "a c"):  # alone in their tables
        model = recurrent_lm.fit(docs(spark, [(1, text, "en", "s")]))
        assert np.any(model.parameters["C"] != recurrent_lm.initial(np.ones(3))["C"])
    spaces = docs(spark, [(i, "\u00a0", "en", "s") for i in range(20)] + [(99, "a b", "en", "s")])
    assert recurrent_lm.document_log_likelihood(spaces).agg({"n_words": "sum"}).first()[0] == 2


def test_units_spell_every_word(spark):
    rnd = random.Random(9)
    syllables = ["ka", "lo", "mi", "ne", "pu", "ra", "se", "ti"]
    rare = lambda: "".join(rnd.choice(syllables) for _ in range(5))
    junk = lambda: "".join(rnd.choice("bcdfghjkqvwxz579") for _ in range(10))
    rows = [(i, " ".join(rare() for _ in range(400)), "en", "s") for i in range(60)]
    rows += [(100, " ".join(rare() for _ in range(200)), "en", "s"), (101, " ".join(junk() for _ in range(200)), "en", "s")]
    small = {"classes": 8, "slots": 8, "hidden": 8, "rounds": 1}
    model = recurrent_lm.fit(docs(spark, rows), **small)
    strings = {n: u for u, n in model.units.numbers.items()}
    for word in ("kalo", "\u00e9t\u00e9", "\u4f60\u597d", "\U0001f600x", rows[0][1].split()[0], junk()):
        units = [strings[n] for n in model.units[word]]
        assert b"".join(bytes([u]) if isinstance(u, int) else u.encode() for u in units).decode() == word + " "
    by = {r.doc_id: r for r in recurrent_lm.document_log_likelihood(docs(spark, rows), model).collect()}
    assert by[100].n_words == by[101].n_words == 200
    assert by[101].bits_per_word > 1.3 * by[100].bits_per_word  # words beyond the most frequent 64 don't score alike
