"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from helpers import ODD, docs, prose

import corpus_pipeline
from ravelin.llm import fingerprints, kneser_ney, language_id, mixing, near_dedup, packing, quality_rules, recurrent_lm, token_counts, url_filters

ROWS = [(i, prose(i, 60), "en" if i % 2 else "fr", f"src{i % 3}") for i in range(30)] + ODD
LABELS = [(i, i % 5 != 0, 0) for i in range(30)] + [(None, True, 0), (3, None, None), (90, True, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in LABELS], "doc_id long, quality int, toxic int")


SMALL_LM = {"classes": 8, "slots": 8, "hidden": 4, "rounds": 1, "train_rate": 0.5}
OPERATORS = {
    "fingerprints": lambda d, lab: fingerprints.fingerprints(d, idf_lo=0.0), "classifier": kneser_ney.perplexities, "rules": quality_rules.rule_decisions, "language": lambda d, lab: language_id.language_spans(d),
    "mixing": lambda d, lab: mixing.mixing_decisions(d), "lm": lambda d, lab: recurrent_lm.document_log_likelihood(d, **SMALL_LM),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd, labels):
    got = OPERATORS[name](odd, labels).collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](odd.limit(0), labels).count() == 0
    assert OPERATORS[name](odd, labels.limit(0)).count() == len(ROWS)
    by = {r.doc_id: r for r in got}
    if name == "classifier":
        assert not by[90].keep and not by[91].keep and by[90].perplexity is None
    if name == "language":
        assert by[90].lang == by[91].lang == by[93].lang == "und" and by[90].spans == []
    if name == "lm":
        assert by[90].log_likelihood == 0 and by[90].bits_per_word is None and by[95].n_words == 60_000
    if name == "fingerprints":
        assert by[90].n_terms == 0 and by[90].fp0 is None


def test_packing_and_tokens_cover_all(odd):
    got = packing.pack(odd).collect()
    enc = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    assert sum(r.n_tokens for r in got) == sum(len(enc.spans(r[1])[0]) for r in ROWS if r[1])
    by_words = packing.pack(odd, vocabulary=None).collect()
    assert sum(r.n_tokens for r in by_words) == sum(len((r[1] or "").split()) for r in ROWS)
    assert [r.bin for r in got if r.doc_id == 90] == [None] and sum(r.doc_id == 94 for r in got) == 2
    assert packing.pack(odd.limit(0)).count() == 0
    t = token_counts.section_token_counts(odd)
    assert t.where("doc_id = 90").collect()[0].n_tokens == 0 and t.where("doc_id IS NULL").count() == 1 and t.where("doc_id = 94").count() == 2
    assert token_counts.section_token_counts(odd.limit(0)).count() == 0


def test_an_unbroken_text(spark, labels):
    """A third of a million signs without a blank, and as many blanks."""
    d = docs(spark, [(1, "ab" * 150_000, "en", "s"), (2, " " * 300_000, "en", "s"), (3, "\n" * 100_000, "en", "s"), (4, prose(1, 30), "en", "s")])
    for name, f in OPERATORS.items():
        assert f(d, labels).count() == 4, name
    assert {r.doc_id for r in packing.pack(d).collect()} == {1, 2, 3, 4} and near_dedup.near_duplicates(d).where("keep").count() == 4
    assert token_counts.section_token_counts(d).count() == 100_003


def test_packing_spreads_copies(spark, monkeypatch):
    monkeypatch.setattr(packing, "_COPIES", 7)
    got = packing.pack(docs(spark, [(5, prose(5, 40), "en", "s")] * 50 + [(6, prose(6, 40), "en", "s")]), capacity=256, shard_tokens=600).collect()
    assert sum(r.doc_id == 5 for r in got) == 50 and len({r.shard for r in got}) > 3


def test_near_dedup_edges(odd):
    got = near_dedup.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == len({r[0] for r in ROWS})
    assert all(r.keep for r in rows)
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 94").count() == 1 and kept.where("doc_id IS NULL").count() == 1 and kept.count() == len(ROWS) - 1
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0 and near_dedup.near_dedup(odd.limit(0)).count() == 0


def test_filters_keep_columns(odd, labels):
    assert quality_rules.keep_passing(odd, []).columns == odd.columns
    fluent = kneser_ney.keep_fluent(odd, odd, labels)
    assert fluent.columns == odd.columns and fluent.where("doc_id IN (90, 91, 92)").count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x", 0), (1, "http://A.com/x", 0), (None, "https://b.a.com", 0), (3, None, 0), (4, "nothing", 0), (5, "", 0), (6, "http://a.com/" + "y" * 50_000, 0)], "page_id long, url string, action int")
    rules = spark.createDataFrame([(2, "com,a,", "block"), (1, "com,a,", "first"), (3, "com,a,)/x", "keep"), (4, None, "z"), (5, "", "z")], "rule_id long, prefix string, action string")
    got = {(r.page_id, r.url_key and r.url_key[:12]): (r.rule_id, r.action, r.n_active) for r in url_filters.filter_urls(pages, rules).collect()}
    assert got[1, "com,a,)/x"] == (3, "keep", 3) and got[None, "com,a,b,)/"] == (1, "first", 2)
    assert got[3, None] == got[4, None] == got[5, None] == (None, "invalid", 0)
    assert url_filters.filter_urls(pages, rules).count() == 7 and url_filters.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.action for r in url_filters.filter_urls(pages, rules.limit(0)).collect()} == {"keep", "invalid"}


def test_pipeline_on_odd_rows(spark, odd, labels, tmp_path):
    for name, df in (("documents", odd.drop("score", "keep", "n_tokens")), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == now.columns
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
    assert {r.doc_id for r in now.collect()} <= {r[0] for r in ROWS} and now.count() > 0
