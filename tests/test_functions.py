import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import names, text
from ravelin.functions.json_repair import first_object


def test_name_key():
    assert names.name_key("Mme Hélène  DUPONT,", ("mme",)) == "helene dupont"
    assert names.name_key("ﬁn-de_test !") == "fin-de_test"
    assert names.name_key("!!!") == "" and names.name_key(None) is None


@pytest.mark.parametrize(("a", "b", "low", "high"), [("dupont", "duponts", 92, 93), ("a b", "b a", 100, 100), ("a b", "a b c", 100, 100), ("", "x", 0, 0), ("rouge", "vert", 0, 50)])
def test_token_set_ratio(a, b, low, high):
    assert low <= names.token_set_ratio(a, b) <= high


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_token_set_ratio_is_symmetric_and_bounded(a, b):
    assert names.token_set_ratio(a, b) == pytest.approx(names.token_set_ratio(b, a))
    assert 0 <= names.token_set_ratio(a, b) <= 100


@pytest.mark.parametrize(
    ("answer", "want"),
    [('```json\n{"a": 1}\n```', {"a": 1}), ('ok {"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', {"a": "x"}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ('{"a": 1} tail }', {"a": 1}), ('{"a": "[{", "b": 2', {"a": "[{", "b": 2})],
)
def test_first_object(answer, want):
    assert first_object(answer) == want


def test_first_object_needs_one():
    with pytest.raises(ValueError):
        first_object("[1, 2]")


def test_sections():
    md = "intro\n# A\n\n## B\nx\n### C\ny\n## D\nz\n```\n# not code\n```"
    assert text.sections(md) == [("", "intro"), ("A > B", "x"), ("A > B > C", "y"), ("A > D", "z\n```"), ("not code", "```")]


def test_passages_limits():
    whole = "p" * 3000
    assert text.passages(whole) == [("", whole)]
    assert len(text.passages("a" * 1250 + "\n\n" + "b" * 1250)) == 1
    assert len(text.passages("a" * 1251 + "\n\n" + "b" * 1250)) == 2
    assert len(text.passages("# A\n" + "a" * 300 + "\n# B\n" + "b" * 199)) == 1
    assert len(text.passages("# A\n" + "a" * 300 + "\n# B\n" + "b" * 200)) == 2
    assert text.passages(None) == [] and text.passages("") == []


@given(st.lists(st.text("ab", min_size=1, max_size=60), max_size=12))
def test_passages_keep_every_letter(paragraphs):
    got = "".join(t for _, t in text.passages("\n\n".join(paragraphs), limit=50, small=10))
    assert got.replace("\n", "") == "".join(paragraphs)


def test_html():
    got = text.html_to_markdown("<h2>T</h2><p>a <a href='/x'>l</a></p><ul><li>i<li>j</ul><table><tr><td>1<td>2</tr></table><script>s()</script>")
    assert "## T" in got and "l (/x)" in got and "- i" in got and "1 | 2" in got and "s()" in got
    assert "s()" not in text.html_to_markdown("<p>a</p><script>s()</script>", skip_script=True)


def test_kind_date_title_excerpt(spark):
    rows = [("CR_2024-03-05.md", "# Bilan\nx"), ("x.md", "le 20250131 et"), ("a_b.md", "2025.02.31 procédure"), ("y.md", "z" * 600 + "2024-01-01"), ("n.md", None)]
    df = spark.createDataFrame(rows, "nom string, t string")
    got = df.select(
        text.document_kind(F.col("nom"), F.col("t")).alias("k"), text.document_date(F.col("nom"), F.col("t")).alias("d"),
        text.document_title(F.col("t"), F.regexp_replace("nom", r"\.md$", "")).alias("title"), F.length(text.excerpt(F.col("t"), 400)).alias("n"),
    ).collect()
    assert [r.d for r in got] == ["2024-03-05", "2025-01-31", "2025-02-31", None, None]
    assert got[2].k == "procedure" and got[1].k == "document"
    assert [r.title for r in got[:3]] == ["Bilan", "x", "a b"]
    assert got[3].n == 401 and got[4].n is None
