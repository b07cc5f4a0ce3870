"""Cases of the findings of round 2: each failed before it was settled."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from corpusforge.functions import text as X
from corpusforge.operators import style as Y
from corpusforge.operators import verse as V
from corpusforge.operators import word_pairs as P
from corpusforge.plans import catalog
from tests.oracle import both

catalog.register()


def stored(spark, tmp_path, name, rows, schema):
    """A table in its own folder of tables, and DuckDB's view of it."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["form_distances", "zscore_features", "weighted_vectors"])
def test_texts_without_characters_have_no_rate(spark, tmp_path, name):
    texts = [(i, "Some Words, here and" + " there" * (i % 4) if i % 9 else "", f"src{i % 4}") for i in range(48)]
    con = stored(spark, tmp_path, "documents", [(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = both(spark, con, str(tmp_path), catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got == want and len(got) in (4, 6)


HYPHENS = "Ab-" * 60_000 + "c, D"


def exact(rows) -> list:
    """Rows that tell NaN from null."""
    return sorted((tuple("nan" if v != v else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["weighted_vectors", "zscore_features", "form_distances"])
@pytest.mark.parametrize("case", ["long word", "no words", "no texts", "all alike"])
def test_vectors_of_odd_texts(spark, tmp_path, name, case):
    """A word of many hyphens ended the JVM; sources without words or texts took the others' means."""
    odd = {"long word": lambda i, t: HYPHENS if i == 5 else t, "no words": lambda i, t: "12, 3" if i % 4 == 1 else t, "no texts": lambda i, t: None if i % 4 == 1 else t, "all alike": lambda i, t: "Some Words, here"}[case]
    texts = [(i, odd(i, "Some Words, here and" + " there" * (i % 5))) for i in range(48)]
    con = stored(spark, tmp_path, "documents", [(i, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = exact(catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == exact(con.execute(catalog.ORACLE_SQL[name]).fetchall()) != []


PAGES = [(1, "A &amp; B &amp"), (2, "x&amp;&amp;&am"), (3, "&quot;q&quot; z&quot"), (4, "a &amp;amp; b &nosuch; &")]


@pytest.mark.parametrize("name", ["page_text_extract", "page_titles"])
def test_references_without_semicolon_stay(spark, tmp_path, name):
    rows = [(i, f"https://h/{i}", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>one {t}</p></article></body></html>") for i, t in PAGES]
    con = stored(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    got, want = both(spark, con, str(tmp_path), catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got == want and len(got) == 4


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("numbered", [5, 40, 1 << 19])
@pytest.mark.parametrize("least", [1, 4])
def test_pair_scores_equal_all_pairs(spark, monkeypatch, numbered, least):
    texts = [(i, " ".join(f"w{'abcdefghijklmnop'[(i * j * j + j // 3) % (7 + i % 9)]}" for j in range(i * 5))) for i in range(24)] + [(99, None), (100, "one"), (101, "two two")]
    lists = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", X.lower_tokens("text").alias("words"))
    monkeypatch.setattr(P, "HELD", 20)
    want = Y.ppmi(Y.window_pairs(lists)).where(f"n >= {least}")
    got = P.pair_scores(lists, least=least, numbered=numbered)
    told = lambda df: sorted((r["x"], r["y"], r["n"], round(r["ppmi"], 9)) for r in df.collect())
    assert told(got) == told(want) != []


def test_ppmi_pairs_send_no_row_for_each_pair(spark):
    assert "hashpartitioning(x" not in plan_of(catalog.QUERIES["ppmi_pairs"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("words", [7, 60, 1 << 19])
def test_deals_are_even_whatever_the_ranges(spark, monkeypatch, words):
    """Chance by brute force over random orders, with lines that ranges share and lines longer than a range."""
    monkeypatch.setattr(V, "RANGE_WORDS", words)
    rng = random.Random(5)
    lines = [(p, i, " ".join(rng.choice(["bad", "big", "bold", "cut", "cap", "dim", "and", "oak"]) for _ in range(rng.choice([1, 2, 4, 6, 19])))) for p in ("x", None) for i in range(60)]
    got = {r["part"]: r for r in V.alliteration_against_chance(spark.createDataFrame(lines, "part string, line_no int, line string"), ["part"], ["line_no"], reps=60).collect()}
    for part in ("x", None):
        texts = [t.split() for p, _, t in lines if p == part]
        hits = lambda own: sum(max([len({w for w in l if w[0] == c}) for c in "bcd"]) >= 3 for l in own)
        urn, want = [w for l in texts for w in l], 0
        for _ in range(400):
            rng.shuffle(urn)
            at = iter(urn)
            want += hits([[next(at) for _ in l] for l in texts])
        assert got[part]["lines"] == 60 and got[part]["observed"] == pytest.approx(hits(texts) / 60)
        assert got[part]["chance"] == pytest.approx(want / 400 / 60, abs=0.025)


def test_deals_send_no_row_for_each_word(spark):
    made = plan_of(catalog.QUERIES["alliteration_against_chance"](spark, "/root/testdata/sf0.001"))
    assert "posexplode(words" not in made


def test_pair_scores_among_words_have_all_totals(spark):
    lists = spark.createDataFrame([(1, "a b c a b d a c b a"), (2, "c c a e b")], "doc_id long, text string").select("doc_id", X.lower_tokens("text").alias("words"))
    want = Y.ppmi(Y.window_pairs(lists)).where("x in ('a', 'b', 'c') and y in ('a', 'b', 'c')")
    told = lambda df: sorted((r["x"], r["y"], r["n"], round(r["ppmi"], 9)) for r in df.collect())
    assert told(P.pair_scores(lists, among=["a", "b", "c", "nowhere"])) == told(want) != []


def test_leading_vectors_of_a_flat_spectrum():
    """More steps than a basis holds, values close to each other, and a matrix of low rank."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(900, 700))
    values, vectors = Y.leading(lambda q: m.T @ (m @ q), 700, 20)
    assert np.allclose(values, np.linalg.svd(m)[1][:20] ** 2) and np.allclose(m.T @ (m @ vectors), vectors * values, atol=1e-4)
    low = m[:, :3] @ rng.normal(size=(3, 700))
    assert np.allclose(Y.leading(lambda q: low.T @ (low @ q), 700, 5)[0][3:], 0, atol=1e-3)


def test_word_space_runs_few_jobs(spark):
    """The solver asked for a job for each product with one vector."""
    sc = spark.sparkContext
    sc.setJobGroup("word space", "word space")
    try:
        assert catalog.QUERIES["word_space_neighbours"](spark, "/root/testdata/sf0.001").count() > 0
        assert len(sc.statusTracker().getJobIdsForGroup("word space")) < 150
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
