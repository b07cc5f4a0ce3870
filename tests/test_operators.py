"""Operators on small tables: edge cases, ties, nulls, and what the supplied tables can't show."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import docs as D
from corpusforge.operators import entities as E
from corpusforge.operators import geo
from corpusforge.operators import graph as G
from corpusforge.operators import stats as S
from corpusforge.operators import style as Y
from corpusforge.operators import tokens as T
from corpusforge.operators import verse as V
from corpusforge.plans import lookup
from corpusforge.sources import epub, sinks, web
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_shingles_of_short_texts(spark):
    assert one(spark, X.shingles(F.lit("one two"))) == ["one two"]
    assert one(spark, X.shingles(F.lit("..."))) == [""]
    assert one(spark, X.shingles(F.lit("a b c d e f a b c d e"))) == ["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"]


def test_html_to_text_keeps_breaks_and_steps(spark):
    html = "<p>One<br>\n  two</p><script>x()</script><div>&nbsp;&lt;b&gt; &amp;amp;</div>"
    assert one(spark, X.html_to_text(F.lit(html))) == "One\n   two\n\n <b> &amp;"
    assert one(spark, X.html_to_text(F.lit("<p>   a</p><p>     b</p>"))) == "a\n\n  b"
    assert one(spark, X.html_to_text(F.lit('a<br class="x"/>b<BR clear=all>c<broken>d</br>'))) == "a\nb\ncd"
    assert one(spark, X.html_to_text(F.lit("x &mdash; &laquo;y&raquo; &#8212;&#x2014; &#150; &nosuch; &amp;lt; a&b &"))) == "x — «y» —— – &nosuch; &lt; a&b &"
    assert one(spark, X.html_to_text(F.lit("<!-- <p> --><h2>t</h2><li>a<li>b<blockquote>c</blockquote>  <style>p{}</style>"))) == "t\n\na\n\nb\n\nc"
    assert one(spark, X.html_to_text(F.lit(""))) == "" and one(spark, X.html_to_text(F.lit(None).cast("string"))) is None


def test_unescape_equals_the_standard(spark):
    import html

    for t in ("&eacute;&copy &amp &#233;&#xE9;", "&#0;&#128;&#xD800;&#x110000;", "&lt;&gt;&quot;&apos;&nbsp;", "no reference", "&hellip;&hearts;&Aacute"):
        assert one(spark, X.unescape(F.lit(t))) == html.unescape(t).replace("\u0000", ""), t


def test_urls_and_ids(spark):
    assert one(spark, X.section_of(F.lit("https://h.org/a/b"))) == "a"
    assert one(spark, X.section_of(F.lit("https://h.org/a"))) is None
    assert one(spark, X.joined_url(F.lit("https://h.org/a/b.html"), F.lit("c/#x"))) == "https://h.org/a/c"
    assert one(spark, X.joined_url(F.lit("https://h.org/a/b.html"), F.lit("/c"))) == "https://h.org/c"
    import uuid

    assert one(spark, X.uuid5(F.lit("https://example.org/é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/é"))


def test_dates(spark):
    assert one(spark, D.year_of(F.lit("long text\nthe 1970s\n12 May 1972"))) == 1972
    assert one(spark, D.year_of(F.lit("written in 1999"))) is None
    assert one(spark, X.date_line(F.lit("  12 May 1972"))) and not one(spark, X.date_line(F.lit("In May of 1972 we left the town")))


def test_plural_and_snippet(spark):
    assert [one(spark, X.plural(F.lit(n), "год", "года", "лет")) for n in (1, 2, 5, 11, 12, 21, 104)] == ["год", "года", "лет", "лет", "лет", "год", "года"]
    assert one(spark, X.snippet(F.lit("aaa bbb ccc ddd eee"), F.lit(9), 4)) == "ccc"


def test_language_genre(spark):
    assert one(spark, D.language(F.lit("да no"))) == "ru"
    assert one(spark, D.genre(F.lit("a\nb\nc"))) == "prose"
    assert one(spark, D.genre(F.lit("a\nb\n\nc\nd"))) == "poetry"


def test_stanzas_blocks_and_runs(spark):
    lines = T.line_table(texts(spark, "\n\na\nb\n\n\nc\n", "\n"), ["doc_id"])
    got = rows(T.with_stanzas(lines, ["doc_id"]).select("line", "stanza_no"))
    assert got == [("a", 0), ("b", 0), ("c", 1)]
    long = T.with_stanzas(T.line_table(texts(spark, "\n".join("x" * 13) + "\n\ny"), ["doc_id"]), ["doc_id"])
    assert rows(T.with_blocks(long, ["doc_id"]).groupBy("block_no").count()) == [(0, 12), (1, 1), (2, 1)]


def test_exact_and_near_duplicates(spark):
    base = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    near = base + " more"
    d = texts(spark, base, base.replace(" ", "\n"), near, "short one", "short one!", "")
    assert [r["doc_id"] for r in D.exact_dedup(d, ["doc_id"]).orderBy("doc_id").collect()] == [0, 2, 3, 4, 5]
    assert [(r["a"], r["b"]) for r in D.similar_pairs(d).collect()] == [(0, 2)]
    assert sorted(r["doc_id"] for r in D.drop_near_duplicates(d).collect()) == [2, 3, 5]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for _ in range(60):
        w = rng.choice(docs).split() if docs and rng.random() < 0.6 else ["".join(rng.choices("abc", k=3)) for _ in range(rng.randint(3, 60))]
        w = list(w)
        for _ in range(rng.randint(0, 1)):
            w[rng.randrange(len(w))] = "zz"
        docs.append(" ".join(w))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (d.split() for d in docs)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r["a"], r["b"]) for r in D.similar_pairs(texts(spark, *docs), 0.7).collect()} == want


def test_coverage_and_merge(spark):
    site = texts(spark, "a b c d e f g")
    added = spark.createDataFrame([(10, "a b c d e f"), (11, "x y z u v w"), (12, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["coverage"] for r in D.coverage(added, site, "doc_id").collect() if r["doc_id"] < 12} == {10: 1.0, 11: 0.0}
    assert sorted(r["doc_id"] for r in D.merge_uncovered(site, added, "doc_id").collect()) == [0, 11, 12]
    always = spark.createDataFrame([(10,)], "id long")
    assert 10 in [r["doc_id"] for r in D.merge_uncovered(site, added, "doc_id", always=always).collect()]


def test_footnotes_in_order_of_mention(spark):
    notes = spark.createDataFrame([(0, "1", "one"), (0, "2", "two"), (0, "9", "nine")], "doc_id long, ref string, note string")
    got = D.footnotes(texts(spark, "see [2] and [1], again [2]"), notes).first()
    assert [(n["ref"], n["note"]) for n in got["notes"]] == [("2", "two"), ("1", "one")]


def test_headings_and_excerpts(spark):
    lines = T.line_table(texts(spark, "# A\na1\na2\n# B\nb1"), ["doc_id"])
    got = D.between_headings(lines, ["doc_id"], F.col("line").startswith("#"), F.col("line") == "# A")
    assert [r["line"] for r in got.orderBy("line_no").collect()] == ["a1", "a2"]
    with pytest.raises(ValueError):
        D.require_none(texts(spark, "x"), "left over")


def test_mattr_equals_brute_force(spark):
    rng = random.Random(2)
    w = [rng.choice("abcdefgh") for _ in range(300)]
    t = spark.createDataFrame([(0, i, x) for i, x in enumerate(w)] + [(1, 0, "a")], "doc int, pos int, word string")
    got = {r["doc"]: r["mattr"] for r in S.mattr(t, ["doc"], 50).collect()}
    assert got[0] == pytest.approx(np.mean([len(set(w[i : i + 50])) / 50 for i in range(251)])) and got[1] is None


def test_smoothing_at_edges(spark):
    c = spark.createDataFrame([(1, "a", 4), (1, "b", 0), (2, "a", 0), (2, "b", 0)], "y int, p string, n int")
    got = {(r["y"], r["p"]): r["share"] for r in S.smoothed_shares(c, "y", "p").collect()}
    assert got[1, "a"] == 1.0 and got[2, "b"] == 0.0


def test_ranks_share_the_best_place(spark):
    m = spark.createDataFrame([("a", 1.004), ("b", 1.001), ("c", 0.5)], "k string, v double")
    assert {r["k"]: r["rank"] for r in S.ranked(m, "v").collect()} == {"a": 1, "b": 1, "c": 3}


def test_profiles_and_metre(spark):
    assert one(spark, V.profile(F.lit("м+ой д+ядя, и кот дом+а непонятно"))) == "sSuxxuSxxxx"
    assert one(spark, V.fits(F.lit("usuS"), 2, 1)) and one(spark, V.fits(F.lit("suuS"), 2, 1)) and not one(spark, V.fits(F.lit("Su"), 2, 1)) and not one(spark, V.fits(F.lit("usus"), 2, 1))
    assert one(spark, V.intervals(F.lit("SuuSxsS"))) == [2, 1, 0]
    assert one(spark, V.feet(F.lit("uSuSu"), 2, 1)) == 2 and one(spark, V.feet(F.lit("suuu"), 2, 1)) == 1
    lines = [(0, p) for p in ("uSuSuSuS", "uSuSuSuSu", "uSuuuSuS", "xSuSuSxs")] + [(1, p) for p in ("SuuSuSuu", "uSuSuuS", "SuSuuS")] + [(2, "uSuS"), (2, "uSuS")]
    t = spark.createDataFrame(lines, "poem int, profile string")
    assert rows(V.classify_metre(t, ["poem"])) == [(0, 4, "iamb", 4), (1, 3, "dolnik", None)]


def test_clausula_and_rhyme(spark):
    def kind(a, b):
        return one(spark, V.rhyme_type(V.clausula(F.lit(a)), V.clausula(F.lit(b))))

    assert kind("в+етер", "в+етер") is None
    assert kind("крут+я", "дит+я") == "exact"
    assert kind("занем+ог", "не м+ог") == "exact"
    assert kind("пр+авил", "заст+авил") == "exact"
    assert kind("в+ечер", "в+етер") == "inexact" and kind("б+ыл", "м+ил") == "exact"
    assert kind("н+очь", "б+ой") is None and kind("к+от", "с+он") is None and kind("рук+а", "стак+ан") is None
    assert kind("рук+а", "семь+я") == "assonance" and kind("рук+а", "рек+а") == "exact" and kind("с+иний", "д+ини") == "inexact"
    assert kind("м+ост", "хв+ост") == "exact" and kind("ст+ол", "п+олк") is None and kind("друж+ок", "сн+ег") is None
    assert one(spark, V.clausula(F.lit("непонятно"))) is None and one(spark, V.clausula(F.lit("мой свет непонятно"))) is None
    c = one(spark, V.clausula(F.lit("когд+а бы, где же")))
    assert (c["last"], c["after"], c["compound"], c["support"]) == ("же", 3, True, "д")
    c = one(spark, V.clausula(F.lit("ещё")))
    assert (c["key"], c["support"]) == ("о", "щ") and one(spark, V.clausula(F.lit("семь+я")))["support"] == "м"


def test_quatrain_schemes(spark):
    lines = spark.createDataFrame([(p, i, 0) for p in range(4) for i in range(4)], "poem int, line_no int, stanza_no int")
    found = [(0, 0, 3), (0, 1, 2), (1, 0, 2), (1, 1, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    pairs = spark.createDataFrame(found, "poem int, i int, j int").withColumn("type", F.lit("exact"))
    got = {r["poem"]: (r["letters"], r["scheme"]) for r in V.quatrain_schemes(pairs, lines, ["poem"]).collect()}
    assert got == {0: ("ABBA", "ABBA"), 1: ("ABAB", "ABAB"), 2: ("AAAA", "other"), 3: ("----", "none")}


def test_stressed_verse_end_to_end(spark):
    poems = (("мой д+ядя с+амых ч+естных пр+авил", "когд+а не в ш+утку занем+ог", "он уваж+ать себ+я заст+авил", "и л+учше в+ыдумать не м+ог"), ("б+уря мгл+ою н+ебо кр+оет", "в+ихри сн+ежные крут+я", "т+о как зв+ерь он+а зав+оет", "т+о запл+ачет к+ак дит+я"))
    t = spark.createDataFrame([(p, i, 0, x) for p, poem in enumerate(poems) for i, x in enumerate(poem)], "poem int, line_no int, stanza_no int, line string")
    assert rows(V.classify_metre(t.withColumn("profile", V.profile("line")), ["poem"])) == [(0, 4, "iamb", 4), (1, 4, "trochee", 4)]
    ends = t.withColumn("c", V.clausula("line"))
    pairs = V.rhyme_pairs(ends, ["poem"])
    assert rows(V.quatrain_schemes(pairs, ends, ["poem"]).select("poem", "scheme")) == [(0, "ABAB"), (1, "ABAB")]
    poems_ = spark.createDataFrame([(0, 1), (1, 1)], "poem int, per int")
    tables = {(r["table"], r["key"]): r["n"] for r in V.rhyme_tables(ends, pairs, poems_, ["poem"], "per").collect()}
    assert tables["type", "exact"] == 8 and tables["scheme", "ABAB"] == 2 and tables["ending", "0"] == 4


def test_alliteration_against_chance(spark):
    t = spark.createDataFrame([(0, i, line) for i, line in enumerate(["bad big bold", "cut cap cod", "dim dog den"] * 4)], "part int, line_no int, line string")
    r = V.alliteration_against_chance(t, ["part"], ["line_no"], reps=5).first()
    assert (r["lines"], r["observed"]) == (12, 1.0) and 0 < r["chance"] < 0.6
    again = V.alliteration_against_chance(t, ["part"], ["line_no"], reps=5).first()
    assert again["chance"] == r["chance"]
    alike = spark.createDataFrame([(0, i, f"bat{chr(97 + i)} bit{chr(97 + i)} but{chr(97 + i)} of") for i in range(9)], "part int, line_no int, line string")
    assert V.alliteration_against_chance(alike, ["part"], ["line_no"], reps=3).first()["chance"] == 1.0


def test_shuffled_baseline_is_a_permutation(spark):
    t = spark.createDataFrame([(0, i, f"w{i}") for i in range(20)], "p int, pos int, word string")
    got = V.shuffled_baseline(t, ["p"], reps=2)
    assert rows(got) == rows(V.shuffled_baseline(t, ["p"], reps=2))
    assert sorted(r["word"] for r in got.where("rep = 1").collect()) == sorted(f"w{i}" for i in range(20))


def test_change_points(spark):
    t = spark.createDataFrame([(i, 0.0 if i < 5 else 9.0) for i in range(10)], "y int, v double")
    found = Y.change_points(t, "y", ["v"])
    assert found[0]["at"] == 5 and found[0]["explained"] == pytest.approx(1.0) and len(found) == 1
    assert Y.change_points(t.limit(0), "y", ["v"]) == []


def test_adjusted_rand(spark):
    t = spark.createDataFrame([(i, i % 2, (i % 2) + 7) for i in range(10)], "id int, a int, b int")
    assert Y.adjusted_rand(t, "a", "b").first()["ari"] == pytest.approx(1.0)


def test_word_vectors_and_layouts(spark):
    pairs = spark.createDataFrame([("a", "b", 5), ("b", "a", 5), ("c", "d", 5), ("d", "c", 5)], "x string, y string, n long")
    v = Y.word_vectors(Y.ppmi(pairs), spark.createDataFrame([(w,) for w in "abcd"], "w string"), rank=2)
    assert v.count() == 4
    assert Y.t_sne(np.random.default_rng(0).normal(size=(12, 4)), perplexity=3, iterations=20).shape == (12, 2)
    two = spark.createDataFrame([(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b], "src string, dst string, w double")
    got = {r["node"]: r["cluster"] for r in Y.spectral_clusters(two, 2).collect()}
    assert len({got[x] for x in "abcd"}) == 1 and got["a"] != got["w"]


def test_graph_operators(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "a", 2), ("b", "c", 1), ("x", "y", 1), ("z", "z", 4)], "src string, dst string, w int")
    assert rows(G.strong_edges(e)) == [("a", "b", 3), ("b", "c", 1), ("x", "y", 1)]
    label = {r["node"]: r["label"] for r in G.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert label == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0
    two = spark.createDataFrame([(a, b, 1) for g in ("abc", "xyz") for a in g for b in g if a < b], "src string, dst string, w int")
    assert rows(G.families(G.label_propagation(two))) == [("a", 3), ("x", 3)]
    assert {r["node"]: r["hop"] for r in G.ego(e, "a").collect()} == {"a": 0, "b": 1, "c": 2}


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["label"] for r in G.components(chain).collect()} == {0}


def test_morphology_tables(spark):
    d = spark.createDataFrame([("красный", "красный", "ADJF", ["Qual"], 1, "nomn", "sing", "masc"), ("дом", "дом", "NOUN", ["inan"], 1, "nomn", "sing", "masc"), ("дома", "дом", "NOUN", ["inan"], 1, "gent", "sing", "masc")], "form string, lemma string, pos string, grammemes array<string>, ord int, case string, number string, gender string")
    t = spark.createDataFrame([(0, 0, 0, "красный"), (0, 0, 1, "дом"), (0, 1, 2, "Неизвестно")], "doc int, line_no int, pos int, word string")
    got = E.annotate(t, d.select("form", "lemma", "pos", "grammemes", "ord"))
    assert {r["word"]: (r["lemma"], r["tag"]) for r in got.collect()} == {"красный": ("красный", "ADJF"), "дом": ("дом", "NOUN"), "Неизвестно": ("неизвестно", None)}
    full = t.join(d.select(F.col("form").alias("word"), "lemma", F.col("pos").alias("tag"), "case", "number", "gender"), "word")
    assert rows(E.epithets(full, ["doc"])) == [("красный", "дом", 1)]
    empty = spark.createDataFrame([], "lemma string")
    assert E.content_lemmas(got, empty, empty, ["NOUN"], ["Geox"]).count() == 1


def test_genitives_and_line_boundaries(spark):
    t = spark.createDataFrame([(0, 0, 0, "стены", "стена", "NOUN", "nomn", "plur"), (0, 0, 1, "дома", "дом", "NOUN", "gent", "sing"), (0, 0, 2, "белый", "белый", "ADJF", "nomn", "sing"), (0, 1, 3, "снег", "снег", "NOUN", "nomn", "sing")], "doc int, line_no int, pos int, word string, lemma string, tag string, case string, number string")
    assert rows(E.genitive_pairs(t, ["doc", "line_no"]).select("noun", "genitive")) == [("стены", "дома")]
    assert rows(E.line_boundaries(t, ["doc"]).select("last", "first", "kind")) == [("белый", "снег", "attribute")]


def test_alias_parts_and_contexts(spark):
    t = spark.createDataFrame([(0, 0, "Anna"), (0, 1, "Berg"), (0, 2, "Berg"), (0, 3, "Anna")], "doc int, pos int, word string")
    named = spark.createDataFrame([(0, 0, "anna", "person", ["Name"]), (0, 1, "berg", "person", ["Surn"]), (0, 5, "berg", "person", ["Surn"]), (0, 9, "anna", "person", ["Name"]), (1, 0, "ivan", "person", ["Name"]), (1, 1, "petrovich", "person", ["Patr"]), (1, 7, "ivan", "person", ["Name"])], "doc int, pos int, lemma string, kind string, grammemes array<string>")
    assert rows(E.drop_parts(named, ["doc"]).select("doc", "pos", "lemma", "kind")) == [(0, 1, "berg", "person"), (0, 5, "berg", "person"), (0, 9, "anna", None), (1, 0, "ivan", "person"), (1, 7, "ivan", "person")]
    al = spark.createDataFrame([("Berg", "Mount")], "alias string, name string")
    assert {r["word"] for r in E.with_alias(t, al).collect()} == {"Anna", "Mount"}
    occ = spark.createDataFrame([("w", d, 0, "line " + "x" * d) for d in range(20)], "word string, doc int, line_no int, line string")
    assert [r["doc"] for r in E.contexts(occ).orderBy("doc").collect()] == [0, 5, 11]


def test_map_elements(spark):
    rows_ = spark.createDataFrame([({"building": "yes", "name": "A"}, 45.0, 12.0), ({"natural": "water"}, 45.0, 12.0), ({"building": "no"}, 50.0, 12.0)], "tags map<string,string>, lat double, lon double")
    assert [r["l"] for r in rows_.select(geo.layer().alias("l")).collect()] == ["building", "water", None]
    assert web.map_elements(rows_, {"name": "(?i)^a"}, (44, 11, 46, 13)).count() == 1
    ring = spark.createDataFrame([([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], "geometry array<struct<lat:double,lon:double>>")
    assert [r["s"] for r in ring.select(geo.shape().alias("s")).collect()] == ["polygon", "line"]
    p = spark.createDataFrame([("a", 1.001, 2.0), ("b", 1.0, 2.0)], "key string, lat double, lon double")
    assert [r["key"] for r in geo.mismatched_places(p, p.where("key = 'a'")).collect()] == ["b"]


def test_web_sources(spark, tmp_path):
    s = spark.createDataFrame([("<urlset><url><loc>https://h/a&amp;b</loc></url><url><loc> https://h/c </loc></url></urlset>",)], "xml string")
    assert rows(web.sitemap_urls(s)) == [(0, "https://h/a&b"), (1, "https://h/c")]
    raw = spark.createDataFrame([("привет".encode("cp1251"),), ("привет".encode(),), (None,)], "raw binary")
    assert [r["t"] for r in raw.select(web.decoded("raw").alias("t")).collect()] == ["привет", "привет", None]
    p = spark.createDataFrame([(0, "<article><h1>T</h1><p>Body text here</p></article>"), (1, "<p>x</p>"), (2, "<article><h1>L</h1><p><a href='x'>all of it is links</a></p></article>")], "page_id int, html string")
    assert [r["reason"] for r in web.extracted(p).orderBy("page_id").collect()] == [None, "no article with a heading", "listing"]
    m = spark.createDataFrame([('{"p1": {"3": ["red", "n", "word", "2"]}}',)], "json string")
    assert rows(web.colour_marks(m)) == [("p1", 3, "red", "n", "word", 2)]
    assert rows(web.fetched(spark.createDataFrame([("u",)], "url string"), lambda u: b"x").select("url")) == [("u",)]
    web.jsonl  # read back what the sink writes
    sinks.write_jsonl(spark.createDataFrame([("u", "s", "t", "é", False, None, None)], web.DOCUMENT), str(tmp_path / "j"))
    assert web.jsonl(spark, str(tmp_path / "j")).first()["text"] == "é"
    (tmp_path / "c.xml").write_text("<c><item><author>A</author><text>T</text><date_from>1970</date_from></item></c>")
    assert web.xml_corpus(spark, str(tmp_path / "c.xml")).first()["author"] == "A"


def test_stress_and_alignment(spark):
    t = spark.createDataFrame([("Дом",), ("река",)], "word string")
    d = spark.createDataFrame([("дом", "д+ом")], "form string, stressed string")
    assert {r["word"]: r["stressed"] for r in web.with_stress(t, d).collect()} == {"Дом": "д+ом", "река": None}
    assert {r["stressed"] for r in web.with_stress(t, d, lambda w: w + "!").collect()} == {"д+ом", "река!"}
    raw = spark.createDataFrame([("p", 0, "a"), ("q", 0, "b")], "pid string, line_no int, line string")
    acc = spark.createDataFrame([("p", 0, "+a"), ("q", 0, "+b"), ("q", 1, "c")], "pid string, line_no int, line string")
    assert [r["accented"] for r in web.zip_aligned(raw, acc).collect()] == ["+a"]


def test_epub_round_trip(spark, tmp_path):
    path = str(tmp_path / "Vol 3.epub")
    epub.write_epub(path, "Book", [{"section": "S", "period": None, "title": "One & two", "text": "a\nb\n\nc"}, {"section": "S", "period": "P", "title": "Three", "text": "d"}], "id-1")
    with zipfile.ZipFile(path) as z:
        assert z.namelist()[0] == "mimetype"
    got = epub.read_epubs(spark, path).collect()
    assert [(r["label"], r["vol"]) for r in got] == [("One & two", 3), ("Three", 3)] and "a<br/>b" in got[0]["html"]
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(KeyError):
        epub.segments(broken.getvalue())


def test_sinks(spark):
    assert sinks.embed_json("<script>X</script>", "X", {"a": "</b>"}) == '<script>{"a":"<\\/b>"}</script>'
    with pytest.raises(ValueError):
        sinks.embed_json("XX", "X", 1)
    d = spark.createDataFrame([("w", "w"), ("v", "V")], "word string, display string")
    assert rows(sinks.compact_index(d)) == [("v", "V"), ("w", None)]
    sinks.check_counts(d, {"word = 'w'": 1})
    with pytest.raises(ValueError):
        sinks.check_counts(d, {"word = 'w'": 2})


def test_lookups(spark):
    m = spark.createDataFrame([("1990", "iamb", 3), ("1990", "dolnik", 1)], "p string, metre string, lines int")
    assert rows(lookup.metre_families(m, {"iamb": "classical"}, "p")) == [("1990", "classical", 3, 75.0), ("1990", "other", 1, 25.0)]
    t = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b")], "per string, word string")
    assert rows(lookup.rate_series(t, "a", "per", 10.0)) == [("p", 1, 5.0), ("q", 0, 0.0)]
    lines = spark.createDataFrame([(0, 0, "Winters pass"), (0, 1, "none")], "doc_id int, line_no int, line string")
    assert lookup.highlighted_examples(lines, "winter").first()["line"] == "<b>Winters</b> pass"
    s = spark.createDataFrame([("a", 3, 2), ("b", 1, 1)], "word string, n int, texts int")
    e = spark.createDataFrame([("a", "b", 2)], "src string, dst string, w int")
    c = spark.createDataFrame([("a", 0, "line")], "word string, doc int, line string")
    card = lookup.entity_card(s, e, c, "a").first()
    assert card["neighbours"][0]["name"] == "b" and card["examples"][0]["line"] == "line"


def test_trimmed_paragraph(spark):
    p = "One here. Two here. Three hit. Four here. Five here. Six here."
    assert one(spark, D.trimmed(F.lit(p), "hit", 1, 20)) == "Two here. Three hit. Four here."
    assert one(spark, D.trimmed(F.lit(p), "hit", 1, 2000)) == p


def test_unique_pairs_share_what_they_have_seen(spark):
    t = spark.createDataFrame([("a", "b", "long", 0), ("b", "a", "rich", 1), ("c", "d", "rich", 1)], "x string, y string, list string, priority int")
    assert rows(S.unique_pairs(t, "x", "y", "list", "priority", 5).select("list", "x")) == [("long", "a"), ("rich", "c")]


def test_free_images(spark):
    t = spark.createDataFrame([("A", "CC BY-SA 4.0", "image/jpeg", 1200, "<a>User: Ann</a>"), ("B", "fair use", "image/jpeg", 1200, ""), ("C", "CC0", "image/png", 10, "")], "title string, licence string, mime string, width int, author string")
    assert [(r["title"], r["author"]) for r in web.free_images(t).collect()] == [("A", "Ann")]


def test_new_files_are_processed_once(spark, tmp_path):
    from corpusforge.streaming.resume import process_new_files

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i in range(2):
        spark.createDataFrame([(i,)], "x int").write.mode("append").parquet(source)
        process_new_files(spark, source, spark.createDataFrame([], "x int").schema, lambda df: df.withColumn("y", F.col("x") + 1), out, mark)
    assert sorted(r["y"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_corpora(spark):
    t = spark.createDataFrame([("ru", "poetry", "own", "A poem"), ("ru", "prose", "own", "A poem"), ("ru", "prose", "own", "Essay"), ("en", "poetry", "own", "E"), ("ru", "poetry", "about", "X")], "lang string, genre string, author string, title string")
    c = D.corpora(t)
    assert {k: v.count() for k, v in c.items()} == {"own": 3, "poetry": 1, "prose": 1, "other": 1}


def test_tags_and_features(spark):
    t = spark.createDataFrame([("p", "NOUN", "Рим", "рим", ["Geox"]), ("p", "NOUN", "дом", "дом", []), ("p", "VERB", "идёт", "идти", []), ("p", None, "x", "x", [])], "per string, tag string, word string, lemma string, grammemes array<string>")
    got = {r["tag"]: (r["n"], r["nouns_per_verb"]) for r in S.tag_shares(t, ["per"]).collect()}
    assert got == {"NOUN": (2, 2.0), "VERB": (1, 2.0)}
    assert [r["lemma"] for r in S.tagged_counts(t, "Geox", ["per"]).collect()] == ["рим"]
    cards = spark.createDataFrame([(12, 1, 20.0, None, "iamb"), (12, None, 1.0, 1.0, "free"), (3, 1, 1.0, 1.0, "free")], "lines int, period int, sentence_lines double, nouns_per_verb double, metre string")
    assert rows(S.cluster_features(cards).select("sentence_lines", "nouns_per_verb", "classical", "free")) == [(15.0, 2.5, 1.0, 0.0)]


def test_verse_examples(spark):
    t = spark.createDataFrame([("uSuSuSuS", "мой д+ом стоит на берег+у рек+и"), ("uSuuuSuS", "а эт+от стих не весь удар+ен зд+есь")], "profile string, line string")
    assert [r["profile"] for r in V.metre_examples(t, "iamb").collect()] == ["uSuSuSuS"]
    p = spark.createDataFrame([("exact", "кровь", "любовь"), ("exact", "любовь", "кровь"), ("exact", "ты", "мы")], "type string, word_i string, word_j string")
    assert rows(V.rhyme_examples(p, "exact")) == [("кровь", "любовь", 2)]


def test_more_lookups(spark):
    c = spark.createDataFrame([(1990, "red", 3), (1991, "red", 1), (1991, "blue", 4), (2000, "red", 9)], "y int, hue string, n int")
    assert rows(lookup.palette(c, 1990, 1995)) == [("blue", 4, 50.0), ("red", 4, 50.0)]
    d = spark.createDataFrame([(1990, 1995, 1.0), (1996, 1999, 1.0)], "a int, b int, distance double")
    assert [r["crosses"] for r in lookup.distance_map(d, [1994]).orderBy("a").collect()] == [True, False]
    r = spark.createDataFrame([("b", 1.5), ("c", 0.5)], "letter string, ratio double")
    assert rows(lookup.consonant_excess(r, 1)) == [("b", 50.0)]
    s = spark.createDataFrame([("like", "p", 2.0), ("as", "p", 1.0)], "kind string, per string, per_1000 double")
    assert rows(lookup.simile_series(s, "like", "per")) == [("p", 2.0)]


def test_kinds_by_tags(spark):
    def occ(lemma, votes, tags):
        return [(lemma, v, tags) for v in votes]

    data = occ("rome", ["prep"] * 5, ["Geox"]) + occ("paris", ["person"] * 3 + ["prep"], ["Geox"]) + occ("vladimir", [None, None, "person"], ["Geox", "Name"]) + occ("elba", ["prep", None], ["Geox", "Surn"]) + occ("john", [None], ["Name"]) + occ("smith", ["person"] * 2 + [None] * 8, []) + occ("styx", ["prep"] * 3, []) + occ("table", [None] * 4, []) + occ("god", ["person"] * 4, [])
    voted = spark.createDataFrame(data, "lemma string, vote string, grammemes array<string>")
    proper = spark.createDataFrame([("styx", 1.0), ("table", 0.1)], "lemma string, capitalised double")
    got = {r["lemma"]: r["kind"] for r in E.kinds_by_tags(voted, proper, ["table"], {"god": "sacred"}).collect()}
    assert got == {"rome": "place", "paris": "person", "vladimir": "person", "elba": "place", "john": "person", "smith": "person", "styx": "place", "table": None, "god": "sacred"}
    forms = spark.createDataFrame([("rim", "Rima", False)] * 5 + [("rim", "Rimu", True)] * 3 + [("dom", "dom", False)] + [("dom", "doma", False)] * 9, "lemma string, word string, nominative boolean")
    assert rows(E.display_forms(forms)) == [("dom", "dom"), ("rim", "Rimu")]
    pairs = spark.createDataFrame([("a", "b", "A b")] * 2 + [("a", "b", "a b")], "x string, y string, surface string")
    assert rows(E.pair_surfaces(pairs, ["x", "y"])) == [("a", "b", "A b", 2)]


def test_families_and_chords(spark):
    t = spark.createDataFrame([(a, b, 2.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 1.0)], "src string, dst string, w double")
    labels = {r["node"]: r["label"] for r in G.family_labels(t).collect()}
    assert len({labels[n] for n in "abc"}) == len({labels[n] for n in "xyz"}) == 1 and labels["a"] != labels["x"]
    arcs = {r["node"]: r for r in G.chord_arcs(t, spark.createDataFrame([(n, 0 if n in "abc" else 1) for n in "abcxyz"], "node string, cluster int")).collect()}
    widths = [arcs[n]["stop"] - arcs[n]["start"] for n in "abcxyz"]
    assert sum(widths) == pytest.approx(2 * np.pi - 0.06) and arcs["c"]["start"] == pytest.approx(-np.pi / 2) and widths[2] == pytest.approx(widths[0] * 5 / 4)
    ribbons = G.chord_ribbons(t, G.chord_arcs(t, spark.createDataFrame([(n, 0) for n in "abcxyz"], "node string, cluster int"))).collect()
    ends = sorted((x, r[f"{x}_start"], r[f"{x}_stop"]) for r in ribbons for x in ("src", "dst"))
    assert len(ribbons) == 7 and sum(b - a for _, a, b in ends) == pytest.approx(2 * np.pi)


def test_running_total_over_ranges(spark):
    t = spark.createDataFrame([(i % 3, i, i * 7 % 11) for i in range(200)], "g int, k int, v int").repartition(5)
    want, sums = {}, {}
    for i in range(200):
        want[i] = sums.get(i % 3, 0)
        sums[i % 3] = want[i] + i * 7 % 11
    assert {r["k"]: r["before"] for r in S.running_total(t, ["g"], ["k"], "v", "before").collect()} == want
    alone = S.running_total(t, [], ["k"], "v", "before")
    assert {r["k"]: r["before"] for r in alone.collect()} == {i: sum(j * 7 % 11 for j in range(i)) for i in range(200)}


def test_articles_and_reports(spark):
    page = "<article>no heading</article><article><h1>A &amp; B</h1><nav>menu</nav><div class='content'><p>One<br/>two</p><div>inner</div></div></article>"
    d = spark.createDataFrame([(1, page), (2, "<p>x</p>"), (3, "<article><h1>L</h1><a href=x>all links here</a></article>"), (4, None)], "page_id long, html string")
    got = {r["page_id"]: (r["title"], r["text"], r["reason"]) for r in web.extracted(d).collect()}
    assert got[1] == ("A & B", "One\ntwo\n\ninner", None) and got[2][2] == got[4][2] == "no article with a heading" and got[3][2] == "listing"
    assert web.extracted(d, content_class="content").where("page_id = 1").first()["text"] == "One\ntwo\n\ninner"
    raw = spark.createDataFrame([(1, "<article><h1>Имя</h1><p>текст</p></article>".encode("cp1251"))], "page_id long, body binary")
    assert web.read_pages(raw).first()["text"] == "текст"
    docs = spark.createDataFrame([("a", "p1", "one two"), ("a", None, "x\ufffd")], "section string, period string, text string")
    report = sinks.run_report(docs, docs.limit(0), docs.limit(1), docs.limit(0))
    assert report == {"written_total": 2, "chars": 9, "words": 3, "replacement_chars": 1, "written_by_section": {"a": 2}, "by_period": {"p1": 1}, "skipped": 0, "duplicates": 1, "near_duplicates": 0}


def test_nested_contents(tmp_path):
    import zipfile

    from corpusforge.sources.epub import _contents, write_epub

    works = [{"section": s, "period": p, "title": t, "text": "x"} for s, p, t in (("S", "P", "a"), ("S", "P", "b"), ("S", "Q", "c"), ("T", None, "d"), (None, None, "e"))]
    assert _contents(works) == [("S", [("P", [(None, 0), (None, 1)]), ("Q", [(None, 2)])]), ("T", [(None, 3)]), (None, 4)]
    write_epub(str(tmp_path / "b.epub"), "T", works, "id")
    ncx = zipfile.ZipFile(tmp_path / "b.epub").read("OEBPS/toc.ncx").decode()
    assert ncx.count("<navPoint") == 9 and '<navPoint id="n1" playOrder="1"><navLabel><text>S</text></navLabel><content src="c0.xhtml"/><navPoint id="n2"' in ncx


def test_card_details(spark):
    cards = spark.createDataFrame([(1, 3), (2, 1)], "doc_id int, lines int")
    tags = spark.createDataFrame([(1, "NOUN"), (1, "NOUN"), (1, "VERB"), (2, "NOUN")], "doc_id int, tag string")
    rhymes = spark.createDataFrame([(1, "exact"), (1, "exact"), (1, "inexact"), (1, None), (2, None)], "doc_id int, type string")
    words = spark.createDataFrame([(1, "sea"), (1, "sea"), (1, "ice"), (2, "x")], "doc_id int, word string")
    lexicon = spark.createDataFrame([("sea", "water"), ("ice", "cold"), ("ice", "water")], "word string, field string")
    got = {r["doc_id"]: (r["nouns_per_verb"], r["rhymed_share"], r["exact_share"], r["fields"]) for r in S.card_details(cards, "doc_id", tags, rhymes, words, lexicon).collect()}
    assert got == {1: (2.0, 75.0, 50.0, {"cold": 1, "water": 3}), 2: (None, 0.0, 0.0, None)}
    assert rows(S.content_totals(tags, ["doc_id"])) == [(1, 3), (2, 1)]
    near = spark.createDataFrame([(0, i, w) for i, w in enumerate("a b c d e f".split())], "doc int, pos int, word string")
    assert sorted(r["word"] for r in S.words_around(near, ["c"], ["doc"], 2, spark.createDataFrame([("d",)], "word string")).collect()) == ["a", "b", "e"]
    epithets = spark.createDataFrame([(0, 0, "white", "ADJF", "nomn", "sing", "m"), (0, 1, "snow", "NOUN", "nomn", "sing", "m"), (0, 2, "red", "ADJF", "nomn", "sing", "m"), (0, 3, "tape", "NOUN", "nomn", "sing", "m")], "doc int, pos int, lemma string, tag string, case string, number string, gender string")
    assert rows(E.epithets(epithets, ["doc"], idioms=[("red", "tape")])) == [("white", "snow", 1)]
    notes = spark.createDataFrame([(1, "2", "two"), (1, "1", "one")], "doc_id int, ref string, note string")
    d = spark.createDataFrame([(1, "Title [2]", "text [1] and [2]")], "doc_id int, label string, text string")
    assert [x["ref"] for x in D.footnotes(d, notes, label_col="label").first()["notes"]] == ["2", "1"]
    assert [x["ref"] for x in D.footnotes(d, notes).first()["notes"]] == ["1", "2"]
    groups = spark.createDataFrame([(["Works, vol. 1", "Poems", "1972"],)], "p array<string>")
    assert groups.select(D.group_of(F.col("p"), "Works").alias("g")).first()["g"] == "Poems"
    titles = spark.createDataFrame([("* * *", "\n First  line, \nsecond"), ("T", "x")], "title string, text string")
    assert [r["t"] for r in titles.select(D.repaired_title("title", "text").alias("t")).collect()] == ['"First line..."', "T"]
    spans = spark.createDataFrame([("a", 1, 1), ("a", 30, 2), ("b", 25, 1), ("b", 3, 2)], "doc string, lines long, stanzas long")
    assert rows(V.longest_spans(spans, ["doc"])) == [("a", 30, 2), ("b", 25, 1)] and rows(V.span_histogram(spans)) == [(1, 1), (25, 2), (3, 1)]
    similes = spark.createDataFrame([(1, "Как будто, как снег, словно точно"), (2, "он, как я — точно лёд")], "doc_id int, text string")
    found = {(r["doc_id"], r["kind"]): r["n"] for r in V.simile_rates(similes, ["doc_id"]).collect()}
    assert found[1, "как будто"] == 1 and found[1, "как"] == 1 and found[1, "точно"] == 0 and found[2, "как"] == 1 and found[2, "точно"] == 1
    tokens = spark.createDataFrame([(0, 0, "тень", True, False, False), (0, 1, "дома", True, True, False), (0, 2, "Рима", True, True, True)], "doc int, pos int, word string, noun boolean, genitive boolean, name boolean").withColumn("g", F.lit("x"))
    assert rows(V.genitive_rates(tokens, ["doc"], ["g"], spark.createDataFrame([("x", 3)], "g string, words long")).select("n")) == [(1,)]
