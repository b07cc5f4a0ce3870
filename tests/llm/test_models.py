"""Toxicity, quality, page language, near-duplicates and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import dart_minhash, langid, quality, toxicity

SF = "/root/testdata/sf0.01"
FOLD = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(scored, label):
    r = scored.where("held_out").select("score", label).collect()
    a, b = [x[0] for x in r if x[1] == 1], [x[0] for x in r if x[1] == 0]
    return np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])


def test_folding():
    assert toxicity.fold("Ｉd10t, іdіоt!  x2") == " idiot idiot x "
    assert toxicity.fold("1oser") == toxicity.fold("Loser") == toxicity.fold("l0$er")
    assert toxicity.fold("") == "  " and toxicity.fold("123 $$$") == "  "


def test_exceptions_take_back_hits():
    m = toxicity.Matcher(toxicity.Model({" trash": 3.0, " idiot ": 4.0}, [" trash can "]))
    assert m.features("The trash can is full")[2] == 0
    assert m.features("TRASH talk, 1d1ot")[2] == 2
    assert m.features("")[2] == 0 and m.score("")[0] < m.score("idiot")[0]


def test_toxicity_learns_from_the_other_folds(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.learn(docs, labels)
    scored = toxicity.toxicity(docs, model)
    assert scored.where(f"held_out <> ({FOLD})").count() == 0
    assert auc(scored.join(labels, "doc_id"), "toxic") > 0.75
    large = "/root/testdata/sf0.1"
    more, marks = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    told = toxicity.toxicity(more, toxicity.learn(more, marks)).join(marks, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"))
    found = {r["toxic"]: r["p"] for r in told.collect()}
    assert found[1] > 0.9 and found[0] < 0.01
    # labels of the held-out fold don't matter
    turned = labels.withColumn("toxic", F.when(F.expr(FOLD), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, turned).weights == model.weights
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, score int")
    assert {r["predicted"] for r in toxicity.toxicity(odd, model).collect()} == {0}
    assert toxicity.without_toxic(odd, model).count() == 3
    assert toxicity.learn(docs, labels.limit(0)).weights == {}


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_quality(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.learn(docs, labels)
    scored = quality.quality(docs, model)
    assert auc(scored.join(labels, "doc_id"), "quality") > 0.95
    assert scored.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (2, " "), (3, "x" * 100_000)], "doc_id long, text string")
    assert quality.quality(odd, model).count() == 4 and quality.quality(odd.limit(0), model).count() == 0
    assert {r["score"] for r in quality.quality(odd, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_language_of_pages(spark):
    model = langid.learn(read(spark, "documents"))
    pages = read(spark, "pages")
    got = langid.identify(pages, model).join(pages.select("page_id", F.regexp_extract("url", r"\.[a-z]+/([a-z]{2})/", 1).alias("path")), "page_id")
    assert got.where("lang = path").count() >= 0.98 * got.count()


def test_host_and_declaration_decide_what_text_cant(spark):
    model = langid.learn(read(spark, "documents"))
    text = {r["lang"]: r["text"] for r in read(spark, "documents").where("length(text) > 800").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    data = [(i, "https://a.example.fr/x", f"<p>{text['fr']}</p>") for i in range(12)] + [(20 + i, "https://b.example.de/x", f"<html lang=de><p>{text['de']}</p>") for i in range(12)]
    data += [(40, "https://a.example.fr/y", None), (41, None, "<html lang='de'></html>"), (42, None, None), (None, "", ""), (40, "https://a.example.fr/y", None)]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(data, "page_id long, url string, html string"), model).collect()}
    assert got[40] == "fr" and got[41] == "de" and len(got) == 28
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_jaccard(weighted):
    rng, errors = np.random.default_rng(5), []
    for k in np.linspace(0, 250, 30).astype(int):
        a = rng.integers(0, 2**63, 250).astype(np.uint64)
        b = a.copy()
        b[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
        w = rng.integers(1, 7, 250) if weighted else None
        x, y = dart_minhash.signatures([(a, w), (b, w)])
        same, total = (w[k:].sum(), w.sum()) if weighted else (250 - k, 250)
        errors.append(dart_minhash.likeness(x == y) - same / (2 * total - same))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.05
    assert dart_minhash.signatures([(np.zeros(0, np.uint64), None)]) == [None]


def brute_classes(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = dart_minhash.words_of(t or "")
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = (sets[i] & sets[j]).total() if sets[i].keys() & sets[j].keys() else 0
            if both >= similarity * (sets[i].total() + sets[j].total() - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        base = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.randint(1, 300))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.004, 0.01, 0.05]))):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, "  !", "one two", "One, two", "one two three"]
    want = brute_classes(texts)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = dart_minhash.near_duplicates(d).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in got if r["keeps"]) == sorted(set(want))
    kept = dart_minhash.deduplicated(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    odd = d.withColumns({c: F.lit(1) for c in ("class_hash", "Class_rows", "hash", "_id", "_hash", "_rows", "band", "key", "label", "p", "bits", "maybe")})
    assert dart_minhash.deduplicated(odd).columns == odd.columns and dart_minhash.deduplicated(odd).count() == len(set(want))


def test_copies_that_are_near_their_original_alone(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: 7 + i % 46] + [f"new{i}"] + base[8 + i % 46 :]) for i in range(150)]
    texts.insert(77, " ".join(base))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    assert len(sets[0] & sets[10]) / len(sets[0] | sets[10]) < 0.8 < len(sets[0] & sets[77]) / len(sets[0] | sets[77])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in dart_minhash.near_duplicates(d).collect()} == {0}


def test_true_links_among_many_near_misses(spark):
    rng = random.Random(1)
    texts = []
    for t in range(300):
        w = [f"w{i}" for i in range(200)]
        for p in rng.sample(range(200), 3):
            w[p] = f"n{t}x{p}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(d).collect()} == dict(enumerate(brute_classes(texts)))


def test_open_pairs_come_once_over_bands_and_cells(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "CELL", 1)
    rng = np.random.default_rng(5)
    sigs, labels = rng.integers(0, 2, (40, 192)).astype(np.uint8), np.minimum(np.arange(40) // 2, 9)
    bands = [(i, k, int("".join(map(str, s[6 * k : 6 * k + 6])), 2) + 64 * k) for i, s in enumerate(sigs) for k in range(32)]
    members = spark.createDataFrame(bands, "node long, number int, band long").withColumn("n", F.lit(4))
    cells = dart_minhash._cells(members, spark.createDataFrame(list(enumerate(labels.tolist())), "node long, label long"))
    found = []
    for _, c in cells.toPandas().groupby(["band", "chunk", "team"]):
        cell = {k: c[k].to_numpy() for k in ("node", "label", "minor", "visitor", "resident")}
        for i, js in dart_minhash.open_pairs(sigs[cell["node"]], cell, int(c["number"].iloc[0]), 0.5):
            found += [tuple(sorted((cell["node"][i], cell["node"][j]))) for j in js]
    same = [(sigs[a] == sigs[b]) for a in range(40) for b in range(a + 1, 40)]
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    shared = {p for p, s in zip(pairs, same, strict=True) if labels[p[0]] != labels[p[1]] and dart_minhash.likeness(s) >= 0.5 and s.reshape(32, 6).all(axis=1).any()}
    assert shared == set(found) and len(found) == len(set(found)) and cells.select("chunk", "team").distinct().count() > 4


def test_a_crowded_bucket_of_3000(spark):
    """A star of 3,000 copies, two chains beside it and decoys of another one: classes as brute force by sets of places."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]

    def changed(w, k):
        w = list(w)
        for p in rng.sample(range(len(w)), k):
            w[p] = f"n{rng.randrange(10**9)}"
        return w

    texts = [" ".join(changed(base, 2)) for _ in range(3000)] + [" ".join(base)]
    chain = changed(base, 5)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = changed(chain, 1)
    grams = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    held, ids = {}, {}
    for k, g in enumerate(grams):
        for x in g:
            held.setdefault(ids.setdefault(x, len(ids)), []).append(k)
    m = np.zeros((len(texts), len(ids)), np.float32)
    for x, ks in held.items():
        m[ks, x] = 1
    m = m[:, m.sum(axis=0) > 1]
    both, size = m @ m.T, np.array([len(g) for g in grams])
    near = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-4
    label = np.arange(len(texts))
    while True:
        least = np.where(near, label[None], len(texts)).min(axis=1)
        if (least == label).all():
            break
        label = least
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(d).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_near_duplicates_with_repeated_rows_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "other words stand here alone now")], "doc_id long, text string")
    got = dart_minhash.near_duplicates(d)
    assert got.count() == 4 and {r["class_rows"] for r in got.where("doc_id = 1").collect()} == {3}
    assert sorted((r["doc_id"] for r in dart_minhash.deduplicated(d).collect()), key=repr) == [2, None]
    twice = d.where("doc_id = 1")
    assert dart_minhash.deduplicated(twice).count() == 1
    assert dart_minhash.near_duplicates(d.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from corpusforge.llm import decontaminate

    docs = read(spark, "documents")
    columns = docs.columns
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns and docs.dtypes == before.dtypes, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        n.append(docs.count())
    assert n[0] > n[1] == n[2] > n[3] > n[4] > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    assert decontaminate.contamination(docs, read(spark, "benchmark")).where("contaminated").count() == 0
    tokens = corpus_pipeline.encode(spark, docs, SF)
    assert tokens.where("n_tokens <> size(token_ids)").count() == 0 and tokens.count() == n[4]
