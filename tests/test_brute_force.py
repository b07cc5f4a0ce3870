"""Queries that SQL can't express, against plain versions of themselves."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import docs as D
from corpusforge.operators import graph as G
from corpusforge.operators import style as Y
from corpusforge.plans import catalog
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
catalog.register()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def shingles(text, k=5):
    w = re.findall(r"[^\W\d_]+", text.lower())
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def test_near_dup_keep(spark):
    texts = [(r["doc_id"], r["text"]) for r in read(spark, "documents").orderBy("doc_id").collect()]
    rng = random.Random(4)
    for i in range(30):  # copies at several distances, and chains of them
        w = rng.choice(texts)[1].split(" ")
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "changed" * rng.randint(1, 3)
        texts.append((10_000 + i, " ".join(w)))
    letters = {i: sum(c.isalpha() for c in t) for i, t in texts}
    sets = {i: shingles(t) for i, t in texts}
    best = {}
    for i, _ in texts:
        if sets[i] not in best or letters[i] > letters[best[sets[i]]]:
            best[sets[i]] = i
    left = sorted(best.values())
    gone = set()
    for a, b in itertools.combinations(left, 2):
        if a not in gone and b not in gone and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]):
            gone.add(a if letters[b] > letters[a] else b)
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.drop_near_duplicates(d).collect()) == sorted(set(left) - gone)


def test_family_labels(spark):
    rng = random.Random(2)
    weights = {}
    for _ in range(120):
        a, b = sorted(rng.sample(range(30), 2))
        weights[a, b] = float(rng.randint(1, 5))
    strength = {n: sum(w for p, w in weights.items() if n in p) for n in range(30)}
    label = {n: n for n in range(30) if strength[n]}
    for _ in range(30):
        moved = False
        for n in sorted(label, key=lambda x: (-strength[x], x)):
            score = {}
            for (a, b), w in weights.items():
                if n in (a, b):
                    other = label[b if n == a else a]
                    score[other] = score.get(other, 0) + w
            top = max(score.values())
            new = min(x for x, s in score.items() if s == top)
            moved |= new != label[n]
            label[n] = new
        if not moved:
            break
    t = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, w double")
    assert {r["node"]: r["label"] for r in G.family_labels(t).collect()} == label


def test_change_points_and_distances(spark):
    o = read(spark, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n")).orderBy("y").collect()
    x = np.array([[r["price"], r["n"]] for r in o])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cuts = []
    for _ in range(4):
        bounds = [0, *sorted(cuts), len(z)]
        options = []
        for c in range(len(z)):
            a = max(b for b in bounds if b <= c)
            b = min(b for b in bounds if b > c)
            if c - a >= 2 and b - c >= 2:
                new = sorted([*bounds, c])
                options.append((sum(((z[p:q] - z[p:q].mean(axis=0)) ** 2).sum() for p, q in itertools.pairwise(new)), c))
        if not options:
            break
        cuts.append(min(options)[1])
    years = [r["y"] for r in o]
    got = catalog.QUERIES["distances_and_cuts"](spark, SF).collect()
    for r in got:
        i, j = years.index(r["a"]), years.index(r["b"])
        assert r["distance"] == pytest.approx(np.sqrt(((z[i] - z[j]) ** 2).mean()))
        assert r["crosses"] == any(r["a"] < years[c] <= r["b"] for c in cuts)
    assert len(got) == len(years) * (len(years) - 1) // 2


def test_k_means_is_a_fixed_point(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in (0, 4, 8)])
    t = Y.with_features(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double"), ["x", "y"])
    model, found = Y.k_means(t, 3)
    got = np.array([r["cluster"] for r in found.orderBy("id").collect()])
    centres = np.array(model.clusterCenters())
    assert (((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == got).all()
    assert np.allclose([points[got == c].mean(axis=0) for c in range(3)], centres, atol=1e-3)
    assert sorted(np.bincount(got)) == [40, 40, 40]


def rand_index(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    same_a, same_b = (np.array([x[i] == x[j] for i, j in pairs]) for x in (a, b))
    expected = same_a.sum() * same_b.sum() / len(pairs)
    return ((same_a & same_b).sum() - expected) / ((same_a.sum() + same_b.sum()) / 2 - expected)


def test_rand_null_is_a_quantile_of_dealings(spark):
    data = [(i, i % 3, i % 2) for i in range(24)]
    t = spark.createDataFrame(data, "id int, a int, b int")
    hashes = t.select("id", *[F.array(*[F.xxhash64(F.lit(s), F.lit(rep), "id") for rep in range(1, 41)]).alias(f"h{s}") for s in (0, 1)]).collect()
    scores = []
    for rep in range(40):
        one, two = ([r["id"] for r in sorted(hashes, key=lambda r: (r[h][rep], r["id"]))] for h in ("h0", "h1"))
        scores.append(rand_index([i % 3 for i in one], [i % 2 for i in two]))
    assert Y.rand_null(t, "a", "b", "id", reps=40).first()["quantile"] == pytest.approx(np.quantile(scores, 0.95))


def test_word_vectors_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i:02}" for i in range(25)]
    m = np.where(rng.random((25, 25)) < 0.4, rng.random((25, 25)) * 5, 0.0)
    cells = [(words[i], words[j], float(m[i, j])) for i in range(25) for j in range(25) if m[i, j]]
    v = Y.word_vectors(spark.createDataFrame(cells, "x string, y string, ppmi double"), spark.createDataFrame([(w,) for w in words], "w string"), rank=6)
    got = np.array([r["vector"] for r in v.orderBy("word").collect()])
    u, s, _ = np.linalg.svd(m)
    want = u[:, :6] * np.sqrt(s[:6])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)


def test_unique_rhyme_sample(spark):
    from corpusforge.plans.q_verse import suffix_pairs

    pairs = {}
    for r in suffix_pairs(spark, SF).collect():
        pairs.setdefault(tuple(sorted(r)), set()).add(tuple(r))
    got = catalog.QUERIES["unique_rhyme_sample"](spark, SF).collect()
    seen = [tuple(sorted((r["word_i"], r["word_j"]))) for r in got]
    assert len(seen) == len(set(seen)) and set(seen) <= set(pairs)
    lists = {k: ("long" if any(len(a) >= 10 for a, _ in v) else "short") for k, v in pairs.items()}
    for name in ("long", "short"):
        assert sum(r["list"] == name for r in got) == min(20, sum(x == name for x in lists.values()))
    assert all(lists[k] == r["list"] for k, r in zip(seen, got, strict=True))


def test_entity_card(spark):
    docs = [(r["doc_id"], r["lang"], re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", r["text"].lower())) for r in read(spark, "documents").collect()]
    df, n = {}, {}
    for i, _, words in docs:
        for w in words:
            if len(w) >= 7:
                df.setdefault(w, set()).add(i)
                n[w] = n.get(w, 0) + 1
    names = {w for w, d in df.items() if 8 * len(docs) <= 1000 * len(d) <= 40 * len(docs)}
    name = min(sorted(names), key=lambda w: (-len(df[w]), -n[w], w))
    card = catalog.QUERIES["entity_card"](spark, SF).first()
    assert (card["word"], card["n"], card["texts"]) == (name, n[name], len(df[name]))
    weights = sorted(((-len(df[w] & df[name]), w) for w in names - {name} if len(df[w] & df[name]) >= 2))[:6]
    assert [(x["name"], x["w"]) for x in card["neighbours"]] == [(w, -c) for c, w in weights]
    assert all(name in x["line"].lower() for x in card["examples"])


def test_chord_network_covers_the_circle(spark):
    ribbons = catalog.QUERIES["chord_network"](spark, SF).collect()
    slices = sorted([(r["src_start"], r["src_stop"]) for r in ribbons] + [(r["dst_start"], r["dst_stop"]) for r in ribbons])
    assert all(b <= c + 1e-5 for (_, b), (c, _) in itertools.pairwise(slices)) and len(rows(spark.createDataFrame(slices, "a double, b double"))) == 2 * len(ribbons)
