"""Operators that SQL can't express against plain versions of themselves, and all of them on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import bpe_tree, dart_minhash, decontaminate, gif_media, langid, line_dedup, quality, secret_scan, token_counts, toxicity
from tests.llm.test_models import SF, brute_classes, read
from tests.llm.test_text_operators import JSON, RANKS, WEIRD, brute_contamination, brute_lines, sha

TINY = "/root/testdata/sf0.001"


# Toxicity ------------------------------------------------------------------------


def naive_features(model, text):
    """Every entry looked for at every place of the folded text."""
    folded = toxicity.fold(text)
    words = folded.split()
    best = {}
    for entry, weight in model.weights.items():
        for at in range(len(folded)):
            if folded.startswith(entry, at):
                best[at] = max(best.get(at, 0.0), weight)
    for phrase in model.exceptions:
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                for start in range(at, at + len(phrase) - 1):
                    best.pop(start, None)
    return (sum(best.values()), 100 * sum(best.values()) / len(words), len(best)) if words else (0.0, 0.0, 0)


def test_automaton_equals_naive_matching():
    rng = random.Random(2)
    stems = ["idiot", "idi", "moron", "moro", "trash", "stu", "stupid"]
    model = toxicity.Model({f" {s}{rng.choice(['', ' '])}": rng.uniform(1, 4) for s in map(lambda s: s.replace("l", "i"), stems)}, [" trash can ", " stupid idea "])
    matcher = toxicity.Matcher(model)
    vocabulary = ["idiot", "Idiots", "1d10t", "ídiot", "MORON", "moronic", "trash", "can", "stupid", "idea", "a", "ｔｒａｓｈ", "-", "тrash", "st​upid", ""]
    for _ in range(300):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        got, want = matcher.features(text), naive_features(model, text)
        assert got == pytest.approx(want)


def test_folding_of_marks_signs_and_unseen_characters():
    same = toxicity.fold("idiot")
    assert {toxicity.fold(t) for t in ("ídiöt", "id​iot", "𝐢𝐝𝐢𝐨𝐭", "1D1OT", "ldlot", "ＩＤＩＯＴ", "idi­ot")} == {same}
    assert toxicity.fold("a55") == toxicity.fold("a$$") == toxicity.fold("@ss") == " ass "
    assert toxicity.fold("costs $5 or 1,000") == " costs or "


def test_exceptions_are_learned(spark):
    rng = random.Random(1)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = [(i, " ".join([*rng.choices(filler, k=6), "you", "rotten", "soul", *rng.choices(filler, k=5)]), 1) for i in range(200)]
    texts += [(200 + i, " ".join([*rng.choices(filler, k=6), "rotten", "apples", *rng.choices(filler, k=5)]), 0) for i in range(60)]
    texts += [(400 + i, " ".join(rng.choices(filler, k=14)), 0) for i in range(400)]
    d = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert any(e.startswith(" rot") for e in model.weights) and " rotten appies " in model.exceptions
    matcher = toxicity.Matcher(model)
    assert matcher.features("he sold rotten apples")[2] == 0 and matcher.features("a rotten soul")[2] > 0


# GIF -----------------------------------------------------------------------------


def plain_gif(data):
    """(delay, RGB bytes or None by place) of each frame on show, by the format's own description: one code at a time."""
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, table = 13, None

    def colours(n):
        nonlocal at
        out = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
        at += 3 * n
        return out

    def blocks():
        nonlocal at
        out = b""
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        return out

    if flags & 0x80:
        table = colours(2 << (flags & 7))
    canvas, control, out = {}, (0, 0, None), []
    while data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                control = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            continue
        left, top, cols, rows, bits = struct.unpack_from("<HHHHB", data, at)
        at += 9
        own = colours(2 << (bits & 7)) if bits & 0x80 else table
        size = data[at]
        at += 1
        stream = blocks()
        number, clear = int.from_bytes(stream, "little"), 1 << size
        codes, width_now, shift, samples, last = [], size + 1, 0, [], None
        while True:
            code = number >> shift & ((1 << width_now) - 1)
            shift += width_now
            if code == clear:
                codes, width_now, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
                continue
            if code == clear + 1:
                break
            entry = codes[code] if code < len(codes) else last + last[:1]
            samples += entry
            if last is not None and len(codes) < 4096:
                codes.append(last + entry[:1])
                if len(codes) == 1 << width_now and width_now < 12:
                    width_now += 1
            last = entry
        before = dict(canvas)
        for i, s in enumerate(samples):
            x, y = left + i % cols, top + i // cols
            if s != control[2] and x < width and y < height:
                canvas[x, y] = own[s]
        out.append((control[0], dict(canvas)))
        if control[1] == 2:
            canvas = {p: c for p, c in canvas.items() if not (left <= p[0] < left + cols and top <= p[1] < top + rows)}
        elif control[1] == 3:
            canvas = before
        control = (0, 0, None)
    return out


def test_canvas_equals_a_plain_decoder():
    rng = np.random.default_rng(4)
    for _ in range(25):
        palettes = [rng.integers(0, 256, (int(n), 3)) for n in rng.choice([2, 4, 16, 256], 3)]
        frames = []
        for _ in range(int(rng.integers(1, 6))):
            p = palettes[int(rng.integers(3))]
            rows, cols = rng.integers(1, 40, 2)
            frames.append(gif_media.Frame(int(rng.integers(0, 9)), int(rng.integers(0, 9)), rng.integers(0, len(p), (rows, cols)).astype(np.uint8), p, int(rng.integers(0, 99)), int(rng.integers(0, 4)), int(rng.integers(len(p))) if rng.random() < 0.5 else None))
        data = gif_media.write_gif(frames, 30, 20)
        want = plain_gif(data)
        got = list(gif_media.shown(*gif_media.read_gif(data)))
        assert [d for d, _ in got] == [d for d, _ in want]
        for (_, canvas), (_, places) in zip(got, want, strict=True):
            assert {(x, y): tuple(canvas[y, x, :3].tolist()) for y in range(20) for x in range(30) if canvas[y, x, 3]} == places
            clear = gif_media.histogram(canvas)
            assert clear[64] == 600 - len(places) and sum(clear) == 600


def test_payload_feature_is_that_of_the_canvas(spark):
    texts = ["", "some text", "é" * 3000, "x" * (64 * 4096 + 1000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in gif_media.payload_media(d, keep_media=True).collect():
        want = plain_gif(bytes(r["media"])) if r["doc_id"] < 3 else None
        assert [f["frame"] for f in r["frames"]] == list(range(2 if r["doc_id"] == 3 else 1))
        assert sum(sum(f["histogram"][:64]) for f in r["frames"]) == r["payload_bytes"]
        if want:
            bins = [0] * 64
            for colour in want[0][1].values():
                bins[colour[0] >> 6 << 4 | colour[1] >> 6 << 2 | colour[2] >> 6] += 1
            assert r["feature"] == f"frames=1;cs=10;rgb64={','.join(map(str, bins))}"
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    assert "65535" in gif_media.gif_frames(spark.createDataFrame([(1, huge)], "id long, media binary"), "id", "media").first()["error"]


# Secrets -------------------------------------------------------------------------


def brute_linked(text):
    """Weak spans whose complement begins within reach, by comparing all spans of a text."""
    found = []
    for kind, pattern in enumerate((secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.LOGIN, secret_scan.BLOB, secret_scan.URL)):
        for m in re.finditer(pattern, text, re.A):
            if kind == 0 and len(m[2]) < 8:
                continue
            if kind == 4 and not all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]")):
                continue
            found.append((m.start(), kind, m.end()))

    def near(start, kinds):
        return any(k in kinds and abs(s - start) <= secret_scan.REACH for s, k, _ in found)

    kept = [(s, k, e) for s, k, e in found if k <= 2 or (k == 3 and near(s, (0, 2, 4))) or (k == 4 and near(s, (1, 3))) or (k == 5 and near(s, (1, 3)) and near(s, (0, 2, 4)))]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(kept))


def test_linked_spans_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["login=bob", "client_id: abc-1", "aB3" + "x" * 37, "A1b2" * 10, "https://h.example.org/x?y=1", "http://a.b", "password=abcdefgh1", "AKIAABCDEFGHIJKL", "f" * 33, "é😀 word"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", " " * rng.randint(1, 200)]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(d).collect()} == {i: brute_linked(t) for i, t in enumerate(texts)}


# Page language -------------------------------------------------------------------


def brute_language(model, pages):
    """The posterior of every page, one page at a time."""
    k, rows = len(model.languages), []
    for url, html in pages:
        host = (re.findall(langid._HOST, url or "") or [""])[0].lower()
        labels = host.split(".")
        declared = (re.findall(langid._DECLARED, html or "") or [""])[0].lower()
        e = model.evidence(langid.visible_text(html or ""))
        p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        rows.append((host, ".".join(labels[-2:]), labels[-1], declared, e, p))

    def sums(i, value):
        return sum((r[5] for r in rows if r[i] == value), np.zeros(k))

    total = sum((r[5] for r in rows), np.zeros(k)) + 1.0
    prior = total / total.sum()
    out = []
    for host, domain, suffix, declared, e, p in rows:
        logs = e.copy()
        for i, value in ((3, declared), (2, suffix)):
            if value:
                n = len({r[i] for r in rows})
                logs += np.log((sums(i, value) + langid.ATTRIBUTE_PSEUDO) / (total + langid.ATTRIBUTE_PSEUDO * (n + 1)))
        if host:
            d = np.maximum(sums(1, domain) - p, 0)
            d = (d + langid.DOMAIN_STRENGTH * prior) / (d.sum() + langid.DOMAIN_STRENGTH)
            h = np.maximum(sums(0, host) - p, 0)
            logs += np.log((h + langid.HOST_STRENGTH * d) / (h.sum() + langid.HOST_STRENGTH))
        else:
            logs += np.log(prior)
        out.append(np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum())
    return out


def test_page_posteriors_equal_brute_force(spark):
    model = langid.learn(read(spark, "documents"))
    pages = [(r["url"], r["html"]) for r in read(spark, "pages").orderBy("page_id").limit(60).collect()]
    pages += [("https://a.example.fr/x", None), (None, "<html lang=de>"), (None, None), ("", ""), ("https://www.example.fr/x", "<!--" + "x" * 200_000 + '--><html lang="DE-at"><p>oui non peut-être</p>')]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify(d, model).collect()}
    for i, want in enumerate(brute_language(model, pages)):
        assert got[i]["posterior"] == pytest.approx(want.tolist(), abs=1e-9)
        assert got[i]["lang"] == model.languages[int(np.argmax(want))]
    assert got[len(pages) - 1]["declared"] == "de"


# Quality -------------------------------------------------------------------------


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(6)
    n = len(quality.STATISTICS)
    model = quality.Model(np.zeros(n), np.ones(n), np.zeros(quality.FEATURES + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(80, n))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_summed_fit_equals_a_direct_solution(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = quality.learn(docs, labels)
    sample = [(r["text"], r["label"]) for r in toxicity.labelled_sample(docs, labels, "quality", quality.SAMPLE_ROWS, "doc_id", "text").collect()]
    x, y = np.array([quality.statistics(t) for t, _ in sample]), np.array([v for _, v in sample], float)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    side = np.array([quality.hash_of(t) % 3 == 0 for t, _ in sample])
    z = model.features(x[~side])
    direct = np.linalg.lstsq(np.vstack([z, np.eye(z.shape[1]) * math.sqrt(quality.RIDGE)]), np.concatenate([y[~side], np.zeros(z.shape[1])]), rcond=None)[0]
    assert z @ model.weights == pytest.approx(z @ direct, abs=1e-6)


def test_isotonic_equals_minimax():
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randint(1, 30)
        y = np.array([float(rng.random() < i / n) for i in range(n)])
        _, values = quality.isotonic(np.arange(n, dtype=float), y)
        at, fitted = quality.isotonic(np.arange(n, dtype=float), y)
        want = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert sorted(set(np.round(values, 9))) == sorted(set(np.round(want, 9)))
        assert all(np.diff(fitted) > 0) and all(np.diff(at) > 0)


# Token counts --------------------------------------------------------------------


def test_first_tier_is_of_the_corpus_and_packs(spark):
    docs = read(spark, "documents")
    table = token_counts.frequent_lengths(docs, JSON, rows=300, entries=500)
    assert len(table) == 500 and token_counts.PackedTable.of(table).unpacked() == table
    counter = token_counts.TwoTierCounter(JSON, {})
    assert all(counter.count([w]) == [n] for w, n in list(table.items())[:50])
    assert token_counts.frequent_lengths(docs.limit(0), JSON) == {}


# Odd tables ----------------------------------------------------------------------

CLASHES = ["id", "hash", "key", "term", "at", "w", "p", "bits", "score", "frames", "node", "label", "rows", "gone", "near", "class_id", "n_tokens", "spans", "lines_gone", "_id", "_hash", "_rows", "_gone", "_bad", "_piece", "maybe", "copy"]
OPERATORS = {
    1: lambda spark, d: toxicity.toxicity(d, toxicity.Model({" idiot": 3.0}, [])),
    2: lambda spark, d: line_dedup.dedup_lines(d),
    3: lambda spark, d: gif_media.payload_media(d),
    4: lambda spark, d: secret_scan.secret_scan(d),
    5: lambda spark, d: token_counts.token_counts(spark, d, JSON),
    6: lambda spark, d: dart_minhash.near_duplicates(d),
    7: lambda spark, d: bpe_tree.bpe_round_trip(d, RANKS, public_tokenizers.PATTERN),
    8: lambda spark, d: decontaminate.contamination(d, spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, None), (2, "")], "item_id long, text string")),
    9: lambda spark, d: langid.identify(d.withColumnRenamed("text", "html"), langid.TrigramModel(["de", "en"], np.zeros((langid.BUCKETS, 2))), id_col="doc_id"),
    10: lambda spark, d: quality.quality(d, quality.Model(np.zeros(19), np.ones(19), np.zeros(quality.FEATURES + 1), np.zeros(1), np.full(1, 0.5))),
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_odd_tables(spark, n):
    """Nulls, empty and very long texts, repeated rows, clashing names and no rows: one row comes out for each that goes in."""
    long = " ".join(f"word{i % 977}" for i in range(150_000)) + "\n" + "z" * 300_000
    texts = [*WEIRD, long, long]
    data = [(i, t, None) for i, t in enumerate(texts)] + [(None, "null id", "u"), (None, None, None), (0, texts[0], None), (3, texts[3], None)]
    d = spark.createDataFrame(data, "doc_id long, text string, url string").withColumns({c: F.lit("x") for c in CLASHES})
    out = OPERATORS[n](spark, d).select("doc_id").collect()
    assert sorted(map(repr, (r["doc_id"] for r in out))) == sorted(repr(r[0]) for r in data)
    assert OPERATORS[n](spark, d.limit(0)).count() == 0


# The pipeline --------------------------------------------------------------------


def brute_pipeline(spark):
    """All stages over the smallest documents, one document at a time."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    model = toxicity.learn(docs, labels)
    a, b, c = model.coefficients
    held = []
    for r in docs.orderBy("doc_id").collect():
        total, rate, _ = naive_features(model, r["text"] or "")
        if not r["text"] or 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(rate)))) < 0.5:
            held.append((r["doc_id"], r["text"]))
    cut = brute_lines(held, {t: 0 for _, t in held})
    held = [(i, cut[i, t][0] if t is not None else None) for i, t in held]
    classes = brute_classes([t for _, t in held])
    held = [x for k, x in enumerate(held) if classes[k] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(held, items) if r[5]}
    base = bpe_tree.TreeCodec(bpe_tree.read_ranks(RANKS), public_tokenizers.PATTERN).base
    out = []
    for i, t in held:
        if i not in bad:
            ids = base.encode_ordinary(t or "")
            out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()), ids))
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["token_ids"])) for r in corpus_pipeline.run(spark, TINY).collect())
    assert got == brute_pipeline(spark)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_odd_rows_and_columns(spark, k):
    """A stage takes nulls, empty and long texts, repeated rows, clashing names and an empty table, and gives the same columns."""
    import corpus_pipeline

    texts = [None, "", " ", "clean words stand here", "clean words stand here", "x " * 50_000]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "other", None, None, None), (3, texts[3], "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({c: F.lit(1) for c in CLASHES if c != "n_chars"})
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, d, SF)
    assert out.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    if k in (0, 3):
        assert sorted(map(repr, kept)) == sorted(repr((r["doc_id"], r["text"])) for r in d.collect())
    elif k == 1:
        assert len(kept) == d.count() and kept.count((3, texts[3])) == 2 and (4, "") in kept and (0, None) in kept
    else:
        assert sorted(map(repr, (i for i, _ in kept))) == sorted(map(repr, [0, 3, 5, None]))
    assert stage(spark, d.limit(0), SF).count() == 0
