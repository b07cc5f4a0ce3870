"""Token counts, BPE trees, GIF media, secrets, decontamination and line dedup against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.llm import bpe_tree, decontaminate, gif_media, line_dedup, secret_scan, token_counts
from tests.conftest import rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WEIRD = [None, "", " ", "a", "a", "\n\n", "é😀 naïve", "x" * 5000, "don't  stop\t\n!", "<|endoftext|> and <|endoftext|>", "   lead", "日本語 テキスト", "1234567890 " * 300]


def table(spark, texts):
    """Texts with a null id, a repeated row, and extra columns whose names the operators use themselves."""
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", "c", 2), (0, texts[0], "clash", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string, id int")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    d = table(spark, WEIRD)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(tok.encode(r["text"] or "", add_special_tokens=False)), n > 512) for r in d.collect()), key=repr)
    assert rows(token_counts.token_counts(spark, d, JSON)) == want
    assert token_counts.token_counts(spark, d.limit(0), JSON).count() == 0


def test_counter_forgets_and_stays_right():
    c = token_counts.TwoTierCounter(JSON, {}, cache_entries=5)
    texts = [" ".join(random.Random(i).choices(["alpha", "beta", "gammadelta", "x" * 60, "ü"], k=9)) for i in range(30)]
    want = [len(c.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert [n for t in texts for n in c.count([t])] == want


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe_tree.read_ranks(RANKS)
    return [bpe_tree.TreeCodec(ranks, public_tokenizers.PATTERN), bpe_tree.TreeCodec(ranks, public_tokenizers.PATTERN, 7, 6)]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from(list("abtheé 's!1\n\t　中 ")), max_size=200))
def test_tree_equals_tiktoken(codecs, text):
    for c in codecs:
        ids = c.encode(text)
        assert ids == c.base.encode_ordinary(text) and c.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(min_size=1, max_size=300))
def test_long_pieces_equal_tiktoken(codecs, piece):
    assert codecs[1].encode_piece(piece) == codecs[0].base._encode_single_piece(piece)


def test_joining_is_associative(codecs):
    c, rng = codecs[0], random.Random(3)
    parts = [(t, c.base.encode_ordinary(t)) for t in ("".join(rng.choices("the a!\n", k=40)) for _ in range(3))]
    left, right = c.join(c.join(*parts[:2]), parts[2]), c.join(parts[0], c.join(*parts[1:]))
    assert left == right and c.join(("", []), parts[0]) == parts[0]


def test_bpe_rows(spark, codecs):
    d = table(spark, WEIRD)
    base = codecs[0].base
    want = []
    for r in d.collect():
        ids = base.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r["text"] or "").encode())))
    assert rows(bpe_tree.bpe_round_trip(d, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 8), st.integers(1, 3), st.integers(0, 6000), st.integers(0, 10**6))
def test_lzw_round_trip(size, kinds, n, seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(min(kinds**3, 1 << size)) for _ in range(n))
    assert gif_media.lzw_decode(gif_media.lzw_encode(data, size), size, n) == data


def test_gif_frames_palettes_disposal_transparency(spark):
    red, blue = np.array([[255, 0, 0], [0, 255, 0]]), np.array([[0, 0, 255], [9, 9, 9], [1, 1, 1], [2, 2, 2]])
    f = [gif_media.Frame(0, 0, np.zeros((2, 2), np.uint8), red, 5, 1), gif_media.Frame(0, 0, np.array([[1, 0]], np.uint8), red, 7, 3, transparent=0), gif_media.Frame(1, 1, np.zeros((1, 1), np.uint8), blue, 9, 2), gif_media.Frame(0, 0, np.array([[1]], np.uint8), blue, 1, 0, transparent=1)]
    data = gif_media.write_gif(f, 2, 2)
    canvases = [c for _, c in gif_media.shown(*gif_media.read_gif(data))]
    assert canvases[1][0, 0].tolist() == [0, 255, 0, 255] and canvases[1][0, 1].tolist() == [255, 0, 0, 255]
    assert canvases[2][0, 0].tolist() == [255, 0, 0, 255] and canvases[2][1, 1].tolist() == [0, 0, 255, 255]
    assert canvases[3][1, 1].tolist() == [0, 0, 0, 0]
    media = spark.createDataFrame([(1, data), (2, data[:-9]), (3, None), (4, b"GIF89x")], "id long, media binary")
    got = gif_media.gif_frames(media, "id", "media")
    assert [(r["frame"], r["start_cs"], r["delay_cs"]) for r in got.where("id = 1").orderBy("frame").collect()] == [(0, 0, 5), (1, 5, 7), (2, 12, 9), (3, 21, 1)]
    assert {r["id"]: r["frame"] for r in got.where("id > 1").collect()} == {2: -1, 3: -1, 4: -1}
    interlaced = gif_media.write_gif([gif_media.Frame(0, 0, np.arange(10, dtype=np.uint8)[:, None], gif_media.GREYS)], 1, 10)
    at = interlaced.index(b"\x2c", 13 + 768) + 9
    laid = gif_media.read_gif(interlaced[:at] + b"\x40" + interlaced[at + 1 :])[2][0].samples[:, 0].tolist()
    assert [laid[i] for i in (0, 8, 4, 2, 6, 1, 3, 5, 7, 9)] == list(range(10))


def test_payload_media(spark):
    texts = [*WEIRD, os.urandom(300_000).hex()]
    d = table(spark, texts)
    for r in gif_media.payload_media(d).collect():
        raws = [(t or "").encode() for i, t in [*enumerate(texts), (None, "null id")] if i == r["doc_id"]]
        raw = raws[0]
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == sha(gif_media.store_payload(payload)) and r["media_bytes"] == len(gif_media.store_payload(payload))
    kept = gif_media.payload_media(d, keep_media=True)
    assert {r["text"] for r in gif_media.payload_text(kept, "doc_id", "media", "n_bytes").collect()} == {t or "" for t in texts} | {"null id"}


KINDS = [("assign", re.compile(secret_scan.ASSIGN, re.A), lambda m: len(m[2]) >= 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
SECRETS = ["token= token:abcdefgh", "password: 'hunter22hunter' secret=1234567", "AKIAABCDEFGHIJKL AKIAX AKIA", "0" * 31 + " " + "a" * 40, "é😀 API_KEY=\"zzzzzzzzzz\"", "Secret=abcdefghij apiKey = abcdefgh.=/+", "secret=secret=abcdefgh1", "passwd : = x"]


def test_base_secrets_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*WEIRD, *SECRETS, *(" ".join(rng.choices(SECRETS, k=6)) for _ in range(40))]
    want = []
    d = table(spark, texts)
    for r in d.collect():
        found, n = [], []
        for k, (_, p, ok) in enumerate(KINDS):
            own = [(m.start(), k, m.end()) for m in p.finditer(r["text"] or "") if ok(m)]
            n.append(len(own))
            found += own
        want.append((r["doc_id"], *n, sha(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found)).encode())))
    assert rows(secret_scan.secret_scan(d).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == sorted(want, key=repr)


def test_weak_parts_need_their_complement(spark):
    blob = "aB3" + "x" * 37
    texts = [f"login=bob {blob}", f"{blob}", "login=bob https://h.example.org", f"AKIAABCDEFGHIJKL {blob} https://h.example.org/x", "AKIAABCDEFGHIJKL" + " " * 400 + blob, "password=abcdefgh1 login: alice https://h.example.org"]
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secret_scan.secret_scan(table(spark, texts)).where("doc_id > 0").collect()}
    assert got == {1: [], 2: [], 3: ["access", "blob", "url"], 4: ["access"], 5: ["assign", "login", "url"]}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_contamination(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, t in texts:
        w, hit, which = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    which |= found
        out.append((i, len(w), len(hit), len(which), sha(",".join(sorted(which)).encode()), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", broadcast)
    rng = random.Random(9)
    vocabulary = ["the", "The", "é", "É", "straße", "STRASSE", "a1", "b2", "c", "d`e", "f"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 10, 14])))) for k in range(12)] + [(None, "only this one"), (3, None), (3, "x y z")]
    texts = [*WEIRD, "Only THIS one", "É", *(" - ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + " " + (rng.choice(items)[1] or "") for _ in range(60))]
    d = table(spark, texts)
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got.drop("n_near")) == brute_contamination([(r["doc_id"], r["text"]) for r in d.collect()], items)


def test_proximity_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=14))) for k in range(8)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(10)]
    for _ in range(40):
        w = words(rng.choice(items)[1])
        for at in rng.sample(range(14), rng.randint(0, 4)):
            w[at] = rng.choice([*vocabulary, "rare", f"only{at}"])
        if rng.random() < 0.3:
            w.insert(rng.randrange(14), "put")
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 3)) + w + rng.choices(vocabulary, k=rng.randint(0, 3))))
    windows = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(5)}

    def places(t):
        w, near, exact = words(t), set(), set()
        for at in range(len(w)):
            for x in windows:
                same = sum(p == q for p, q in zip(w[at : at + 10], x))
                (exact if same == 10 else near if same >= 8 else set()).add(at)
        return len(near - exact)

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_near"] for r in got} == {i: places(t) for i, t in enumerate(texts)}


def test_decontaminated_keeps_clean_rows_and_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    near = passage.replace("five", "5five")
    d = spark.createDataFrame([(1, f"x {passage} y", "k"), (2, "clean five five", "k"), (None, "null id", "k"), (3, near, "k")], "doc_id long, text string, pos string")
    items = spark.createDataFrame([(0, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminated(d, items).orderBy("doc_id").collect()] == [None, 2, 3]
    assert decontaminate.contamination(d, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), items).count() == 0
    shared = spark.createDataFrame([(1, passage), (1, "clean"), (1, "clean")], "doc_id long, text string")
    assert rows(decontaminate.decontaminated(shared, items)) == [(1, "clean"), (1, "clean")]
    odd = d.withColumns({c: F.lit(1) for c in ("_bad", "bad_id", "Bad_hash", "hash", "w", "term", "id", "at", "window_no")})
    assert decontaminate.decontaminated(odd, items).columns == odd.columns and decontaminate.decontaminated(odd, items).count() == 3
    long = spark.createDataFrame([(1, "word " * 200_000 + passage)], "doc_id long, text string")
    assert decontaminate.contamination(long, items).first()["n_hit"] == 11
    assert decontaminate.contamination(d, items).where("doc_id = 3").first()["n_near"] > 0


def within_one(a, b):
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return abs(len(a) - len(b)) <= 1 and p + s >= max(len(a), len(b)) - 1


def brute_lines(data, hashes, fuzzy=5):
    """(id, text) -> (kept text, gone, near) by comparing each line with all earlier ones."""
    seen, near, out = {}, {}, {}
    for key in sorted({r for r in data if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        kept, gone, gone_near = [], 0, 0
        for line in key[1].split("\n"):
            w = tuple(line.split(" "))
            if not line.strip(' '):
                kept.append(line)
                continue
            old = w in seen
            if not old:
                near[w] = len(w) >= fuzzy and any(len(v) >= fuzzy and within_one(w, v) for v in seen)
                seen[w] = True
            if old or near[w]:
                gone += 1
                gone_near += near[w]
            else:
                kept.append(line)
        out[key] = ("\n".join(kept), gone, gone_near)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    v = [f"w{i}" for i in range(5)]
    lines = [" ".join(rng.choices(v, k=rng.randint(1, 20))) for _ in range(60)] + ["", "  "]

    def changed(line):
        w = line.split(" ")
        i, k = rng.randrange(len(w)), rng.randrange(3)
        return " ".join(w[:i] + ([rng.choice(v)] if k == 0 else [rng.choice(v), w[i]] if k == 1 else []) + w[i + 1 :])

    data = [(i % 70, "\n".join(changed(rng.choice(lines)) if rng.random() < 0.5 else rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    data += [(None, lines[0] * 2), (5, None), (6, ""), data[3], (90, "x " * 3000 + "end"), (91, "y " + "x " * 3000 + "end")]
    d = spark.createDataFrame([(i, t, 1, "a") for i, t in data], "doc_id long, text string, lines_gone int, first string")
    hashes = {r["text"]: r["h"] for r in d.select("text", F.xxhash64("text").alias("h")).collect()}
    brute = brute_lines(data, hashes)
    want = Counter((i, *(brute[i, t] if t is not None else (None, 0, 0))) for i, t in data)
    got = Counter((r["doc_id"], r["text"], r["lines_gone"], r["lines_near"]) for r in line_dedup.dedup_lines(d).collect())
    assert got == want
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    odd = d.withColumns({c: F.lit(1) for c in ("_gone", "_near", "_p", "_id", "_hash", "gone", "Near", "of_id", "hash", "loses", "p", "bits", "piece", "maybe")})
    assert sorted(line_dedup.dedup_lines(odd).columns) == sorted([*odd.columns, "lines_near"])
    assert Counter((r["doc_id"], r["text"], r["lines_gone"], r["lines_near"]) for r in line_dedup.dedup_lines(odd).collect()) == want
