"""Near-duplicates by DartMinHash signatures, banded joining and an exact check.

An element of weight w is a region of length w. Darts fall on it in the order of their ranks, as a Poisson
process whose arrivals, places and coordinates come from hashes of the element alone, so equal elements of
different documents get the same darts. A document keeps, for each coordinate of its signature, the earliest dart
inside its elements' regions. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Only about (ln t + c) darts for each of the t coordinates are thrown, whatever the number of elements.

Documents whose words are the same are one node. Nodes that agree in all rows of a band meet in its bucket; buckets
of one node go first, and a bit set keeps their nodes out of what follows. Then every node is compared with two hubs
of each of its buckets: the most central one, which is the member that meets most others over all bands, and one
more. So this makes two pairs for each member at most, and a copy that is near its original alone finds it, since
the original is the most central. Agreement of signatures far from the threshold decides; pairs nearer to it are
decided by their exact similarity where they would join two classes.

Two hubs test every pair of a bucket of three. In larger buckets that still hold several classes, members outside
the bucket's largest class are compared with all members of other classes, in cells of bounded size and without
emitting pairs; a cell decides every pair that signatures leave open by its exact similarity and returns only the
joins of classes. So no pair that shares a band is left untested, and the work is the product of a bucket's size and
what lies outside its largest class, not the square of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.bit_filter import bits_of, maybe_in, with_maybe
from corpusforge.llm.common import by_chunks, fresh, only, text_or_empty
from corpusforge.operators.graph import components
from corpusforge.session import shared_folder

SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates of a signature, and rows of a band. A pair at the threshold shares a band but for 6 in 100,000.
COORDINATES, BAND_ROWS = 192, 6
#: Standard deviations of a signature's agreement beyond which it decides by itself.
SURE = 4.0
#: Darts for each coordinate beyond ln t, and documents that throw together.
EXTRA, TOGETHER = 3.0, 128
#: Members of a bucket that a cell holds on either side.
CELL = 2048
#: Words whose hashes a worker keeps.
KEPT_WORDS = 300_000

_WORD = re.compile(r"\w+")
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Shingler:
    """Hashes of shingles: 64 bits from five words in a row, or from all words of a shorter text."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def shingles(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct shingle hashes, rising, and how often each occurs."""
        flat = [w for t in texts for w in t]
        missing = set(flat).difference(self.known)
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known = {}
            missing = set(flat)
        for w in missing:
            self.known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))
        padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
        out, at = [], 0
        rolled = np.zeros(len(hashes), np.uint64)
        for i in range(SHINGLE):
            rolled = _mix(rolled + _GOLD) ^ padded[i : i + len(hashes)]
        for t in texts:
            n = len(t)
            if n >= SHINGLE:
                out.append(np.unique(rolled[at : at + n - SHINGLE + 1], return_counts=True))
            elif n:
                one = np.zeros(1, np.uint64)
                for h in hashes[at : at + n]:
                    one = _mix(one + _GOLD) ^ h
                out.append((one, np.ones(1, np.int64)))
            else:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            at += n
        return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray | None]], t: int = COORDINATES) -> list[np.ndarray | None]:
    """DartMinHash signatures (t numbers of 8 bits) of weighted sets (elements, weights; None: all 1); None for an empty set."""
    out: list[np.ndarray | None] = [None] * len(sets)
    waiting = [i for i, (elements, _) in enumerate(sets) if len(elements)]
    spread = np.log(t) + EXTRA
    while waiting:
        left = []
        for at in range(0, len(waiting), TOGETHER):
            some = waiting[at : at + TOGETHER]
            found = _throw([sets[i] for i in some], t, spread)
            for i, signature in zip(some, found, strict=True):
                if signature is None:
                    left.append(i)
                else:
                    out[i] = signature
        waiting, spread = left, 2 * spread
    return out


def _throw(sets: list[tuple[np.ndarray, np.ndarray | None]], t: int, spread: float) -> list[np.ndarray | None]:
    """Signatures from the darts of rank below spread / weight of the set; None where a coordinate got none."""
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([np.ones(len(e)) if w is None else np.asarray(w, float) for e, w in sets])
    sizes = [len(e) for e, _ in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    bound = spread / np.bincount(owner, weights=weights, minlength=len(sets))
    keys: list[np.ndarray] = []
    low, high, cell = 0.0, 1.0, 0
    while (inside := np.flatnonzero(weights > low)).size:  # the weight axis in cells [0, 1), [1, 2), [2, 4), ...
        rate = t * (high - low)
        seed = _mix(elements[inside] ^ _mix(np.array([cell + 1], np.uint64) + _GOLD))
        who, weight = owner[inside], weights[inside]
        limit, rank, step = bound[who], np.zeros(len(inside)), 0
        while len(seed):
            step = (step + int(_GOLD)) % (1 << 64)
            h = _mix(seed + np.uint64(step))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
            on = rank < limit
            seed, who, weight, limit, rank, h = seed[on], who[on], weight[on], limit[on], rank[on], h[on]
            more = _mix(h ^ _B)
            if high > 1 or (weight < high).any():
                here = low + (high - low) * (_mix(more + _GOLD) >> np.uint64(11)).astype(float) * 2.0**-53 < weight
            else:
                here = slice(None)
            place = (who[here] * t).astype(np.uint64) + (more[here] >> np.uint64(32)) % np.uint64(t)
            scaled = (rank[here] / limit[here] * 2.0**31).astype(np.uint64)
            keys.append(place << np.uint64(47) | scaled << np.uint64(16) | (more[here] & np.uint64(0xFFFF)))
        low, high, cell = high, 2 * high, cell + 1
    darts = np.sort(np.concatenate(keys))
    place = darts >> np.uint64(47)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    table = np.zeros(len(sets) * t, np.uint8)
    hit = np.zeros(len(sets) * t, bool)
    table[place[first].astype(np.int64)] = (darts[first] & np.uint64(0xFF)).astype(np.uint8)
    hit[place[first].astype(np.int64)] = True
    full = hit.reshape(len(sets), t).all(axis=1)
    return [row if ok else None for row, ok in zip(table.reshape(len(sets), t), full, strict=True)]


def signature_table(docs: DataFrame, weighted: bool, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, key (16 bytes, equal for equal words) and signature (null without words) of every row."""
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part, texts in by_chunks(batch, 2):
                words = [words_of(t) for t in texts]
                keys = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
                sets = [(e, n if weighted else None) for e, n in shingler.shingles(words)]
                made = [None if s is None else s.tobytes() for s in signatures(sets)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["id", "text_hash", "key", "signature"])

    return source.mapInArrow(run, f"id {kind}, text_hash long, key binary, signature binary")


def likeness(same: np.ndarray) -> np.ndarray:
    """The similarity that rows of agreeing coordinates stand for; one in 256 agrees by chance."""
    return (same.mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _agreement(pairs: DataFrame) -> DataFrame:
    """a, b and agree: the similarity by which their signatures sa and sb agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness(sa == sb))], names=["a", "b", "agree"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, agree double")


def _sets(asked: DataFrame, places: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, elements and counts (the shingle hashes, rising, and how often each occurs) of the nodes ``asked``."""
    wanted = places.join(asked, "node").select("node", F.col("rep.id").alias("p_id"), F.col("rep.text_hash").alias("p_hash")).checkpoint()
    texts = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = maybe_in(texts, bits_of(wanted, "p_hash"), "hash")
    held = texts.join(wanted, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("hash") == F.col("p_hash"))).select("node", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part, chunk in by_chunks(batch, 1):
                sets = shingler.shingles([words_of(t) for t in chunk])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in sets], pa.binary())], names=["node", "elements", "counts"])

    return held.mapInArrow(shingled, "node long, elements binary, counts binary").dropDuplicates(["node"]).checkpoint()


def _exact(pairs: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose exact similarity is at least ``similarity``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for ea, ca, eb, cb in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                x, y, m, n = np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64), np.frombuffer(ca, np.int32), np.frombuffer(cb, np.int32)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both, total = (np.minimum(m[i], n[j]).sum(), m.sum() + n.sum()) if weighted else (len(i), len(x) + len(y))
                near.append(both >= similarity * (total - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "ca", "eb", "cb")
    return joined.mapInArrow(judged, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """``rows`` with the label of each one's ``node``; a node without one is its own."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def _near_labels(links: DataFrame) -> DataFrame:
    """node, label: the least node within two links (a, b) of each node; equal labels are of one component."""
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")), F.struct(F.col("a").alias("node"), F.col("a").alias("other")), F.struct(F.col("b").alias("node"), F.col("b").alias("other")))
    both = links.select(F.explode(ways).alias("e")).select("e.node", "e.other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return both.join(least.select(F.col("node").alias("other"), "least"), "other").groupBy("node").agg(F.min("least").alias("label")).checkpoint()


def _merged(labels: DataFrame, joins: DataFrame) -> DataFrame:
    """node, label: ``labels`` with the labels that ``joins`` connects made one; a label may be a node without a row."""
    merged = components(joins).select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = merged.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return moved.unionByName(alone).checkpoint()


def _cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """number, band, chunk, team, node, label, minor, visitor: the members of unsettled buckets, once for each cell.

    A bucket is unsettled if it holds four members or more of several classes. Its members are dealt to chunks of
    about CELL as residents; those outside the largest class (``minor``) also to teams of about CELL, each of which
    visits every chunk. A cell is a chunk and a team: its visitors are to be compared with its residents.
    """
    placed = _labelled(members.where("n >= 4"), labels)
    by_class = placed.groupBy("band", "label").agg(F.count("*").alias("c"))
    open_ = by_class.groupBy("band").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("most")).where("most.c < size")
    open_ = open_.select("band", F.col("most.label").alias("major"), F.ceil(F.col("size") / CELL).cast("int").alias("chunks"), F.ceil((F.col("size") - F.col("most.c")) / CELL).cast("int").alias("teams"))
    held = placed.join(open_, "band").withColumn("minor", F.col("label") != F.col("major"))
    home, team = F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(12)), F.col("teams")).cast("int")
    stays = F.transform(F.sequence(F.lit(0), F.col("teams") - 1), lambda t: F.struct(F.col("home").alias("chunk"), t.alias("team")))
    visits = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.col("own").alias("team")))
    at = F.when(F.col("minor"), F.array_union(stays, visits)).otherwise(stays)
    dealt = held.withColumns({"home": home, "own": team}).withColumn("at", F.explode(at))
    visitor = F.col("minor") & (F.col("at.team") == F.col("own"))
    return dealt.select("number", "band", "at.chunk", "at.team", "node", "label", "minor", visitor.alias("visitor"), (F.col("at.chunk") == F.col("home")).alias("resident"))


def open_pairs(signatures_: np.ndarray, cell: dict[str, np.ndarray], number: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j's): visitors i and residents j of another label that agree in ``least`` or more and whose first common
    band is ``number``. Of two minor nodes the one with the lesser number visits. So a pair comes once, whatever
    number of bands and cells it shares."""
    label, node = cell["label"], cell["node"]
    residents = np.flatnonzero(cell["resident"])
    for i in np.flatnonzero(cell["visitor"]):
        j = residents[(label[residents] != label[i]) & (~cell["minor"][residents] | (node[residents] > node[i]))]
        same = signatures_[j] == signatures_[i]
        near = likeness(same) >= least
        j, same = j[near], same[near]
        first = same.reshape(len(j), signatures_.shape[1] // BAND_ROWS, BAND_ROWS).all(axis=2).argmax(axis=1)
        if (first == number).any():
            yield int(i), j[first == number]


def true_joins(pairs: Iterator[tuple[int, np.ndarray]], elements: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Two labels for each of ``pairs`` that is truly similar and still joins two classes, by the sets of elements."""
    flat = np.unique(np.concatenate(elements), return_inverse=True)[1]
    ends = np.cumsum([len(e) for e in elements])
    ids = np.split(flat, ends[:-1])
    sizes = np.array([c.sum() for c in counts])
    root, mark, out = labels.copy(), np.zeros(int(flat.max()) + 1, np.int64), []
    for i, j in pairs:
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        mark[ids[i]] = counts[i]
        starts = np.cumsum([0, *(len(ids[k]) for k in j[:-1])])
        both = np.add.reduceat(np.minimum(mark[np.concatenate([ids[k] for k in j])], np.concatenate([counts[k] for k in j])), starts)
        mark[ids[i]] = 0
        for k in j[both >= similarity * (sizes[i] + sizes[j] - both)].tolist():
            if root[k] != root[i]:
                out.append((int(labels[i]), int(labels[k])))
                root[root == root[k]] = root[i]
    return out


_CELL = ["number", "band", "chunk", "team", "node", "label", "minor", "visitor", "resident"]
_CELL_SCHEMA = "number int, band long, chunk int, team int, node long, label long, minor boolean, visitor boolean, resident boolean"


def _last_joins(cells: DataFrame, signed: DataFrame, docs: DataFrame, least: float, similarity: float, weighted: bool, id_col: str, text_col: str) -> DataFrame:
    """a, b: labels that truly similar pairs join, of all pairs of two classes in ``cells``.

    Sets of shingles are fetched only for nodes that signatures leave an open pair.
    """

    def pairs_of(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        sigs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
        cell = {c: group[c].to_numpy() for c in _CELL[4:]}
        return open_pairs(sigs, cell, group["number"][0].as_py(), least)

    def asking(group: pa.Table) -> pa.Table:
        hit = np.zeros(group.num_rows, bool)
        for i, j in pairs_of(group):
            hit[i] = hit[j] = True
        return group.select(_CELL).filter(pa.array(hit))

    def joining(group: pa.Table) -> pa.Table:
        elements = [np.frombuffer(x, np.uint64) for x in group["elements"].to_pylist()]
        counts = [np.frombuffer(x, np.int32) for x in group["counts"].to_pylist()] if weighted else [np.ones(len(e), np.int32) for e in elements]
        joins = true_joins(pairs_of(group), elements, counts, group["label"].to_numpy(), similarity)
        return pa.table({"a": pa.array([x for x, _ in joins], pa.int64()), "b": pa.array([y for _, y in joins], pa.int64())})

    place = ["band", "chunk", "team"]
    asked = cells.join(signed.select("node", "signature"), "node").groupBy(*place).applyInArrow(asking, _CELL_SCHEMA).checkpoint()
    sets = _sets(asked.select("node").distinct(), signed, docs, id_col, text_col)
    return asked.join(signed.select("node", "signature"), "node").join(sets, "node").groupBy(*place).applyInArrow(joining, "a long, b long").distinct().checkpoint()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, class_id (the least id of the row's class), class_rows, node_rows and keeps of every row.

    A class holds the documents that links of ``similarity`` or more connect; ``weighted`` counts how often a
    shingle occurs (similarity is the sum of the lesser counts over that of the greater ones), else each counts
    once. ``keeps`` is true for the rows of the class's first document by (id, text hash); ``node_rows`` says how
    many rows repeat that very id and text, so one of them can be chosen.

    Texts without words (null, empty, signs alone) have equal words and so are one class; texts of fewer than five
    words are near only if their words are equal; a very long text is one set like any other and costs memory in
    proportion to its words. Null ids are kept and come first; ties go to the lesser text hash; other columns are
    ignored; an empty table gives none.
    """
    shared_folder(docs.sparkSession)
    rows = signature_table(docs, weighted, id_col, text_col).checkpoint()  # about 0.3 kB for each row: the texts are read once
    place = F.struct("id", "text_hash")
    nodes = rows.groupBy("key").agg(F.min(place).alias("rep"), F.any_value("signature").alias("signature"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()).checkpoint()

    bands = F.array(*[F.xxhash64(F.substring("signature", 1 + BAND_ROWS * i, BAND_ROWS), F.lit(i)) for i in range(COORDINATES // BAND_ROWS)])
    banded = nodes.where("signature is not null").select("node", F.posexplode(bands).alias("number", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    members = maybe_in(banded, bits_of(shared, "band"), "band").join(shared, "band").checkpoint()
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    signed = nodes.select("node", "rep", "signature").join(central, "node").checkpoint()

    hubs = members.join(signed.select("node", "met"), "node").groupBy("band").agg(F.max_by("node", F.struct("met", "node")).alias("hub"), F.min_by("node", F.xxhash64("node", F.lit(5))).alias("one"), F.max_by("node", F.xxhash64("node", F.lit(5))).alias("other"))
    hubs = hubs.select("band", F.array("hub", F.when(F.col("one") != F.col("hub"), F.col("one")).otherwise(F.col("other"))).alias("hubs"))
    met = members.join(hubs, "band").select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(signed.select(F.col("node").alias(end), F.col("signature").alias(f"s{end}")), end)
    margin = SURE * (similarity * (1 - similarity) / COORDINATES) ** 0.5
    agreed = _agreement(pairs).where(F.col("agree") >= similarity - margin).checkpoint()

    sure = agreed.where(F.col("agree") >= similarity + margin).select("a", "b")
    # Pairs that agreement leaves open count if they are truly similar; those whose ends sure links join in two steps need no test.
    labels = _near_labels(sure)
    apart = agreed.where(F.col("agree") < similarity + margin).select("a", "b")
    for end in ("a", "b"):
        apart = _labelled(apart, labels, end, f"l{end}")
    apart = apart.where("la <> lb").select("a", "b").checkpoint()
    sets = _sets(apart.select(F.explode(F.array("a", "b")).alias("node")).distinct(), signed, docs, id_col, text_col)
    labels = components(sure.unionByName(_exact(apart, sets, similarity, weighted)))
    # What is left of the crowded buckets: no pair of two classes stays untested.
    cells = _cells(members, labels).checkpoint()
    last = _last_joins(cells, signed, docs, similarity - margin, similarity, weighted, id_col, text_col)
    if not last.isEmpty():
        labels = _merged(labels, last)

    classed = _labelled(nodes.select("node", "key", "rep", "copies"), labels).checkpoint()
    heads = classed.groupBy("label").agg(F.min("rep").alias("head"), F.sum("copies").alias("class_rows"))
    by_key = classed.join(heads, "label").select("key", "head", "class_rows").checkpoint()
    same = rows.groupBy("key", "id", "text_hash").agg(F.count("*").alias("node_rows"))
    out = same.join(by_key, "key").select("id", "text_hash", F.col("head.id").alias("class_id"), "class_rows", "node_rows", place.eqNullSafe(F.col("head")).alias("keeps"))
    return out.select(F.col("id").alias(id_col), "text_hash", "class_id", "class_rows", "node_rows", "keeps", F.explode(F.sequence(F.lit(1), F.col("node_rows").cast("int"))).alias("copy")).drop("copy")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the first by id, then by text hash; of rows that repeat both, any
    one. Nulls, empty and very long texts and empty tables as in ``near_duplicates``; any column names will do."""
    own_id, own_hash, own_rows, own_keeps = fresh(docs.columns, "class_id", "class_hash", "class_rows", "class_keeps")
    found = near_duplicates(docs, similarity, weighted, id_col, text_col).where("not keeps or node_rows > 1")
    touched = found.select(F.col(f"`{id_col}`").alias(own_id), F.col("text_hash").alias(own_hash), F.col("node_rows").alias(own_rows), F.col("keeps").alias(own_keeps)).distinct().checkpoint()
    hash_, maybe = fresh([*docs.columns, *touched.columns], "hash", "maybe")
    # Documents that surely stay, and are there once, aren't shuffled.
    told = with_maybe(docs.withColumn(hash_, F.xxhash64(text_or_empty(text_col))), bits_of(touched, own_hash), maybe, hash_)
    stays = told.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns])
    asked = told.where(F.col(maybe)).join(touched, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(hash_) == F.col(own_hash)), "left")
    alone = asked.where(F.col(own_keeps).isNull())
    repeated = asked.where(F.col(own_keeps)).dropDuplicates([own_id, own_hash])
    return stays.unionByName(alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns]))
