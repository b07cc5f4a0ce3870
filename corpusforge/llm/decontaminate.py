"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only.

A window is ten consecutive words of a test item, or a shorter item whole. The index's terms are three words in a row
(lists of single words would hold half of the corpus): for each term of the test items, the index stores the postings
(term, document, position) of all documents. A window is cut into disjoint terms. Its lists, adjusted by the terms'
offsets, are intersected from the rarest: a window occurs only where all of them meet, and a proximity match, which
may miss ``size - near`` of the words, only where all but so many do, so one of its ``size - near + 1`` rarest lists
holds it. Where no document has a window's term, its list is empty.

Postings, places and the test's terms are all that is shuffled; texts are fetched only for documents that have a
place, and judge it word by word: terms are hashes, and a proximity match has words outside the terms that met. A
bit set sized by the counted terms keeps the other postings out, so windows of any number take the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.bit_filter import bits_of, maybe_in, with_maybe
from corpusforge.llm.common import fresh, only, stored
from corpusforge.session import shared_folder

#: What stands between words (fixed value): ASCII but for digits and letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Consecutive words that make a window; words of it that make a proximity match; words of a term at most.
WINDOW_WORDS, NEAR_WORDS, TERM_WORDS = 10, 8, 3
#: At most so many terms are broadcast for an exact look-up (some 50 bytes each); beyond, a shuffle follows the bit set.
BROADCAST_TERMS = 1_000_000


def words(text: Column) -> Column:
    """A text's words as written; null has none."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN_WORDS, -1), ""), F.array().cast("array<string>"))


def _hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def _term(w: Column, at: Column, length: int) -> Column:
    """The hash of ``length`` words from a place (from 0); equal for words that are equal once A-Z is lower case."""
    return F.xxhash64(F.lit(length), *[F.get(w, at + i) for i in range(length)])


def _folded(text: Column) -> Column:
    """The words in upper case, which is faster than ``lowered`` and joins some words more; texts tell those apart."""
    return words(F.upper(text))


def windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """window_no, n, window (lowered words), folded, items (sorted strings) of every distinct window."""
    cut = only(items, item_col, text_col).toDF("item", "text").select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(lowered(F.col("text"))).alias("w"))
    n = F.size("w")
    starts = cut.where(n > 0).select("item", "w", F.least(n, F.lit(size)).alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).alias("at"))
    held = starts.select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("window")).groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.select(F.monotonically_increasing_id().alias("window_no"), "n", "window", F.transform("window", F.upper).alias("folded"), "items")


def _terms(found: DataFrame, size: int, near: int) -> DataFrame:
    """window_no, misses, length, offset, term: the disjoint terms of every window, and how many of them may be missing."""
    misses = F.when(F.col("n") == size, F.lit(size - near)).otherwise(F.lit(0))
    length = F.greatest(F.lit(1), F.least(F.lit(TERM_WORDS), F.floor(F.col("n") / (misses + 1)).cast("int")))
    placed = found.select("window_no", "n", "folded", misses.alias("misses"), length.alias("length"))
    cut = placed.select("window_no", "misses", "length", "folded", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("length")).cast("int") - 1)).alias("part")).withColumn("offset", F.col("part") * F.col("length"))
    term = F.coalesce(*[F.when(F.col("length") == i, _term(F.col("folded"), F.col("offset"), i)) for i in range(1, TERM_WORDS + 1)])
    return cut.select("window_no", "misses", "length", "offset", term.alias("term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, id, text_hash, pos of every occurrence of a term of ``terms`` (term, length; distinct) in ``docs`` (id, text)."""
    lengths = [r["length"] for r in terms.select("length").distinct().collect()]  # at most TERM_WORDS
    words_ = docs.select("id", _hash("text").alias("text_hash"), _folded(F.col("text")).alias("w"))
    at = words_.select("id", "text_hash", "w", F.posexplode("w").alias("pos", "word"))
    heads = [F.when(F.col("pos") + i <= F.size("w"), F.xxhash64(F.lit(i), "word", *[F.get("w", F.col("pos") + k) for k in range(1, i)])) for i in sorted(lengths)]
    if len(heads) == 1:
        each = at.select("id", "text_hash", "pos", heads[0].alias("term"))
    else:
        each = at.select("id", "text_hash", "pos", F.explode(F.array(*heads)).alias("term"))
    known = terms.select("term")
    if terms.count() <= BROADCAST_TERMS:
        return each.join(F.broadcast(known), "term")
    return maybe_in(each, bits_of(known, "term"), "term").join(known, "term")


def _places(docs: DataFrame, found: DataFrame, size: int, near: int) -> DataFrame:
    """id, text_hash, at, window_no: where enough of a window's lists meet; its words are still to be compared."""
    cut = _terms(found, size, near).checkpoint()
    distinct = cut.select("term", "length").distinct().checkpoint()
    if distinct.isEmpty():
        return docs.select("id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("window_no")).where("false")
    index, drop = stored(postings(docs, distinct))
    length_of = index.groupBy("term").agg(F.count("*").alias("list"))
    rarest = Window.partitionBy("window_no").orderBy(F.coalesce("list", F.lit(0)), "offset")
    ranked = cut.join(length_of, "term", "left").withColumns({"rank": F.row_number().over(rarest), "parts": F.count("*").over(Window.partitionBy("window_no"))}).checkpoint()

    place = ["id", "text_hash", "at", "window_no"]
    small = ranked.count() <= BROADCAST_TERMS

    def starts(which: str) -> DataFrame:
        some = ranked.where(which)
        adjusted = index.join(F.broadcast(some) if small else some, "term").where("pos >= offset")
        return adjusted.select("id", "text_hash", (F.col("pos") - F.col("offset")).alias("at"), "window_no", (F.col("parts") - F.col("misses")).alias("least"))

    # The places of the rarest lists, then of the others those that stand at one of them.
    seeds = starts("rank <= misses + 1").groupBy(*place, "least").agg(F.count("*").alias("lists"))
    others = starts("rank > misses + 1").groupBy(*place).agg(F.count("*").alias("rest"))
    same_id = F.col("id").eqNullSafe(F.col("o_id"))
    keyed = others.toDF("o_id", "o_hash", "o_at", "o_window", "rest")
    met = seeds.join(keyed, same_id & (F.col("text_hash") == F.col("o_hash")) & (F.col("at") == F.col("o_at")) & (F.col("window_no") == F.col("o_window")), "left")
    out = met.where(F.col("lists") + F.coalesce("rest", F.lit(0)) >= F.col("least")).select(*place).checkpoint()
    drop()
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, near: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row.

    n_hit counts the words inside occurrences of windows, each once; n_near the places where at least ``near``
    of a window's ``size`` words stand at their offsets, but not all; a place begins at a word of the text. ``near``
    = ``size`` looks for no proximity.

    A null or empty text has no words; an item without words has no window; a null item id counts as the empty
    string; items may repeat. Null ids are kept; repeated rows (same id and text) give repeated results; a very long
    text is one row of words where it has a place; other columns are ignored; an empty table gives an empty one,
    without items nothing is hit.
    """
    rows = only(docs, id_col, text_col).toDF("id", "text")
    marked = _marked(rows, windows(items, size, item_col, item_text_col), size, near)
    counted = rows.select("id", _hash("text").alias("text_hash"), F.size(words(F.col("text"))).alias("n_words"))
    out = counted.join(marked, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    hit, which = F.coalesce("n_hit", F.lit(0)), F.coalesce("which", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size(which).cast("long").alias("n_items"),
        F.sha2(F.array_join(which, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def _marked(rows: DataFrame, wanted: DataFrame, size: int, near: int) -> DataFrame:
    """m_id, m_hash, n_hit, which (items) and n_near of the texts of ``rows`` (id, text) that have any."""
    shared_folder(rows.sparkSession)
    found = wanted.checkpoint()
    places = _places(rows, found, size, near)
    asked = places.join(found.select("window_no", "n", "window", "items"), "window_no").groupBy("id", "text_hash").agg(F.collect_list(F.struct("at", "n", "window", "items")).alias("asked")).checkpoint()

    # The texts that have a place, and their places' words.
    hashed = rows.withColumn("hash", _hash("text"))
    held = maybe_in(hashed, bits_of(asked, "text_hash"), "hash").join(asked.withColumnRenamed("id", "a_id"), F.col("id").eqNullSafe(F.col("a_id")) & (F.col("hash") == F.col("text_hash")))

    def agreeing(w: Column, x: Column) -> Column:
        own = F.slice(w, x["at"] + 1, x["n"])
        return F.size(F.filter(F.zip_with(own, x["window"], lambda p, q: p.eqNullSafe(q)), lambda same: same))

    def compared(w: Column) -> Column:
        return F.transform("asked", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["items"].alias("items"), agreeing(w, x).alias("same")))

    # The array of one binds the words to a name, so a text is cut once and not for each place.
    told = held.select("id", "text_hash", F.transform(F.array(words(lowered(F.col("text")))), compared)[0].alias("told")).dropDuplicates(["id", "text_hash"]).checkpoint()
    hits = F.filter("told", lambda x: x["same"] == x["n"])
    nears = F.filter("told", lambda x: (x["n"] == size) & (x["same"] >= near) & (x["same"] < size))
    split = told.select("id", "text_hash", hits.alias("hits"), F.array_distinct(F.transform(nears, lambda x: x["at"])).alias("nears"))
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))
    which = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return split.select(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"), F.size(inside).alias("n_hit"), which.alias("which"), F.size(F.array_except("nears", F.transform("hits", lambda h: h["at"]))).alias("n_near")).where("n_hit > 0 or n_near > 0")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns, whatever their names.

    Rows are told by id and text, so a clean row stays if another one of its id is contaminated; nulls, empty and very
    long texts, repeated rows and empty tables as in ``contamination``.
    """
    bad_id, bad_hash, hash_ = fresh(docs.columns, "bad_id", "bad_hash", "hash")
    exact = _marked(only(docs, id_col, text_col).toDF("id", "text"), windows(items, size, item_col, item_text_col), size, size)  # proximity decides nothing here
    bad = exact.where("n_hit > 0").select(F.col("m_id").alias(bad_id), F.col("m_hash").alias(bad_hash)).distinct().checkpoint()
    (maybe,) = fresh([*docs.columns, bad_id, bad_hash, hash_], "maybe")
    # Documents that surely stay aren't shuffled.
    told = with_maybe(docs.withColumn(hash_, _hash(text_col)), bits_of(bad, bad_hash), maybe, hash_)
    asked = told.where(F.col(maybe)).join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)) & (F.col(hash_) == F.col(bad_hash)), "left_anti")
    return told.where(~F.col(maybe)).unionByName(asked).drop(hash_, maybe)
