"""Line deduplication within an edit bound by a deletion-neighbourhood join; DataFrame functions only.

A line is a sequence of words, what stands between single spaces. The edit bound is one word (put in, left out or
replaced) where that is at most a fifth of the line, from ``fuzzy`` = 5 words on, and none below. A line goes if an
earlier one (by document id, then line number) is within the bound of it; lines of spaces alone stay.

Near lines meet through hashed keys. Leaving word i out of a line leaves a remainder; the line emits the
remainder's hash with i, and the whole line's hash with every place where a word could be put in. All lines
under one key differ in the word at that one place alone, so each of them is near the earliest of them, and the
earliest is all that a group's map-side minimum carries: no pairs are made within a group. What a key joins is
then verified by the words themselves. Big sides of joins first pass a broadcast bit set sized by the counted keys.

Two lines within the bound share their first or their last half, so only lines that share a half with another
line emit keys at all. Remainders' hashes come from running sums (xor) of position-tagged word hashes: linear in
a line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.bit_filter import bits_of, maybe_in, with_maybe
from corpusforge.llm.common import fresh, only, stored
from corpusforge.session import shared_folder

#: Words of a line from which on one word may differ.
FUZZY_WORDS = 5


def _line_words(line: Column) -> Column:
    return F.split(line, " ", -1)


def _halves(w: Column, n: Column) -> Column:
    """Hashes of a line's beginning and end, as long as a line of n words, and of n - 1, compares them.

    In long lines they are somewhat shorter than half, in steps of four words, so that n and n - 1 mostly give the same.
    """

    def of(length: Column) -> list[Column]:
        half = F.when(length < 16, F.floor(length / 2)).otherwise(F.floor(length / 8) * 4).cast("int")
        return [F.xxhash64(F.slice(w, F.lit(1), half), half, F.lit(0)), F.xxhash64(F.slice(w, n - half + 1, half), half, F.lit(1))]

    return F.array_distinct(F.array(*of(n), *of(n - 1)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, line_no, line, h1, h2 of every line that isn't blank."""
    rows = only(docs, id_col, text_col).toDF("id", "text").where("text is not null")
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where("trim(line) <> ''").select("id", "text_hash", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(7)).alias("h2"))


def _within_one(a: Column, b: Column) -> Column:
    """Are two word arrays at most one word edit apart?"""
    n, m = F.size(a), F.size(b)

    def agree(x: Column, y: Column) -> Column:
        first_other = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        return F.when(first_other > 0, first_other - 1).otherwise(F.least(n, m))

    return (F.abs(n - m) <= 1) & (agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= F.greatest(n, m) - 1)


def _candidates(docs: DataFrame, seen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, w, ord of the distinct lines that share a half with another one; ``ord`` numbers them in the lines' order."""
    halved = seen.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = halved.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half").checkpoint()
    hinted = maybe_in(halved, bits_of(shared, "half"), "half").join(shared, "half").select("h1").distinct().checkpoint()
    # Their words come from the texts once more: lines of words leave the documents, not whole texts.
    held = maybe_in(_lines(docs, id_col, text_col), bits_of(hinted, "h1"), "h1")
    firsts = held.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "line_no")).alias("first"), F.any_value("line").alias("line"))
    ordered = firsts.join(hinted, "h1").orderBy("first")
    return ordered.select("h1", "h2", _line_words(F.col("line")).alias("w"), F.monotonically_increasing_id().alias("ord")).checkpoint()


def _keys(candidates: DataFrame) -> DataFrame:
    """ord and key of every line's neighbourhood."""
    laid = candidates.select("ord", "w").repartition("ord")  # the words of a line stay together from here on
    spread = laid.select("ord", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    tagged = spread.select("ord", "n", "at", F.xxhash64("word", "at").alias("here"), F.xxhash64("word", F.col("at") - 1).alias("moved"))
    line = Window.partitionBy("ord").orderBy("at")
    before, until = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.coalesce(F.bit_xor("here").over(before), F.lit(0).cast("long"))
    right = F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(until))
    summed = tagged.select("ord", "n", "at", left.bitwiseXOR(right).alias("rest"), F.bit_xor("here").over(whole).alias("all"))
    without, into, at_end = F.xxhash64("rest", "at", F.col("n") - 1), F.xxhash64("all", "at", "n"), F.xxhash64("all", "n", "n")
    keys = F.when(F.col("at") == F.col("n") - 1, F.array(without, into, at_end)).otherwise(F.array(without, into))
    return summed.select("ord", F.explode(keys).alias("key"))


def repeated_lines(docs: DataFrame, fuzzy: int = FUZZY_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, gone (line numbers) and near (how many of them for an earlier line that isn't the same) of the
    texts that lose lines."""
    shared_folder(docs.sparkSession)
    w = _line_words(F.col("line"))
    lines = _lines(docs, id_col, text_col).select("id", "text_hash", "line_no", "h1", "h2", w.alias("w"))
    n = F.size("w")
    seen, drop = stored(lines.select("id", "text_hash", "line_no", "h1", "h2", F.when(n >= fuzzy, _halves(F.col("w"), n)).alias("halves")))  # hashes of lines, without text

    candidates = _candidates(docs, seen, id_col, text_col)
    groups = _keys(candidates).groupBy("key").agg(F.min("ord").alias("lead"), F.max("ord").alias("last")).where("lead < last").select("key", "lead").checkpoint()
    pairs = maybe_in(_keys(candidates), bits_of(groups, "key"), "key").join(groups, "key").where("lead < ord").select("ord", "lead").distinct()
    earlier = candidates.select(F.col("ord").alias("lead"), F.col("w").alias("w_earlier"))
    near = pairs.join(candidates.select("ord", "h1", "h2", "w"), "ord").join(earlier, "lead").where(_within_one(F.col("w"), F.col("w_earlier"))).select("h1", "h2", F.lit(True).alias("near")).distinct()

    place = F.struct("id", "text_hash", "line_no")
    repeated = seen.groupBy("h1").agg(F.count("*").alias("c")).where("c > 1").select("h1").checkpoint()
    copies = maybe_in(seen, bits_of(repeated, "h1"), "h1").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "first")
    doomed = copies.join(near, ["h1", "h2"], "full_outer").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")).checkpoint()
    gone = maybe_in(seen.select("id", "text_hash", "line_no", "h1", "h2"), bits_of(doomed, "h1"), "h1").join(doomed, ["h1", "h2"]).where(F.col("near") | (place != F.col("first")))
    listed = gone.groupBy("id", "text_hash").agg(F.collect_set(F.struct("line_no", "near")).alias("x"))
    out = listed.select("id", "text_hash", F.col("x.line_no").alias("gone"), F.size(F.filter("x", lambda x: x["near"])).alias("near")).checkpoint()
    drop()
    return out


def dedup_lines(docs: DataFrame, fuzzy: int = FUZZY_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the text without the lines that go, and two columns more, ``lines_gone`` and
    ``lines_near`` (gone for a line that isn't the same); they replace columns of those names. Other columns may have
    any names.

    A null text stays null; an empty one, and lines of spaces alone, stay as they are; a document all of whose lines
    go keeps its row with an empty text; a text that is one very long line is one line. Rows that repeat an id and a
    text count as one document and keep the same lines; null ids come first in the order. Documents that share an id
    are told apart by their texts, and ordered by their hashes. An empty table gives an empty one.
    """
    own_id, own_hash, own_gone, own_near = fresh([*docs.columns, "lines_gone", "lines_near"], "of_id", "of_hash", "gone", "near")
    lists = repeated_lines(docs, fuzzy, id_col, text_col).toDF(own_id, own_hash, own_gone, own_near)
    hash_, loses = fresh([*docs.columns, *lists.columns], "hash", "loses")
    text = F.col(f"`{text_col}`")
    # Documents that surely lose nothing aren't shuffled.
    told = with_maybe(docs.withColumn(hash_, F.xxhash64(text)), bits_of(lists, own_hash), loses, hash_)
    losing = told.where(F.col(loses)).join(lists, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(hash_) == F.col(own_hash)), "left")
    whole = told.where(~F.col(loses)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema])
    joined = losing.unionByName(whole)
    # The array of one binds the lines to a name, so they are cut once; array_except is linear in them.
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own_gone)), lambda i: F.get(lines, i)))
    cut = F.when(F.col(own_gone).isNull(), text).otherwise(F.array_join(kept[0], "\n"))
    rest = [F.col(f"`{c}`") if c != text_col else cut.alias(text_col) for c in docs.columns if c not in ("lines_gone", "lines_near")]
    return joined.select(*rest, F.coalesce(F.size(own_gone), F.lit(0)).alias("lines_gone"), F.coalesce(F.col(own_near).cast("int"), F.lit(0)).alias("lines_near"))
