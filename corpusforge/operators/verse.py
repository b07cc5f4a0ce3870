"""Verse: stress profiles, metre, line ends, rhyme, sound, and sentences across lines.

Stressed lines carry '+' before the stressed vowel. A profile is a string with one code for each syllable, of words of
several syllables S (stressed), u (not) or x (a word without a mark), of words of one s (marked) or x (not).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.config import LATIN, RUSSIAN_VOWELS, LanguageProfile
from corpusforge.functions import text as X
from corpusforge.session import shared_folder

#: Metres: (length of the foot, place of its strong syllable from 0) (fixed values).
METRES = {"iamb": (2, 1), "trochee": (2, 0), "dactyl": (3, 0), "amphibrach": (3, 1), "anapaest": (3, 2)}


def profile(line: X.Text, vowels: str = RUSSIAN_VOWELS) -> Column:
    """A stressed line's profile."""
    words = F.regexp_extract_all(F.lower(X._c(line)), F.lit(r"[\p{L}+]+(?:-[\p{L}+]+)*"), F.lit(0))

    def codes(found: Column) -> Column:
        marked = F.exists(found, lambda v: v.startswith("+"))
        one = F.size(found) == 1
        return F.array_join(F.transform(found, lambda v: F.when(~marked, "x").when(one, "s").when(v.startswith("+"), "S").otherwise("u")), "")

    return F.array_join(F.transform(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(rf"\+?[{vowels}]"), F.lit(0))), codes), "")


def fits(profile_: Column, foot: int, strong: int) -> Column:
    """Is a profile in a metre: a stress in a longer word, and none of them at a weak place?"""
    weak = "".join("." if i == strong else "[usx]" for i in range(foot))
    rest = "".join(f"(?:{'.' if i == strong else '[usx]'}" for i in range(foot)) + ")?" * foot
    return profile_.contains("S") & profile_.rlike(f"^(?:{weak})*{rest}$")


def intervals(profile_: Column) -> Column:
    """Unstressed syllables between neighbouring stresses, of words of any length."""
    return F.transform(F.regexp_extract_all(profile_, F.lit("(?<=[Ss])([ux]*)(?=[Ss])"), F.lit(1)), F.length)


def feet(profile_: Column, foot: int, strong: int) -> Column:
    """Feet up to the last stress, one at least; null without a stress."""
    last = F.length(F.regexp_extract(profile_, "^(.*)[Ss]", 1))
    return F.when(profile_.rlike("[Ss]"), F.greatest(F.floor((last - strong) / foot) + 1, F.lit(1).cast("long")))


def classify_metre(lines: DataFrame, poem: list[str]) -> DataFrame:
    """poem, lines, metre, feet of poems with three lines or more of two stresses or more (profile column).

    The best of the five classical metres that ``0.85`` of the lines fit (ties: in their order); else dolnik or
    taktovik by the shares of intervals of 1, 2, 3 and more; else free. feet: the commonest number of the fitting
    lines if 0.6 of them have it (ties: the lesser).
    """
    p = F.col("profile")
    told = lines.where(F.length(F.regexp_replace(p, "[ux]", "")) >= 2)
    gaps = F.filter(intervals(p), lambda g: g > 0)
    known = told.select(*poem, gaps.alias("gaps"), *[F.when(fits(p, *fs), feet(p, *fs)).alias(m) for m, fs in METRES.items()])

    def of(test: Callable[[Column], Column]) -> Column:
        return F.sum(F.size(F.filter("gaps", test)))

    def equals(i: int) -> Callable[[Column], Column]:
        return lambda g: g == i  # a second parameter would be the place in the array

    shares = known.groupBy(*poem).agg(
        F.count("*").alias("lines"),
        *[F.avg(F.col(m).isNotNull().cast("int")).alias(m) for m in METRES],
        *[of(equals(i)).alias(f"g{i}") for i in (1, 2, 3)],
        of(lambda g: g >= 5).alias("g5"),
        F.sum(F.size("gaps")).alias("gaps"),
        *[F.collect_list(m).alias(f"feet_{m}") for m in METRES],  # a poem's lines
    ).where("lines >= 3")
    best = F.greatest(*METRES)
    classical = F.coalesce(*[F.when(F.col(m) == best, m) for m in METRES])
    s1, s2, s3, s5 = (F.col(f"g{i}") / F.greatest("gaps", F.lit(1)) for i in (1, 2, 3, 5))
    dolnik = (s1 + s2 >= 0.75) & (F.least(s1, s2) >= 0.15) & (s3 < 0.12) & (s5 <= 0.05)
    taktovik = (s1 + s2 + s3 >= 0.85) & (s3 >= 0.12) & (s5 <= 0.05)
    named = shares.select("*", F.when(best >= 0.85, classical).when(dolnik, "dolnik").when(taktovik, "taktovik").otherwise("free").alias("metre"))
    numbers = F.coalesce(*[F.when(F.col("metre") == m, F.col(f"feet_{m}")) for m in METRES])

    def commonest(all_: Column) -> Column:
        counted = F.transform(F.array_distinct(all_), lambda n: F.struct((-F.size(F.filter(all_, lambda x: x == n))).alias("c"), n.alias("n")))
        return X.bound(F.array_min(counted), lambda m: F.when(-m["c"] >= 0.6 * F.size(all_), m["n"]))

    return named.select(*poem, "lines", "metre", X.bound(numbers, commonest).alias("feet"))


def clausula(line: X.Text, vowels: str = RUSSIAN_VOWELS) -> Column:
    """The end of a stressed line from its last mark on: last (word), key (its sounds, the stressed vowel first),
    support (the consonant before that vowel, '' after a vowel), after (syllables after it), compound (the rhyme runs
    over several words). Null without a mark before a vowel, or if the last word has several syllables and no mark;
    ё counts as marked in a line without marks."""
    low = F.lower(X._c(line))
    marked = F.when(low.contains("+"), low).otherwise(F.replace(low, F.lit("ё"), F.lit("+ё")))
    flat = F.trim(F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}+\s-]", " "), r"\s+", " "))
    cut = F.struct(flat.alias("flat"), F.regexp_extract(flat, r"^(.*)\+", 1).alias("head"), F.regexp_extract(flat, r"^.*\+(.*)$", 1).alias("tail"), F.regexp_extract(flat, r"[\p{L}+]+(?:-[\p{L}+]+)*(?=[^\p{L}+]*$)", 0).alias("word"))

    def ending(c: Column) -> Column:
        told = c["word"].contains("+") | (F.regexp_count(c["word"], F.lit(f"[{vowels}]")) < 2)
        before = F.regexp_extract(F.regexp_replace(c["head"], r"[+ -]", ""), r"(\p{L})[ьъ]*$", 1)
        key = X.phonetic(F.regexp_replace(c["tail"], "[ -]", ""))
        support = F.when(before.rlike(f"[{vowels}]"), "").otherwise(before)
        out = X.bound(key, lambda k: F.struct(F.replace(c["word"], F.lit("+"), F.lit("")).alias("last"), k.alias("key"), support.alias("support"), (F.regexp_count(F.substring(k, F.lit(2), F.length(k)), F.lit(f"[{vowels}]"))).alias("after"), c["tail"].contains(" ").alias("compound")))
        return F.when(c["flat"].contains("+") & c["tail"].rlike(f"^[ -]*[{vowels}]") & told, out)

    return X.bound(cut, ending)


def rhyme_type(a: Column, b: Column, vowels: str = RUSSIAN_VOWELS) -> Column:
    """exact, inexact, assonance or null for two clausulae; a word doesn't rhyme with itself.

    Stressed vowel and syllables after it must be the same. Equal sounds are exact, but an open ending of one sound
    without a common support is assonance; under final stress an open syllable doesn't rhyme with a closed one;
    consonants that agree but for a final й, or differ in one place (under final stress only if both have two), are
    inexact; a common last consonant, or none at all, is assonance.
    """

    def rest(c: Column) -> Column:
        return F.regexp_replace(F.substring(c["key"], F.lit(2), F.length(c["key"])), f"[{vowels}]", "")

    both = F.struct(a.alias("a"), b.alias("b"), rest(a).alias("p"), rest(b).alias("q"))

    def judged(x: Column) -> Column:
        c, d, p, q = x["a"], x["b"], x["p"], x["q"]
        final = c["after"] == 0
        same_place = (F.left(c["key"], F.lit(1)) == F.left(d["key"], F.lit(1))) & (c["after"] == d["after"])
        open_c, open_d = (F.right(e["key"], F.lit(1)).rlike(f"[{vowels}]") for e in (c, d))
        bare = (F.length(c["key"]) == 1) & (c["support"] != d["support"])
        close = (F.levenshtein(p, q) <= 1) & (~final | (F.least(F.length(p), F.length(q)) >= 2))
        alike = F.regexp_replace(p, "й+$", "") == F.regexp_replace(q, "й+$", "")
        return (
            F.when(c.isNull() | d.isNull() | (c["last"] == d["last"]) | ~same_place, None)
            .when(c["key"] == d["key"], F.when(bare, "assonance").otherwise("exact"))
            .when(final & (open_c != open_d), None)
            .when(alike | close, "inexact")
            .when(F.right(p, F.lit(1)) == F.right(q, F.lit(1)), "assonance")
        )

    return X.bound(both, judged)


def rhyme_pairs(ends: DataFrame, poem: list[str], reach: int = 4, vowels: str = RUSSIAN_VOWELS) -> DataFrame:
    """poem, i, j, type, rich, compound, same_class: for each line the first later one within ``reach`` lines, in its
    stanza or the next, that rhymes with it; assonances must be two lines apart at most. ends: line_no (from 0, without
    gaps), stanza_no, c (clausula) and word_class (null if unknown)."""
    if "word_class" not in ends.columns:
        ends = ends.withColumn("word_class", F.lit(None).cast("string"))
    known = ends.where("c is not null")
    a = known.select(*poem, F.col("line_no").alias("i"), F.col("stanza_no").alias("si"), F.col("c").alias("ca"), F.col("word_class").alias("wa"))
    b = known.select(*poem, F.col("line_no").alias("j"), F.col("stanza_no").alias("sj"), F.col("c").alias("cb"), F.col("word_class").alias("wb"))
    steps = a.withColumn("j", F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.col("i") + d)))  # an equality join, not a band
    met = steps.join(b, [*poem, "j"]).where(F.col("sj") - F.col("si") <= 1).withColumn("type", rhyme_type(F.col("ca"), F.col("cb"), vowels))
    ok = met.where("type is not null and (type <> 'assonance' or j - i <= 2)")
    first = ok.withColumn("r", F.row_number().over(Window.partitionBy(*poem, "i").orderBy("j"))).where("r = 1")
    return first.select(*poem, "i", "j", "si", "sj", "type", ((F.col("ca.support") != "") & (F.col("ca.support") == F.col("cb.support"))).alias("rich"), (F.col("ca.compound") | F.col("cb.compound")).alias("compound"), (F.col("wa") == F.col("wb")).alias("same_class"), F.col("ca.last").alias("word_i"), F.col("cb.last").alias("word_j"))


def partners(pairs: DataFrame, poem: list[str]) -> DataFrame:
    """poem, line_no, partner, type of every line with a rhyme: the first line that reached it, else the one it reached."""
    ways = pairs.select(*poem, F.explode(F.array(F.struct(F.col("j").alias("line_no"), F.col("i").alias("partner"), F.col("i").alias("order"), "type"), F.struct(F.col("i").alias("line_no"), F.col("j").alias("partner"), F.col("i").alias("order"), "type"))).alias("x"))
    return ways.groupBy(*poem, "x.line_no").agg(F.min_by(F.struct("x.partner", "x.type"), "x.order").alias("m")).select(*poem, "line_no", "m.partner", "m.type")


def quatrain_schemes(pairs: DataFrame, stanza_lines: DataFrame, poem: list[str]) -> DataFrame:
    """poem, stanza_no, letters, scheme of the stanzas of four lines: a line takes its partner's letter if that stands
    before it in the stanza, the next letter if its partner doesn't, a hyphen without one. scheme: AABB, ABAB, ABBA,
    none (two hyphens or more) or other."""
    joined = stanza_lines.select(*poem, "stanza_no", "line_no").join(partners(pairs, poem), [*poem, "line_no"], "left")
    four = joined.groupBy(*poem, "stanza_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "partner"))).alias("l")).where(F.size("l") == 4)
    first = F.get("l", F.lit(0))["line_no"]

    def lettered(done: Column, x: Column) -> Column:
        known = (x["partner"] >= first) & (x["partner"] < x["line_no"])
        fresh = F.substring(F.lit("ABCD"), F.lit(1) + sum((done.contains(c).cast("int") for c in "ABC"), F.lit(0)), F.lit(1))
        return F.concat(done, F.when(x["partner"].isNull(), "-").when(known, F.substring(done, (x["partner"] - first + 1).cast("int"), F.lit(1))).otherwise(fresh))

    letters = four.select(*poem, "stanza_no", F.aggregate("l", F.lit(""), lettered).alias("letters"))
    scheme = F.when(F.col("letters").isin("AABB", "ABAB", "ABBA"), F.col("letters")).when(F.regexp_count("letters", F.lit("-")) >= 2, "none").otherwise("other")
    return letters.select(*poem, "stanza_no", "letters", scheme.alias("scheme"))


def shares_by(rows: DataFrame, group: list[str], key: Column, weight: Column | None = None) -> DataFrame:
    """group, key, n, share: how the rows (or their weights) of each group fall to the values of ``key``."""
    counts = rows.groupBy(*group, key.alias("key")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))  # a group's few values


def metre_table(metres: DataFrame, poems: DataFrame, poem: list[str], period: str) -> DataFrame:
    """period, key (metre), n, share, by lines; poems: poem and period."""
    return shares_by(metres.join(poems, poem), [period], F.col("metre"), F.col("lines"))


def rhyme_tables(ends: DataFrame, pairs: DataFrame, poems: DataFrame, poem: list[str], period: str) -> DataFrame:
    """table, period, key, n, share. Tables: type (of each line's rhyme, or none), ending (syllables after the stress,
    3 for more), rich (of exact rhymes), compound, class (of pairs whose words' classes are known), scheme (of
    quatrains)."""
    lines, found = ends.join(poems, poem), pairs.join(poems, poem)
    typed = lines.join(partners(pairs, poem), [*poem, "line_no"], "left")
    schemes = quatrain_schemes(pairs, ends, poem).join(poems, poem)
    parts = {
        "type": shares_by(typed, [period], F.coalesce("type", F.lit("none"))),
        "ending": shares_by(lines.where("c is not null"), [period], F.least(F.col("c.after"), F.lit(3)).cast("string")),
        "rich": shares_by(found.where("type = 'exact'"), [period], F.when(F.col("rich"), "rich").otherwise("plain")),
        "compound": shares_by(found, [period], F.when(F.col("compound"), "compound").otherwise("simple")),
        "class": shares_by(found.where("same_class is not null"), [period], F.when(F.col("same_class"), "same").otherwise("other")),
        "scheme": shares_by(schemes, [period], F.col("scheme")),
    }
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("table"), period, "key", "n", "share") for name, t in parts.items()))


def suffix_rhymes(lines: DataFrame, poem: list[str], reach: int = 4, letters: int = 3) -> DataFrame:
    """Lines with ``rhymes``: another line up to ``reach`` lines away ends in the same letters (and another word)."""
    last = F.try_element_at(X.lower_tokens("line", r"\p{L}+"), F.lit(-1))
    ends = lines.withColumn("last", last).where(F.length("last") >= letters).withColumn("suffix", F.right("last", F.lit(letters)))
    w = Window.partitionBy(*poem, "suffix").orderBy("line_no").rangeBetween(-reach, reach)
    words = F.size(F.collect_set("last").over(w))
    return ends.withColumn("rhymes", words > 1)


def rhyme_dictionary(pairs: DataFrame) -> DataFrame:
    """word, n, partners (struct n, word; the commonest first): from word_i, word_j in both directions."""
    both = pairs.select(F.col("word_i").alias("word"), F.col("word_j").alias("other")).unionByName(pairs.select(F.col("word_j").alias("word"), F.col("word_i").alias("other")))
    counts = both.groupBy("word", "other").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("other"))))
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.transform(listed, lambda x: F.struct((-x["m"]).alias("n"), x["other"].alias("word"))).alias("partners"))


def alliteration(line: X.Text, skip: list[str] | None = None, profile_: LanguageProfile = LATIN, least: int = 3) -> Column:
    """The most different words of a line that begin with one consonant; short words and ``skip`` don't count."""
    words = F.array_distinct(X.lower_tokens(line, r"\p{L}+"))
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(skip or [""]) & ~F.left(w, F.lit(1)).rlike(f"[{profile_.vowels}]"))
    firsts = F.transform(kept, lambda w: F.left(w, F.lit(1)))
    one = F.transform(F.array(firsts), lambda f: F.array_max(F.transform(F.array_distinct(f), lambda c: F.size(F.filter(f, lambda x: x == c)))))
    return F.coalesce(one[0], F.lit(0))


def shuffled_baseline(tokens: DataFrame, part: list[str], reps: int = 20, seed: int = 7) -> DataFrame:
    """part, rep, slot, word: the part's words in ``reps`` random orders that depend on the seed alone; slot numbers
    the places, so joining it with the lines' own slots re-cuts the words to the lines' lengths."""
    copies = tokens.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return numbered(copies, [*part, "rep"], F.xxhash64(F.lit(seed), "rep", *tokens.columns)).select(*part, "rep", "slot", "word")


def numbered(rows: DataFrame, part: list[str], order: Column, bits: int = 8) -> DataFrame:
    """``rows`` with ``slot``, their number from 0 within ``part`` by a hash ``order``: the hash's upper bits cut a part
    into 2**bits ranges that are numbered apart, and a range begins where those before it end."""
    ranged = rows.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 64 - bits))
    sizes = ranged.groupBy(*part, "_range").agg(F.count("*").alias("_size"))
    begins = sizes.withColumn("_begin", F.coalesce(F.sum("_size").over(Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 2**bits rows of a part
    inner = F.row_number().over(Window.partitionBy(*part, "_range").orderBy("_order", *[c for c in rows.columns if c not in part]))
    return ranged.withColumn("_here", inner).join(begins, [*part, "_range"]).withColumn("slot", F.col("_begin") + F.col("_here") - 1).drop("_order", "_range", "_size", "_begin", "_here")


def alliteration_against_chance(lines: DataFrame, part: list[str], keys: list[str], skip: list[str] | None = None, profile_: LanguageProfile = LATIN, least: int = 3, hit: int = 3, reps: int = 20, seed: int = 7) -> DataFrame:
    """part, lines, observed, chance, ratio: the share of lines with ``hit`` different words on one consonant, and the
    same share when the part's words (of ``least`` letters, without ``skip``) are dealt anew to lines of their lengths
    ``reps`` times. keys: what tells a line apart."""
    kept = F.filter(X.lower_tokens("line", r"\p{L}+"), lambda w: (F.length(w) >= least) & ~w.isin(skip or [""]))
    words = lines.select(*part, *keys, kept.alias("words"))

    def scored(words_: Column) -> Column:
        firsts = F.transform(F.filter(F.array_distinct(words_), lambda w: ~F.left(w, F.lit(1)).rlike(f"[{profile_.vowels}]")), lambda w: F.left(w, F.lit(1)))
        return X.bound(firsts, lambda f: F.coalesce(F.array_max(F.transform(F.array_distinct(f), lambda c: F.size(F.filter(f, lambda x: x == c)))), F.lit(0)))

    seen = words.groupBy(*part).agg(F.count("*").alias("lines"), F.avg((scored(F.col("words")) >= hit).cast("int")).alias("observed"))
    hits = dealt_hits(words, part, keys, f"[{profile_.vowels}]", hit, reps, seed, scored)
    same = reduce(Column.__and__, [seen[c].eqNullSafe(hits[f"_{c}"]) for c in part])
    return seen.join(hits, same, "left").select(*part, "lines", "observed", (F.coalesce("hits", F.lit(0)) / (F.col("lines") * reps)).alias("chance")).withColumn("ratio", F.try_divide("observed", "chance"))


#: Words of a range of a part's random order, about; parts up to which a table of them is broadcast.
RANGE_WORDS, BROADCAST_PARTS = 1 << 19, 10_000


def dealt_hits(words: DataFrame, part: list[str], keys: list[str], vowel: str, hit: int, reps: int, seed: int, scored: Callable[[Column], Column]) -> DataFrame:
    """The part's columns, each after a low line, and hits: how many lines of ``reps`` random deals of a part's words have ``hit`` different words on one
    consonant.

    A hash cuts a part's words into ranges of about RANGE_WORDS, once; each deal orders every range anew, so each is an
    order in which all orders are alike likely, and the lines' slots follow one another through the ranges. A range is
    sent as its different words and their numbers. Lines that two ranges share are put together from their pieces."""
    shared_folder(words.sparkSession)
    sized = words.select(*part, F.size("words").alias("size")).where("size > 0").groupBy(*part, "size").agg(F.count("*").alias("n"))
    lengths = sized.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("lengths"), F.sum(F.col("size") * F.col("n")).alias("tokens"))
    named = [F.col(c).alias(f"_{c}") for c in part]
    parts = lengths.select(*named, "lengths", F.ceil(F.col("tokens") / RANGE_WORDS).cast("long").alias("ranges"), F.xxhash64(F.lit(seed), *part).alias("seed"), F.monotonically_increasing_id().alias("part")).checkpoint()
    small = F.broadcast if parts.count() <= BROADCAST_PARTS else (lambda table: table)
    same = reduce(Column.__and__, [F.col(f"_line.{c}").eqNullSafe(F.col(f"_{c}")) for c in part])
    lines = words.where(F.size("words") > 0).select(F.struct(*part).alias("_line"), F.xxhash64(F.lit(seed), *keys).alias("h"), "words")
    cut = lines.join(small(parts.select("part", "ranges", *[f"_{c}" for c in part])), same).select("part", "ranges", "h", "words")

    def ranges(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        size = pc.list_value_length(whole["words"]).to_numpy().astype(np.int64)
        pos = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
        z = np.repeat(whole["h"].to_numpy().astype(np.uint64), size) + (pos + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        which = ((z ^ (z >> np.uint64(31))) % np.repeat(whole["ranges"].to_numpy().astype(np.uint64), size)).astype(np.int64)
        encoded = pc.list_flatten(whole["words"]).combine_chunks().dictionary_encode()
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        codes = encoded.indices.to_numpy().astype(np.int64)
        group = np.stack([np.repeat(whole["part"].to_numpy(), size), which])
        order = np.lexsort((codes, group[1], group[0]))
        rows = np.stack([group[0][order], group[1][order], codes[order]])
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
        n = np.diff(first, append=rows.shape[1])
        rows = rows[:, first]
        begins = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
        out = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), rows.shape[1]], strict=True):
            text = "\n".join(encoded.dictionary.take(pa.array(rows[2, a:b])).to_pylist()) + "\t" + " ".join(map(str, n[a:b].tolist()))
            out.append((int(rows[0, a]), int(rows[1, a]), int(n[a:b].sum()), zlib.compress(text.encode())))
        part_, which_, tokens, block = zip(*out, strict=True)
        yield pa.record_batch([pa.array(part_, pa.int64()), pa.array(which_, pa.int64()), pa.array(tokens, pa.int64()), pa.array(block, pa.binary())], ["part", "which", "tokens", "block"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                tokens += len(batch.column("words").flatten())
            if tokens >= RANGE_WORDS:
                yield from ranges(held)
                held, tokens = [], 0
        if held:
            yield from ranges(held)

    blocks = cut.mapInArrow(packed, "part long, which long, tokens long, block binary").checkpoint()
    sizes = blocks.groupBy("part", "which").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("part").orderBy("which").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = sizes.withColumn("begin", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    placed = begins.join(small(parts.select("part", "lengths", "seed")), "part").select(F.col("part").alias("of"), F.col("which").alias("range"), "begin", "lengths", "seed")

    def dealt(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        for block in left["block"].to_pylist():
            names, numbers = zlib.decompress(block).decode().split("\t")
            for w, n in zip(names.split("\n"), map(int, numbers.split(" ")), strict=True):
                counts[w] = counts.get(w, 0) + n
        names = sorted(counts)
        at: dict[str, int] = {}
        silent = re.compile(vowel)
        letter = np.array([-1 if silent.match(w) else at.setdefault(w[0], len(at)) for w in names])
        urn = np.repeat(np.arange(len(names)), [counts[w] for w in names])
        here = right.to_pylist()[0]
        begin, end = here["begin"], here["begin"] + len(urn)
        starts, sizes_, numbers_, slot, number = [], [], [], 0, 0
        for x in here["lengths"]:
            size, n = x["size"], x["n"]
            a, b = max(0, (begin - slot) // size), min(n, -(-(end - slot) // size))
            if a < b and size >= hit:
                k = np.arange(a, b)
                starts.append(slot + k * size - begin)
                sizes_.append(np.full(b - a, size))
                numbers_.append(number + k)
            slot, number = slot + size * n, number + n
        out: dict[str, list] = {"part": [here["of"]], "hits": [0], "rep": [None], "line": [None], "words": [None]}
        if starts:
            start, size, which = np.concatenate(starts), np.concatenate(sizes_), np.concatenate(numbers_)
            inside = (start >= 0) & (start + size <= len(urn))
            full, lens = start[inside], size[inside]
            line = np.repeat(np.arange(len(full)), lens)
            slots = np.arange(lens.sum()) - np.repeat(lens.cumsum() - lens, lens) + np.repeat(full, lens)
            for rep in range(reps):
                order = np.random.default_rng([seed, here["seed"] & 0xFFFFFFFFFFFFFFFF, here["range"], rep]).permutation(urn)
                code = order[slots]
                told = letter[code] >= 0
                seen_ = np.unique(line[told] * len(names) + code[told])  # different words of each line
                on = seen_ // len(names) * (len(at) + 1) + letter[seen_ % len(names)]
                on.sort()
                run = np.flatnonzero(np.diff(on, prepend=-1))
                many = on[run][np.diff(run, append=len(on)) >= hit]
                out["hits"][0] += len(np.unique(many // (len(at) + 1)))
                for s, n, w in zip(start[~inside].tolist(), size[~inside].tolist(), which[~inside].tolist(), strict=True):
                    piece = order[max(0, s) : min(len(urn), s + n)]
                    for name, value in (("part", here["of"]), ("hits", 0), ("rep", rep), ("line", w), ("words", [names[c] for c in piece if letter[c] >= 0])):
                        out[name].append(value)
        return pa.table({"part": pa.array(out["part"], pa.int64()), "hits": pa.array(out["hits"], pa.int64()), "rep": pa.array(out["rep"], pa.int32()), "line": pa.array(out["line"], pa.int64()), "words": pa.array(out["words"], pa.list_(pa.string()))})

    found = blocks.groupBy("part", "which").cogroup(placed.groupBy("of", "range")).applyInArrow(dealt, "part long, hits long, rep int, line long, words array<string>")
    joined = found.groupBy("part", "rep", "line").agg(F.sum("hits").alias("hits"), F.flatten(F.collect_list("words")).alias("words"))
    total = joined.groupBy("part").agg((F.sum("hits") + F.count_if(F.col("line").isNotNull() & (scored(F.col("words")) >= hit))).alias("hits"))
    return total.join(small(parts.select("part", *[f"_{c}" for c in part])), "part").drop("part")


def consonant_ratio(a: DataFrame, b: DataFrame, text_col: str = "line", profile_: LanguageProfile = LATIN) -> DataFrame:
    """letter, share_a, share_b, ratio of two tables' consonants."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        letters = df.select(F.explode(F.split(F.regexp_replace(F.lower(text_col), rf"[^\p{{L}}]|[{profile_.vowels}]", ""), "")).alias("letter")).where("letter <> ''")
        counts = letters.groupBy("letter").agg(F.count("*").alias("n"))
        return counts.select("letter", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))  # one row for each letter

    return shares(a, "share_a").join(shares(b, "share_b"), "letter").withColumn("ratio", F.col("share_a") / F.col("share_b"))


def sentence_spans(stanza_lines: DataFrame, poem: list[str]) -> DataFrame:
    """poem, sentence_no, lines, stanzas: over how many lines and stanzas each sentence runs. A line with several ends
    closes one span; what follows an end in its line begins the next span there."""
    order = Window.partitionBy(*poem).orderBy("line_no")
    line = F.rtrim("line")
    ends = X.sentence_ends(line) > 0
    goes_on = ends & ~line.rlike(r"[.!?…]+[»\"')]*$")
    base = stanza_lines.withColumns({"ends": ends, "goes_on": goes_on})
    closed = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = base.withColumn("sentence_no", F.when(F.col("goes_on"), F.array(closed, closed + 1)).otherwise(F.array(closed)))
    return ids.select(*poem, "line_no", "stanza_no", F.explode("sentence_no").alias("sentence_no")).groupBy(*poem, "sentence_no").agg(F.count("*").alias("lines"), F.countDistinct("stanza_no").alias("stanzas"))


def span_table(spans: DataFrame, group: list[str]) -> DataFrame:
    """group, n, median, mean, p90 (lines of a sentence) and across (share of sentences over several stanzas)."""
    return spans.groupBy(*group).agg(F.count("*").alias("n"), F.percentile("lines", F.lit(0.5)).alias("median"), F.avg("lines").alias("mean"), F.percentile("lines", F.lit(0.9)).alias("p90"), F.avg((F.col("stanzas") > 1).cast("int")).alias("across"))


def span_histogram(spans: DataFrame, most: int = 25) -> DataFrame:
    """lines (``most`` for more), n."""
    return spans.groupBy(F.least("lines", F.lit(most)).alias("lines")).agg(F.count("*").alias("n"))


def longest_spans(spans: DataFrame, poem: list[str], least: int = 20, k: int = 12) -> DataFrame:
    """The ``k`` longest sentences of ``least`` lines or more, one of each poem; ties in the poems' order."""
    one = spans.where(F.col("lines") >= least).groupBy(*poem).agg(F.max(F.struct("lines", "stanzas")).alias("m"))
    return one.select(*poem, "m.lines", "m.stanzas").orderBy(F.desc("lines"), F.desc("stanzas"), *poem).limit(k)


#: Signs of comparison in lower-case Russian text (fixed values).
SIMILES = {"словно": r"\bсловно\b", "будто": r"\bбудто\b", "как будто": r"\bкак будто\b", "подобно": r"\bподобно\b", "точно": r"[,—]\s*точно\b", "как": r",\s*как\b(?!\s+будто)"}


def simile_rates(docs: DataFrame, group: list[str], patterns: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """group, kind, n, per_1000 words; ``patterns`` for lower-case text, SIMILES if none are given."""
    from corpusforge.operators.stats import punctuation_rates

    unicode = {k: f"(?U){p}" for k, p in (patterns or SIMILES).items()}
    return punctuation_rates(docs.withColumn(text_col, F.lower(text_col)), group, text_col, unicode).withColumnRenamed("mark", "kind")


def genitive_rates(tokens: DataFrame, part: list[str], group: list[str], words: DataFrame) -> DataFrame:
    """group, n, per_1000: neighbouring words of which the first is a noun and the second another noun in the genitive
    that is no name, both in lower case; of all words in ``words`` (group, words). tokens: part, pos, word, noun,
    genitive and name (booleans)."""
    order = Window.partitionBy(*part).orderBy("pos")
    after = {c: F.lead(c).over(order) for c in ("word", "noun", "genitive", "name")}
    pairs = tokens.select(*group, "word", "noun", *[after[c].alias(f"next_{c}") for c in after])
    small = F.left("word", F.lit(1)) == F.lower(F.left("word", F.lit(1)))
    next_small = F.left("next_word", F.lit(1)) == F.lower(F.left("next_word", F.lit(1)))
    n = pairs.groupBy(*group).agg(F.count_if(F.col("noun") & F.col("next_noun") & F.col("next_genitive") & ~F.col("next_name") & small & next_small & (F.lower("word") != F.lower("next_word"))).alias("n"))
    return words.join(n, group, "left").select(*group, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 1000.0 / F.greatest("words", F.lit(1))).alias("per_1000"))


def metre_examples(lines: DataFrame, metre: str, cap: int = 40, low: int = 22, high: int = 58) -> DataFrame:
    """Lines of a metre (profile, line) of 22 to 58 characters, ``cap`` at most, in order of their text: all strong
    places up to the last stress are stressed, three at least, and no weak one."""
    foot, strong = METRES[metre]
    p = F.col("profile")
    lead, cycle = "[ux]" * strong, "[Ss]" + "[ux]" * (foot - 1)
    ok = lines.where(F.length(F.replace("line", F.lit("+"), F.lit(""))).between(low, high) & p.contains("S"))
    return ok.where(p.rlike(f"^{lead}(?:{cycle}){{2,}}[Ss][ux]*$")).orderBy("line").limit(cap)


def rhyme_examples(pairs: DataFrame, kind: str, cap: int = 60, least: int = 3) -> DataFrame:
    """Different pairs of words of one rhyme type with three letters or more each, the commonest first."""
    held = pairs.where((F.col("type") == kind) & (F.least(F.length("word_i"), F.length("word_j")) >= least))
    counts = held.groupBy(F.least("word_i", "word_j").alias("a"), F.greatest("word_i", "word_j").alias("b")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "a", "b").limit(cap)
