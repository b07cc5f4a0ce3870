"""Counts, rates and distributions over tokens, lines and sentences.

Functions take tables of ``operators.tokens`` and the names of the grouping columns (language, source, period ...).
Nothing is rounded here. Windows are partitioned by a group or run over tables of group size, never over tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.session import shared_folder


def top_terms(tokens: DataFrame, group: list[str], k: int = 20, word: str = "word") -> DataFrame:
    """group, word, n, per_10k (of all the group's tokens), rank: the k most frequent words, ties by word."""
    counts = tokens.groupBy(*group, word).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), word))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= k)  # each task keeps k rows of a group before the shuffle
    return best.join(totals, group).select(*group, word, "n", (F.col("n") * 10000.0 / F.col("_total")).alias("per_10k"), "rank")


def overview(docs: DataFrame, tokens: DataFrame, group: list[str], id_col: str = "doc_id") -> DataFrame:
    """group, texts, tokens, types."""
    a = docs.groupBy(*group).agg(F.count("*").alias("texts"))
    b = tokens.groupBy(*group).agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("types"))
    return a.join(b, group, "left")


def zero_filled(counts: DataFrame, key: str, low: int, high: int, value: str = "n") -> DataFrame:
    """A row for each whole number from low to high, 0 where there is none."""
    calendar = counts.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    return calendar.join(counts.select(F.col(key).cast("int").alias(key), value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def keyword_by_key(docs: DataFrame, key: str, pattern: str, title_col: str, text_col: str = "text", head: int = 400) -> DataFrame:
    """key, n, titles (sorted, distinct) of the documents whose title or first characters match."""
    hit = F.concat_ws(" ", F.col(title_col), F.substring(text_col, 1, head)).rlike(pattern)
    return docs.where(hit).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(title_col)).alias("titles"))


def line_stats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines, words, syllables: median and mean of a line's syllables."""
    syl = X.syllables("line")
    return lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum(F.size(X.tokens("line"))).alias("words"), F.median(syl).alias("median_syllables"), F.avg(syl).alias("mean_syllables"))


def quartiles(values: DataFrame, group: list[str], value: str, least: int = 40) -> DataFrame:
    """Exact quartiles, mean and n of groups with ``least`` rows or more."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = values.groupBy(*group).agg(q.alias("q"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("n")).where(F.col("n") >= least)
    return out.select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "most", "n")


def clipped_histogram(values: DataFrame, group: list[str], value: str, top: int) -> DataFrame:
    """group, bin (0 to top, higher values in top), n; bins without rows have 0."""
    counts = values.groupBy(*group, F.least(F.col(value), F.lit(top)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = values.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return grid.join(counts, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percentile_from_histogram(hist: DataFrame, group: list[str], share: float) -> DataFrame:
    """The least bin at which the cumulated share is reached."""
    w = Window.partitionBy(*group)
    cum = F.sum("n").over(w.orderBy("bin"))
    return hist.withColumn("reached", cum >= share * F.sum("n").over(w)).where("reached").groupBy(*group).agg(F.min("bin").alias("bin"))


def log_odds(tokens: DataFrame, group: str, least: int = 5, k: int | None = None, prior: float = 0.01) -> DataFrame:
    """group, word, n, rest, z: log-odds of each group against the rest with an informative Dirichlet prior
    (``prior`` times the word's whole frequency), in units of its standard deviation."""
    shared_folder(tokens.sparkSession)
    counts = tokens.groupBy(group, "word").agg(F.count("*").alias("n")).checkpoint()  # read three times
    by_word = counts.groupBy("word").agg(F.sum("n").alias("all_n"))
    by_group = counts.groupBy(group).agg(F.sum("n").alias("group_n")).checkpoint()
    total = by_group.agg(F.sum("group_n").alias("total"))
    c = counts.where(F.col("n") >= least).join(by_word, "word").join(by_group, group).crossJoin(F.broadcast(total))  # one row
    a, big_a = prior * F.col("all_n"), prior * F.col("total")
    rest, rest_n = F.col("all_n") - F.col("n"), F.col("total") - F.col("group_n")
    delta = F.log((F.col("n") + a) / (F.col("group_n") + big_a - F.col("n") - a)) - F.log((rest + a) / (rest_n + big_a - rest - a))
    out = c.select(group, "word", "n", rest.alias("rest"), (delta / F.sqrt(1 / (F.col("n") + a) + 1 / (rest + a))).alias("z"))
    if k is None:
        return out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("z"), "word"))).where(F.col("rank") <= k)


def theme_log_odds(tokens: DataFrame, in_theme: Column, least: int = 3) -> DataFrame:
    """word, n, rest, z of a theme's tokens against all others."""
    marked = tokens.withColumn("side", F.when(in_theme, "theme").otherwise("rest"))
    return log_odds(marked, "side", least).where("side = 'theme'").drop("side")


def mattr(tokens: DataFrame, part: list[str], window: int = 500) -> DataFrame:
    """part, n, mattr: mean type-token ratio of all windows of ``window`` tokens; null if there are fewer.

    A token is new in the windows that start after its word's last place and hold it; counting those starts for
    each token makes it linear, without distinct counts in windows. pos must run from 0 in each part.
    """
    last = F.coalesce(F.lag("pos").over(Window.partitionBy(*part, "word").orderBy("pos")), F.lit(-1))
    sizes = tokens.groupBy(*part).agg(F.count("*").alias("n"))
    t = tokens.withColumn("last", last).join(sizes, part)
    low = F.greatest(F.col("last") + 1, F.col("pos") - window + 1, F.lit(0))
    high = F.least(F.col("pos"), F.col("n") - window)
    new = F.greatest(high - low + 1, F.lit(0))
    out = t.groupBy(*part, "n").agg(F.sum(new).alias("new"))
    return out.select(*part, "n", F.when(F.col("n") >= window, F.col("new") / (F.col("n") - window + 1) / window).alias("mattr"))


def hapax(tokens: DataFrame, group: list[str]) -> DataFrame:
    """group, types, hapax (types that occur once), tokens."""
    counts = tokens.groupBy(*group, "word").agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"), F.sum("n").alias("tokens"))


def zipf(tokens: DataFrame, group: list[str], points: int = 12, top: int = 1000) -> DataFrame:
    """group, rank, word, n at log-spaced ranks from 1 to ``top``."""
    counts = tokens.groupBy(*group, "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)
    return ranked.where(F.array_contains(X.log_spaced(1, top, points), F.col("rank").cast("long")))


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before them in their group; ``order`` must tell rows apart.

    Rows are dealt to ranges of the order; sums run inside a range, and a range begins at the sum of those before it,
    so no task holds a whole group. A checkpoint fixes the ranges.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    parts = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = sums.withColumn("_begin", F.coalesce(F.sum("_sum").over(parts), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return held.join(begins, [*group, "_range"]).select(*rows.columns, (F.col("_begin") + F.col("_inside")).alias(name))


def heaps(docs: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text", step: int = 1500) -> DataFrame:
    """group, tokens_to, types: types among the first tokens of a group (documents by id), each ``step`` tokens and at the end.

    A word's first place (document, then position) is a map-side minimum; documents' offsets are running totals.
    """
    shared_folder(docs.sparkSession)
    cut = docs.select(group, F.col(id_col).alias("id"), X.lower_tokens(text_col).alias("w"))
    firsts = cut.select(group, "id", F.posexplode("w").alias("pos", "word")).groupBy(group, "word").agg(F.min(F.struct("id", "pos")).alias("first"))
    offsets = running_total(cut.select(group, "id", F.size("w").alias("n")), [group], ["id"], "n", "offset").checkpoint()
    placed = firsts.select(group, F.col("first.id").alias("id"), F.col("first.pos").alias("pos")).join(offsets, [group, "id"])
    ends = offsets.groupBy(group).agg(F.sum("n").alias("total"))
    bins = placed.groupBy(group, F.floor((F.col("offset") + F.col("pos")) / step).alias("bin")).agg(F.count("*").alias("new"))
    grid = ends.where("total > 0").select(group, "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / step))).alias("bin"))
    filled = grid.join(bins, [group, "bin"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    types = running_total(filled, [group], ["bin"], "new", "before")
    return types.select(group, F.least((F.col("bin") + 1) * step, F.col("total")).alias("tokens_to"), (F.col("before") + F.col("new")).alias("types"))


def field_rates(tokens: DataFrame, lexicon: DataFrame, group: list[str], unit: float = 1000.0) -> DataFrame:
    """group, field, n, rate: lexicon words (field, word) for each ``unit`` tokens of the group; fields without hits have 0."""
    totals = tokens.groupBy(*group).agg(F.count("*").alias("total"))
    hits = tokens.groupBy(*group, "word").agg(F.count("*").alias("c")).join(lexicon.select("field", "word").distinct(), "word").groupBy(*group, "field").agg(F.sum("c").alias("n"))
    grid = totals.join(lexicon.select("field").distinct(), how="cross")  # groups x fields
    return grid.join(hits, [*group, "field"], "left").select(*group, "field", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * unit / F.col("total")).alias("rate"))


def field_words(tokens: DataFrame, lexicon: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """field, word, and a count for each group (drill-down, pivoted)."""
    return tokens.join(lexicon.select("field", "word").distinct(), "word").groupBy("field", "word").pivot(group, groups).agg(F.count(F.lit(1))).na.fill(0)


#: Punctuation marks and their patterns after normalisation (fixed values).
PUNCTUATION = {"comma": ",", "period": r"(?<!\.)\.(?!\.)", "ellipsis": r"\.\.\.", "exclamation": "!", "question": r"\?", "colon": ":", "semicolon": ";", "dash": "—", "parenthesis": r"\(", "quote": r"[«\"“]"}


def punctuation_rates(docs: DataFrame, group: list[str], text_col: str = "text", marks: dict[str, str] | None = None) -> DataFrame:
    """group, mark, n, per_1000 words."""
    norm = X.normalised_punctuation(text_col)
    marks = marks or PUNCTUATION
    sums = docs.groupBy(*group).agg(F.sum(F.size(X.tokens(text_col))).alias("words"), *[F.sum(F.regexp_count(norm, F.lit(p))).alias(m) for m, p in marks.items()])
    long = sums.select(*group, "words", F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(m).alias("n")) for m in marks])).alias("x"))
    return long.select(*group, F.col("x.mark").alias("mark"), F.col("x.n").alias("n"), X.per(F.col("x.n"), F.col("words"), 1000).alias("per_1000"))


def open_line_share(lines: DataFrame, group: list[str]) -> DataFrame:
    """group, lines, open_share: percent of lines whose last character is a letter."""
    return lines.where(F.trim("line") != "").groupBy(*group).agg(F.count("*").alias("lines"), (100 * F.avg(F.rtrim("line").rlike(r"\p{L}$").cast("int"))).alias("open_share"))


def sentence_stats(sentences: DataFrame, group: list[str]) -> DataFrame:
    """group, n, median, mean, p90, most, and the counts of sentences of 1-5, 6-10, 11-20, 21-40 and more words."""
    n = F.col("n_words")
    bins = {"w1_5": n <= 5, "w6_10": n.between(6, 10), "w11_20": n.between(11, 20), "w21_40": n.between(21, 40), "w41": n > 40}
    return sentences.groupBy(*group).agg(F.count("*").alias("n"), F.median("n_words").alias("median"), F.avg("n_words").alias("mean"), F.percentile("n_words", F.lit(0.9)).alias("p90"), F.max("n_words").alias("most"), *[F.count_if(c).alias(k) for k, c in bins.items()])


def longest(rows: DataFrame, group: list[str], value: Column, keep: list[str], least: bool = False) -> DataFrame:
    """The row with the highest (or lowest) value of each group; ties: the first by ``keep``."""
    sign = value if least else -value
    return rows.groupBy(*group).agg(F.min(F.struct(sign.alias("_v"), *keep)).alias("_m")).select(*group, (F.col("_m._v") if least else -F.col("_m._v")).alias("value"), *[F.col(f"_m.{c}").alias(c) for c in keep])


def word_lengths(tokens: DataFrame, group: list[str], top: int = 15) -> DataFrame:
    """group, length (hyphens left out, longer ones in ``top``), n, share in percent."""
    length = F.least(F.length(F.replace("word", F.lit("-"), F.lit(""))), F.lit(top))
    counts = tokens.groupBy(*group, length.alias("length")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*group)))


def tf_idf(tokens: DataFrame, id_col: str, n_docs: int, k: int = 6, keep: list[str] | None = None) -> DataFrame:
    """id, word, tf, df, score = tf ln(N / df), rank: a document's k telling words,
    ties (to six decimals) by word."""
    shared_folder(tokens.sparkSession)
    tf = tokens.groupBy(id_col, "word").agg(F.count("*").alias("tf")).checkpoint()  # read twice
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    scored = tf.join(df, "word").withColumn("score", F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df")))
    by_score = Window.partitionBy(id_col).orderBy(F.round("score", 6).desc(), "word")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def inverted_index(tokens: DataFrame, group: str, groups: list[str], id_col: str, least: int = 2, least_docs: int = 1) -> DataFrame:
    """word, n, docs, a count for each group, postings (ids, rising) of words with ``least`` tokens or more.

    Words are counted before their postings are collected, and those that don't count have none. A posting list is as
    long as a word has documents.
    """
    shared_folder(tokens.sparkSession)
    per_doc = tokens.groupBy("word", id_col, group).agg(F.count("*").alias("c")).checkpoint()
    by = [F.sum(F.when(F.col(group) == g, F.col("c")).otherwise(0)).alias(f"n_{g}") for g in groups]
    counted = per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"), *by).where((F.col("n") >= least) & (F.col("docs") >= least_docs))
    lists = per_doc.join(counted.select("word"), "word", "left_semi").groupBy("word").agg(F.array_sort(F.collect_list(id_col)).alias("postings"))
    return counted.join(lists, "word")


def doc_cards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", function_words: list[str] | None = None) -> DataFrame:
    """One row of measures for each document: lines, words, median and mean syllables, open ends %, lines that end
    in a function word %, stanzas and the most frequent stanza size (ties: the smaller)."""
    from corpusforge.operators.tokens import line_table, with_stanzas

    lines = with_stanzas(line_table(docs, [id_col], text_col), [id_col])
    syl = X.syllables("line")
    last = F.try_element_at(X.lower_tokens("line"), F.lit(-1))
    base = lines.groupBy(id_col).agg(
        F.count("*").alias("lines"),
        F.sum(F.size(X.tokens("line"))).alias("words"),
        F.median(syl).alias("median_syllables"),
        F.avg(syl).alias("mean_syllables"),
        (100 * F.avg(F.rtrim("line").rlike(r"\p{L}$").cast("int"))).alias("open_share"),
        (100 * F.avg(F.coalesce(last.isin(function_words or ["the"]), F.lit(False)).cast("int"))).alias("function_end_share"),
        F.countDistinct("stanza_no").alias("stanzas"),
    )
    sizes = lines.groupBy(id_col, "stanza_no").agg(F.count("*").alias("size")).groupBy(id_col, "size").agg(F.count("*").alias("c"))
    modal = sizes.groupBy(id_col).agg(F.min(F.struct((-F.col("c")).alias("c"), "size")).alias("m")).select(id_col, F.col("m.size").alias("modal_stanza"))
    return base.join(modal, id_col)


def card_details(cards: DataFrame, id_col: str, tags: DataFrame | None = None, rhymes: DataFrame | None = None, words: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Cards with what needs other tables: nouns_per_verb (tags: id, tag; null without verbs), rhymed_share and
    exact_share of lines (rhymes: id, type, null for a line without one), and fields, a count for each field of the
    lexicon that a document has (words: id, word; lexicon: word, field)."""
    out = cards
    if tags is not None:
        nv = tags.groupBy(id_col).agg(F.count_if(F.col("tag") == "NOUN").alias("_n"), F.count_if(F.col("tag").isin("VERB", "INFN")).alias("_v"))
        out = out.join(nv.select(id_col, X.per(F.col("_n"), F.col("_v"), 1).alias("nouns_per_verb")), id_col, "left")
    if rhymes is not None:
        shares = rhymes.groupBy(id_col).agg((100 * F.avg(F.col("type").isNotNull().cast("int"))).alias("rhymed_share"), (100 * F.avg((F.coalesce("type", F.lit("")) == "exact").cast("int"))).alias("exact_share"))
        out = out.join(shares, id_col, "left")
    if words is not None and lexicon is not None:
        counts = words.join(lexicon.select("word", "field").distinct(), "word").groupBy(id_col, "field").agg(F.count("*").alias("n"))
        out = out.join(counts.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias("fields")), id_col, "left")
    return out


def content_totals(annotated: DataFrame, group: list[str], tags: tuple[str, ...] = ("NOUN", "VERB", "INFN", "ADJF", "ADJS", "ADVB")) -> DataFrame:
    """group, content: tokens with a content word's tag, the denominator of rates by group."""
    return annotated.groupBy(*group).agg(F.count_if(F.col("tag").isin(*tags)).alias("content"))


def stanza_buckets(stanza_lines: DataFrame, doc_keys: list[str], group: list[str]) -> DataFrame:
    """group, bucket ('1', '2-3', '4', '5-8', '9+'), n, share in percent."""
    size = stanza_lines.groupBy(*dict.fromkeys([*group, *doc_keys]), "stanza_no").agg(F.count("*").alias("size"))
    s = F.col("size")
    bucket = F.when(s == 1, "1").when(s <= 3, "2-3").when(s == 4, "4").when(s <= 8, "5-8").otherwise("9+")
    counts = size.groupBy(*group, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*group)))


def line_final_words(lines: DataFrame, group: list[str], words: list[str], k: int = 10) -> DataFrame:
    """group, word, n, share of all lines with words, rank: the most frequent of ``words`` at lines' ends."""
    last = lines.select(*group, F.try_element_at(X.lower_tokens("line"), F.lit(-1)).alias("word")).where("word is not null")
    totals = last.groupBy(*group).agg(F.count("*").alias("total"))
    counts = last.where(F.col("word").isin(words)).groupBy(*group, "word").agg(F.count("*").alias("n")).join(totals, group)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "word"))
    return counts.select(*group, "word", "n", (F.col("n") / F.col("total")).alias("share"), rank.alias("rank")).where(F.col("rank") <= k)


def multiset_difference(a: DataFrame, b: DataFrame, key: str, value: str = "n") -> DataFrame:
    """a - b of two counters; what isn't positive goes."""
    joined = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full_outer")
    return joined.select(key, (F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias(value)).where(F.col(value) > 0)


def modal(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, the most frequent value (ties: the first), n."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("m")).select(*group, F.col(f"m.{value}").alias(value), (-F.col("m.n")).alias("n"))


def first_types(tokens: DataFrame, part: list[str], order: list[str], first: int = 10_000) -> DataFrame:
    """part, types among the first tokens by ``order``: (document, place in it)."""
    *keys, pos = order
    sizes = tokens.groupBy(*part, *keys).agg(F.count("*").alias("_n"))
    offsets = running_total(sizes, part, keys, "_n", "_offset").where(F.col("_offset") < first)
    within = tokens.join(offsets, [*part, *keys])
    here = F.row_number().over(Window.partitionBy(*part, *keys).orderBy(pos))  # inside a document
    return within.withColumn("_r", F.col("_offset") + here).where(F.col("_r") <= first).groupBy(*part).agg(F.countDistinct("word").alias("types"))


def words_around(tokens: DataFrame, centres: list[str], part: list[str], reach: int = 6, known: DataFrame | None = None, k: int = 70) -> DataFrame:
    """word, n: the commonest words up to ``reach`` places before or behind one of ``centres`` that no lexicon knows."""
    near = F.max(F.col("word").isin(centres).cast("int")).over(Window.partitionBy(*part).orderBy("pos").rowsBetween(-reach, reach))
    found = tokens.withColumn("_near", near).where((F.col("_near") == 1) & ~F.col("word").isin(centres))
    if known is not None:
        found = found.join(known.select("word").distinct(), "word", "left_anti")
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def words_near(tokens: DataFrame, triggers: list[str], part: list[str], after: int = 4, known: DataFrame | None = None, k: int = 70) -> DataFrame:
    """word, n: the commonest words up to ``after`` places behind a trigger that no lexicon (column word) knows."""
    at = Window.partitionBy(*part).orderBy("pos").rowsBetween(-after, -1)
    near = F.max(F.col("word").isin(triggers).cast("int")).over(at)
    found = tokens.withColumn("_near", near).where((F.col("_near") == 1) & ~F.col("word").isin(triggers))
    if known is not None:
        found = found.join(known.select("word").distinct(), "word", "left_anti")
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def undercount_audit(docs: DataFrame, counted: DataFrame, stems: DataFrame, text_col: str = "text") -> DataFrame:
    """word, raw (words with the stem in the texts), got (as counted) where raw exceeds got; stems has word, stem."""
    from corpusforge.operators.tokens import token_table

    raw = token_table(docs, [], text_col).groupBy("word").agg(F.count("*").alias("c")).withColumnRenamed("word", "form")
    sizes = [r[0] for r in stems.select(F.length("stem")).distinct().collect()]  # of a small lexicon
    starts = raw.select("c", F.explode(F.array_distinct(F.array(*[F.left("form", F.lit(n)) for n in sizes]))).alias("stem"))
    sums = starts.join(stems, "stem").groupBy("word").agg(F.sum("c").alias("raw"))
    return sums.join(counted.select("word", F.col("n").alias("got")), "word", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("raw > got")


def smoothed_shares(counts: DataFrame, key: str, part: str, value: str = "n", weights: tuple[int, ...] = (1, 2, 3, 2, 1)) -> DataFrame:
    """key, part, share: a centred weighted mean over neighbouring keys (what lies beyond the edge is left out), as
    shares of each key's sum (a sum of 0 divides by 1)."""
    reach = len(weights) // 2
    table = counts.sparkSession.createDataFrame([(i - reach, w) for i, w in enumerate(weights)], "d int, weight int")
    spread = counts.crossJoin(F.broadcast(table)).select((F.col(key) + F.col("d")).alias(key), part, (F.col(value) * F.col("weight")).alias("v"), F.col("weight"))
    low, high = counts.agg(F.min(key), F.max(key)).first()
    inside = spread.where(F.col(key).between(low, high))
    smooth = inside.groupBy(key, part).agg((F.sum("v") / F.sum("weight")).alias("v"))
    total = F.sum("v").over(Window.partitionBy(key))
    return smooth.select(key, part, (F.col("v") / F.when(total == 0, 1).otherwise(total)).alias("share"))


def growth(counts: DataFrame, group: str, least: int = 6, ratio: float = 1.5, k: int = 7) -> DataFrame:
    """group, word, n, growth: words whose share in a group is ``ratio`` times their whole share or more; the k highest."""
    in_group, of_word = Window.partitionBy(group), Window.partitionBy("word")
    total = counts.agg(F.sum("n").alias("total"))
    rates = counts.withColumns({"g": F.col("n") / F.sum("n").over(in_group), "w": F.sum("n").over(of_word)}).crossJoin(F.broadcast(total))  # one row
    grown = rates.withColumn("growth", F.col("g") / (F.col("w") / F.col("total"))).where((F.col("n") >= least) & (F.col("growth") >= ratio))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("growth"), "word"))
    return grown.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "word", "n", "growth", "rank")


def ranked(measures: DataFrame, value: str, digits: int = 2) -> DataFrame:
    """Competition ranks on rounded values, highest first; for tables of measures."""
    return measures.withColumn("rounded", F.round(value, digits)).withColumn("rank", F.rank().over(Window.orderBy(F.desc("rounded"))))


def evenly_spaced(rows: DataFrame, part: list[str], order: list, best: int = 12, pick: int = 3) -> DataFrame:
    """``pick`` rows evenly spaced among the ``best`` first of each part."""
    w = Window.partitionBy(*part).orderBy(*order)
    top = rows.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < best)
    n = F.count("*").over(Window.partitionBy(*part))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(pick - 1)), lambda i: F.floor(i * (n - 1) / (pick - 1))))
    return top.withColumn("_take", F.array_contains(at, F.col("_r").cast("long"))).where("_take").drop("_r", "_take")


def interpolated(points: DataFrame, part: list[str], key: str, value: str, at: Column) -> DataFrame:
    """value at a key between two points, eased (3t² - 2t³); the last point before holds beyond the end."""
    w = Window.partitionBy(*part).orderBy(key)
    nxt = points.withColumns({"k2": F.lead(key).over(w), "v2": F.lead(value).over(w)})
    inside = nxt.where((F.col(key) <= at) & ((at < F.col("k2")) | F.col("k2").isNull()))
    t = F.coalesce((at - F.col(key)) / (F.col("k2") - F.col(key)), F.lit(0.0))
    return inside.select(*part, (F.col(value) + (F.coalesce("v2", value) - F.col(value)) * (3 * t * t - 2 * t * t * t)).alias("at_value"))


def examples(rows: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def unique_pairs(rows: DataFrame, a: str, b: str, lists: str, priority: str, k: int, seed: int = 7) -> DataFrame:
    """A sample of ``k`` different unordered pairs for each list, in an order that depends on the seed alone; a pair
    that several lists hold goes to the one of least priority."""
    pair = F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    once = rows.groupBy(pair.alias("_pair")).agg(F.min(F.struct(priority, lists, a, b)).alias("_m"))
    flat = once.select(*[F.col(f"_m.{c}").alias(c) for c in (priority, lists, a, b)])
    return examples(flat, [lists], [F.xxhash64(F.lit(seed), a, b), a, b], k)


def theme_comparison(rows: DataFrame, theme: Column, key: str, value: str) -> DataFrame:
    """One row: median and mean of a value in the theme, and of the other rows with a key (year) that the theme has."""
    marked = rows.withColumn("_t", theme)
    keys = marked.where("_t").select(key).distinct()
    near = marked.join(keys, key, "left_semi")
    return near.agg(F.median(F.when(F.col("_t"), F.col(value))).alias("theme_median"), F.avg(F.when(F.col("_t"), F.col(value))).alias("theme_mean"), F.median(F.when(~F.col("_t"), F.col(value))).alias("rest_median"), F.avg(F.when(~F.col("_t"), F.col(value))).alias("rest_mean"))


def essay_stats(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, sentences, median and p90 of their words, dashes and parentheses per 1000 words."""
    from corpusforge.operators.tokens import sentence_table

    s = sentence_table(docs, keys, text_col).groupBy(*keys).agg(F.count("*").alias("sentences"), F.median("n_words").alias("median"), F.percentile("n_words", F.lit(0.9)).alias("p90"))
    norm = X.normalised_punctuation(text_col)
    words = F.size(X.tokens(text_col))
    marks = docs.select(*keys, X.per(F.regexp_count(norm, F.lit("—")), words, 1000).alias("dashes"), X.per(F.regexp_count(norm, F.lit(r"\(")), words, 1000).alias("parentheses"))
    return s.join(marks, keys)


def tag_shares(annotated: DataFrame, group: list[str], tag: str = "tag") -> DataFrame:
    """group, tag, n, share in percent of the tagged tokens, and the group's nouns for each verb."""
    counts = annotated.where(F.col(tag).isNotNull()).groupBy(*group, tag).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    nouns, verbs = (F.sum(F.when(F.col(tag) == t, F.col("n")).otherwise(0)).over(w) for t in ("NOUN", "VERB"))
    return counts.select(*group, tag, "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("share"), F.try_divide(nouns, verbs).alias("nouns_per_verb"))


def tagged_counts(annotated: DataFrame, grammeme: str, group: list[str], ambiguous: list[str] | None = None, k: int = 20) -> DataFrame:
    """group, lemma, n, rank: the commonest capitalised words with a grammeme (a place, a surname); ``ambiguous`` lemmas are left out."""
    held = annotated.where(F.array_contains("grammemes", grammeme) & F.col("word").rlike(r"^\p{Lu}") & ~F.col("lemma").isin(ambiguous or [""]))
    counts = held.groupBy(*group, "lemma").agg(F.count("*").alias("n"))
    return examples(counts, group, [F.desc("n"), "lemma"], k)


def author_measures(docs: DataFrame, group: str, first: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group, texts, words, mean syllables of a line, open line ends %, mean sentence length, commas and dashes per 1000
    words, types among the first words. Groups are authors, whose works are few."""
    from corpusforge.operators.tokens import line_table, sentence_table, token_table

    lines = line_table(docs, [group], text_col).where(F.trim("line") != "")
    by_line = lines.groupBy(group).agg(F.avg(X.syllables("line")).alias("syllables"), (100 * F.avg(F.rtrim("line").rlike(r"\p{L}$").cast("int"))).alias("open_share"))
    words = F.size(X.tokens(text_col))
    norm = X.normalised_punctuation(text_col, True)
    whole = docs.groupBy(group).agg(F.count("*").alias("texts"), F.sum(words).alias("words"), X.per(F.sum(F.regexp_count(norm, F.lit(","))), F.sum(words), 1000).alias("commas"), X.per(F.sum(F.regexp_count(norm, F.lit("—"))), F.sum(words), 1000).alias("dashes"))
    sentence = sentence_table(docs, [group], text_col).groupBy(group).agg(F.avg("n_words").alias("sentence_words"))
    types = first_types(token_table(docs, [group, id_col], text_col), [group], [id_col, "pos"], first)
    return whole.join(by_line, group, "left").join(sentence, group, "left").join(types, group, "left")


def cluster_features(cards: DataFrame, least_lines: int = 12) -> DataFrame:
    """Cards fit for clustering: ``least_lines`` lines or more, a period and a sentence length; nouns per verb null as
    2.5 and at most 8, sentences at most 15 lines, metre as two marks (classical, free)."""
    kept = cards.where((F.col("lines") >= least_lines) & F.col("period").isNotNull() & F.col("sentence_lines").isNotNull())
    return kept.withColumns({
        "nouns_per_verb": F.least(F.coalesce("nouns_per_verb", F.lit(2.5)), F.lit(8.0)),
        "sentence_lines": F.least("sentence_lines", F.lit(15.0)),
        "classical": F.col("metre").isin("iamb", "trochee", "dactyl", "amphibrach", "anapaest").cast("double"),
        "free": (F.col("metre") == "free").cast("double"),
    })
