"""Documents: duplicates, coverage, classification, cleaning, periods, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators.graph import components
from corpusforge.session import shared_folder


def exact_dedup(docs: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """The first by ``order`` of the documents whose texts are the same but for white space."""
    key = F.md5(X.squeezed(F.coalesce(F.col(text_col), F.lit(""))))
    columns = docs.columns
    first = docs.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_d"))
    return first.select(*[F.col(f"_d.{c}").alias(c) for c in columns])


def shingle_sets(docs: DataFrame, id_col: str, text_col: str = "text", k: int = 5) -> DataFrame:
    """id, set (hashes of distinct shingles, rising), n, letters."""
    hashes = F.array_sort(X.shingle_hashes(text_col, k))
    return docs.select(F.col(id_col).alias("id"), hashes.alias("set"), X.letters(text_col).alias("letters")).withColumn("n", F.size("set"))


def similar_pairs(docs: DataFrame, similarity: float = 0.9, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """a, b, similarity of the pairs of different shingle sets that are at least so similar, exactly.

    Documents with equal sets are one node, named by the least id: (node, id) pairs are ``equal_sets``. Pairs meet
    in the rarest shingles of each set, as many as a similar set must share one of; sizes must agree, too.
    """
    shared_folder(docs.sparkSession)
    sets = shingle_sets(docs, id_col, text_col, k).groupBy("set").agg(F.min("id").alias("id"), F.min("n").alias("n")).checkpoint()
    terms = sets.select("id", "n", F.explode("set").alias("h"))
    rarity = terms.groupBy("h").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("id").orderBy("df", "h")
    prefix = terms.join(rarity, "h").withColumn("r", F.row_number().over(by_rarity)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).where("df > 1")
    prefix = prefix.select("h", "id", "n").checkpoint()
    one, two = prefix.select("h", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("h", F.col("id").alias("b"), F.col("n").alias("nb"))
    candidates = one.join(two, "h").where(F.col("a") < F.col("b")).where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity).select("a", "b").distinct()
    sa, sb = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = candidates.join(sa, "a").join(sb, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).alias("similarity")).where(F.col("similarity") >= similarity)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.9, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` less near copies, resolved greedily: pairs in the order of their ids; of a pair whose two documents
    still stand the one with fewer letters goes, the later one if they have as many. Each connected component of
    similar documents is resolved by itself; documents with equal sets are settled first, the same way."""
    base = docs.withColumn("_n", X.letters(text_col)).withColumn("_s", F.xxhash64(F.array_sort(X.shingle_hashes(text_col, k))))
    best = Window.partitionBy("_s").orderBy(F.desc("_n"), id_col)
    single = base.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_s")
    pairs = similar_pairs(single.select(id_col, text_col), similarity, id_col, text_col, k).select("a", "b")
    label = components(pairs)
    letters = single.select(F.col(id_col).alias("id"), "_n")
    known = pairs.join(label.withColumnRenamed("node", "a"), "a").join(letters.toDF("a", "na"), "a").join(letters.toDF("b", "nb"), "b")

    def greedy(pdf):  # noqa: ANN001, ANN202 - one component's pairs
        gone: set = set()
        for a, b, na, nb in pdf.sort_values(["a", "b"])[["a", "b", "na", "nb"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone.add(a if nb > na else b)
        return pdf.__class__({"gone": list(gone)})

    kind = docs.schema[id_col].dataType.simpleString()
    gone = known.groupBy("label").applyInPandas(greedy, f"gone {kind}")
    return single.join(gone, F.col(id_col) == F.col("gone"), "left_anti").drop("_n")


def coverage(docs: DataFrame, site: DataFrame, id_col: str, text_col: str = "text", k: int = 5) -> DataFrame:
    """id and the share of a document's shingles that any document of ``site`` has."""
    known = site.select(F.explode(X.shingle_hashes(text_col, k)).alias("h")).distinct().withColumn("known", F.lit(1))
    own = docs.select(F.col(id_col), F.explode(X.shingle_hashes(text_col, k)).alias("h"))
    return own.join(known, "h", "left").groupBy(id_col).agg(F.avg(F.coalesce("known", F.lit(0))).alias("coverage"))


def merge_uncovered(site: DataFrame, added: DataFrame, id_col: str, text_col: str = "text", covered: float = 0.5, always: DataFrame | None = None) -> DataFrame:
    """``site`` and those of ``added`` that it doesn't cover; ids in ``always`` (column id) come in whatever their coverage."""
    cov = coverage(added, site, id_col, text_col)
    kept = added.join(cov, id_col, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    if always is not None:
        forced = always.select(F.col("id").alias(id_col), F.lit(True).alias("_always")).distinct()
        kept = kept.join(forced, id_col, "left").where((F.col("coverage") < covered) | F.col("_always")).drop("_always")
    else:
        kept = kept.where(F.col("coverage") < covered)
    return site.unionByName(kept, allowMissingColumns=True)


def first_mapping(rows: DataFrame, mapping: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the mapping's columns; of several entries for a key the first by ``order``."""
    rest = [c for c in mapping.columns if c not in (key, order)]
    once = mapping.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])
    return rows.join(once, key, "left")


def footnotes(docs: DataFrame, notes: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """id and the notes a text (after its label, if a column is named) refers to as [n], each once, in the order of
    their first mention; notes has id, ref, note."""
    whole = F.concat_ws("\n", label_col, text_col) if label_col else F.col(text_col)
    refs = docs.select(F.col(id_col), F.posexplode(F.array_distinct(F.regexp_extract_all(whole, F.lit(r"\[(\d+)\]"), F.lit(1)))).alias("at", "ref"))
    found = refs.join(notes, [id_col, "ref"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "ref", "note")))
    return found.groupBy(id_col).agg(F.transform(ordered, lambda x: F.struct(x["ref"].alias("ref"), x["note"].alias("note"))).alias("notes"))


def excluded(rows: DataFrame, rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that no rule names, rows that one names with its reason)."""
    return rows.join(rules, keys, "left_anti"), rows.join(rules, keys)


def prefix_lookup(rows: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """``rows`` with the first (by ord) of the prefixes (prefix, ord, ...) that the column begins with.

    Prefixes meet values by the prefixes' lengths, so this is an equality join for each length that occurs.
    """
    sizes = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # lengths of a small table
    id_ = F.monotonically_increasing_id()
    numbered = rows.withColumn("_row", id_)
    starts = numbered.select("_row", F.explode(F.array_distinct(F.array(*[F.left(F.col(column), F.lit(n)) for n in sizes]))).alias("prefix"))
    rest = [c for c in prefixes.columns if c not in ("prefix", "ord")]
    hit = starts.join(prefixes, "prefix").groupBy("_row").agg(F.min_by(F.struct("prefix", *rest), "ord").alias("_m"))
    return numbered.join(hit, "_row", "left").select(*rows.columns, F.col("_m.prefix").alias("prefix"), *[F.col(f"_m.{c}").alias(c) for c in rest])


def in_period(rows: DataFrame, periods: DataFrame, year: Column, fallback: Column | None = None, none: int = 6) -> DataFrame:
    """period_id by year BETWEEN low AND high (first by id), else ``fallback``, else ``none``.

    Ranges become their years, so it is an equality join; the years of a periods table are few.
    """
    years = periods.select(F.explode(F.sequence("low", "high")).alias("_y"), "id").groupBy("_y").agg(F.min("id").alias("_p"))
    joined = rows.join(F.broadcast(years) if _few(years) else years, year == F.col("_y"), "left")
    return joined.withColumn("period_id", F.coalesce(*[c for c in (F.col("_p"), fallback, F.lit(none)) if c is not None])).drop("_y", "_p")


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """Is a table small enough to broadcast? Counts no further than that."""
    return df.limit(most + 1).count() <= most


# Classification --------------------------------------------------------------------


def language(text: X.Text) -> Column:
    """'en' if a text has more Latin than Cyrillic letters, else 'ru'."""
    t = X._c(text)
    return F.when(F.regexp_count(t, F.lit("[A-Za-z]")) > F.regexp_count(t, F.lit(r"\p{IsCyrillic}")), "en").otherwise("ru")


def genre(text: X.Text, short: int = 75, share: float = 0.85, least: int = 4) -> Column:
    """'poetry' if a text has ``least`` lines or more, of which ``share`` are at most ``short`` characters long."""
    full = X.full_lines(text)
    few = F.filter(full, lambda x: F.length(F.trim(x)) <= short)
    return F.when((F.size(full) >= least) & (F.size(few) / F.size(full) >= share), "poetry").otherwise("prose")


def role(section: Column, title: Column, url: Column, rules: list[tuple[str, str, str]], default: str = "own") -> Column:
    """The first rule that matches says the role: (column, pattern, role), column one of section, title, url."""
    columns = {"section": section, "title": title, "url": url}
    out = F.lit(default)
    for name, pattern, value in reversed(rules):
        out = F.when(columns[name].rlike(pattern), value).otherwise(out)
    return out


def year_of(text: X.Text, low: int = 1955, high: int = 1996, last: int = 4, words: int = 8) -> Column:
    """The last year in range that the last short lines name; decades don't count; null if there is none."""
    short = F.filter(X.full_lines(text), lambda x: F.size(F.split(F.trim(x), r"\s+")) <= words)
    tail = F.slice(short, F.greatest(F.size(short) - last + 1, F.lit(1)), F.lit(last))
    found = F.filter(F.flatten(F.transform(tail, X.years)), lambda y: y.between(low, high))
    return F.try_element_at(found, F.lit(-1))


def without_notes(text: X.Text, heading: str = "\n\nNotes:") -> Column:
    return F.split_part(X._c(text), F.lit(heading), F.lit(1))


def clean_lines(text: X.Text, poetry: Column | bool = False, editorial: str = r"(?i)^\s*(\[?editor|\(c\)|©|\* from )", longest: int = 28) -> Column:
    """A text without editorial lines and date lines, and in poetry without lines of more than ``longest`` words."""
    p = F.lit(poetry) if isinstance(poetry, bool) else poetry
    kept = F.transform(F.array(F.struct(X.lines(text).alias("l"), p.alias("p"))), lambda s: F.filter(s["l"], lambda x: ~x.rlike(editorial) & ~X.date_line(x) & ~(s["p"] & (F.size(X.tokens(x)) > longest))))
    return F.array_join(kept[0], "\n")


def skip_reason(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first that holds, null for rows to keep."""
    out = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        out = F.when(test, name).otherwise(out)
    return rows.withColumn("reason", out)


def pilot(rows: DataFrame, section: str, order: list[str]) -> DataFrame:
    """The first row of each section."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where("_r = 1").drop("_r")


def substantial(text: X.Text, label: X.Text, least: int = 20) -> Column:
    """Enough letters, and a label that isn't only digits."""
    return (X.letters(text) >= least) & ~X._c(label).rlike(r"^[0-9]+$")


def is_service_title(title: X.Text, prefixes: list[str], exact: str = "COMMENTARY") -> Column:
    out = F.upper(X._c(title)) == exact
    for p in prefixes:
        out = out | X._c(title).startswith(p)
    return out


def repaired_title(title: X.Text, text: X.Text) -> Column:
    """Asterisks as a title become the quoted first line, without marks at its end and with an ellipsis."""
    first = F.regexp_replace(X.squeezed(F.try_element_at(X.full_lines(text), F.lit(1))), "[,.;:—-]+$", "")
    return F.when(X._c(title).rlike(r"^[*\s]+$") & first.isNotNull(), F.concat(F.lit('"'), first, F.lit('..."'))).otherwise(X._c(title))


def group_of(parents: Column, collection: str) -> Column:
    """The last ancestor that neither begins with the collection's title nor is a year of the 19th or 20th century."""
    return F.try_element_at(F.filter(parents, lambda p: ~p.startswith(collection) & ~p.rlike("^1[89][0-9]{2}$")), F.lit(-1))


# Themes and excerpts ---------------------------------------------------------------


def theme_scores(docs: DataFrame, lemmas: list[str], phrases: list[str], keys: list[str], text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """keys, markers (words of the theme and phrase matches), n_words, per_1000, title_hit; texts without a marker go."""
    words = X.lower_tokens(text_col)
    known = F.array(*[F.lit(x) for x in lemmas]).cast("array<string>")
    hits = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    for p in phrases:
        hits = hits + F.regexp_count(F.lower(text_col), F.lit(p))
    title = X.lower_tokens(title_col) if title_col else F.array().cast("array<string>")
    out = docs.select(*keys, hits.alias("markers"), F.size(words).alias("n_words"), F.arrays_overlap(title, known).alias("title_hit"))
    return out.withColumn("per_1000", X.per(F.col("markers"), F.col("n_words"), 1000)).where("markers > 0 or title_hit")


def undecided(candidates: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Candidates without a verdict."""
    return candidates.join(verdicts, key, "left_anti")


def require_none(rows: DataFrame, what: str) -> None:
    """Fails, naming a few, if there are rows."""
    if found := rows.limit(5).collect():
        raise ValueError(f"{what}: {found}")


def excerpts(parts: DataFrame, doc_keys: list[str], hit: Column, around: int = 1) -> DataFrame:
    """Parts (paragraphs or sentences, in order of part_no) within ``around`` of a hit; gap: parts are missing before it."""
    order = Window.partitionBy(*doc_keys).orderBy("part_no")
    near = F.max(hit.cast("int")).over(order.rowsBetween(-around, around))
    kept = parts.withColumn("_near", near).where("_near = 1").drop("_near")
    before = F.lag("part_no").over(order)
    return kept.withColumn("gap", F.coalesce(F.col("part_no") - before > 1, F.col("part_no") > 0))


def paragraphs(docs: DataFrame, keys: list[str], text_col: str = "text", separator: str = r"\n{2,}") -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(text_col, separator, -1)).alias("part_no", "part"))


def between_headings(lines: DataFrame, doc_keys: list[str], heading: Column, name: Column) -> DataFrame:
    """The lines after the heading that ``name`` picks, up to the next heading."""
    order = Window.partitionBy(*doc_keys).orderBy("line_no")
    section = F.sum(heading.cast("int")).over(order)
    chosen = F.max(F.when(heading & name, 1).otherwise(0)).over(Window.partitionBy(*doc_keys, "_s"))
    return lines.withColumn("_s", section).withColumn("_c", chosen).where((F.col("_c") == 1) & ~heading).drop("_s", "_c")


def dated(rows: DataFrame, year: Column, manual: Column, midpoint: Column) -> DataFrame:
    """year_used (the year, a manual one, the period's midpoint) and approximate; rows without any go."""
    return rows.withColumn("year_used", F.coalesce(year, manual, midpoint)).withColumn("approximate", F.coalesce(year, manual).isNull()).where("year_used is not null")


def verdict(value: Column, yes: float, part: float) -> Column:
    """'yes', 'part' or 'no' by two thresholds."""
    return F.when(value >= yes, "yes").when(value >= part, "part").otherwise("no")


def ratio_verdict(ratio: Column, more: float = 1.15, less: float = 0.9) -> Column:
    return F.when(ratio >= more, "more").when(ratio <= less, "less").otherwise("even")


def between_commas(text: X.Text, word: str) -> Column:
    """How often a word stands alone between commas, where it is a particle and no noun."""
    return F.regexp_count(F.lower(X._c(text)), F.lit(rf",\s*{word}\s*(?=,)"))


def trimmed(paragraph: X.Text, hit: str, around: int = 2, limit: int = 1500) -> Column:
    """A paragraph longer than ``limit`` cut to the sentences within ``around`` of the first that holds ``hit``."""
    p = X._c(paragraph)
    cut = F.transform(F.array(X.sentences(p)), lambda s: F.transform(F.array(F.array_position(F.transform(s, lambda x: F.contains(x, F.lit(hit))), F.lit(True))), lambda at: F.array_join(F.slice(s, F.greatest(at - around, F.lit(1)).cast("int"), (F.least(at + around, F.size(s)) - F.greatest(at - around, F.lit(1)) + 1).cast("int")), " ")))
    return F.when((F.length(p) > limit) & F.contains(p, F.lit(hit)), cut[0][0]).otherwise(p)


def corpora(annotated: DataFrame) -> dict[str, DataFrame]:
    """The views that statistics run on: own texts in the main language, their poetry, their prose less titles that
    begin like a poem's (duplicates of it), and own poetry in the other language. Columns: lang, genre, author, title."""
    own = annotated.where("author = 'own'")
    main = own.where("lang = 'ru'")
    poetry, prose = main.where("genre = 'poetry'"), main.where("genre = 'prose'")
    heads = poetry.select(F.left("title", F.lit(20)).alias("_h")).where("length(_h) > 0").distinct()
    prose = prose.withColumn("_t", F.left("title", F.lit(20))).join(heads, F.col("_t") == F.col("_h"), "left_anti").drop("_t")
    return {"own": main, "poetry": poetry, "prose": prose, "other": own.where("lang <> 'ru' and genre = 'poetry'")}


def first_and_last_examples(lines: DataFrame, words: list[str], doc_order: list[str], low: int = 20, high: int = 80) -> DataFrame:
    """word, first, last: the first and the last line (by ``doc_order``, line_no) with each word, ``low`` to ``high`` long."""
    asked = F.array(*[F.lit(w) for w in words])
    held = lines.where(F.length("line").between(low, high)).select(*doc_order, "line_no", "line", F.explode(F.array_intersect(X.lower_tokens("line"), asked)).alias("word"))
    place = F.struct(*doc_order, "line_no")
    return held.groupBy("word").agg(F.min_by("line", place).alias("first"), F.max_by("line", place).alias("last"))
