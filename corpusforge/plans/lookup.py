"""What a reader asks of the tables: parameterised look-ups, rankings, cards and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import graph as G


def suggestions(rows: DataFrame, column: str, prefix: str, k: int = 10) -> DataFrame:
    """The k commonest values that begin so, ties in order: column, n."""
    return rows.where(F.col(column).startswith(prefix)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def rhyme_partners(dictionary: DataFrame, word: str) -> DataFrame:
    """word, total, partner count and the partners of a word, the commonest first."""
    return dictionary.where(F.col("word") == word.lower()).select("word", F.col("n").alias("total"), F.size("partners").alias("n_partners"), "partners")


def metre_families(metres: DataFrame, families: dict[str, str], period: str) -> DataFrame:
    """period, family, lines, share of the period's lines, in percent."""
    name = F.coalesce(*[F.when(F.col("metre") == m, f) for m, f in families.items()], F.lit("other"))
    sums = metres.groupBy(period, name.alias("family")).agg(F.sum("lines").alias("lines"))
    return sums.withColumn("share", 100.0 * F.col("lines") / F.sum("lines").over(Window.partitionBy(period)))


def share_table(rows: DataFrame, group: str, category: str) -> DataFrame:
    """group, category, n, share in percent."""
    counts = rows.groupBy(group, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def against_baseline(observed: DataFrame, base: DataFrame, key: str, weight: str = "n", value: str = "share") -> DataFrame:
    """One row: the weighted means of both and their ratio."""
    j = observed.select(key, F.col(value).alias("o"), F.col(weight).alias("w")).join(base.select(key, F.col(value).alias("b")), key)
    return j.agg((F.sum(F.col("o") * F.col("w")) / F.sum("w")).alias("observed"), (F.sum(F.col("b") * F.col("w")) / F.sum("w")).alias("baseline")).withColumn("ratio", F.col("observed") / F.col("baseline"))


def rate_series(tokens: DataFrame, word: str, period: str, unit: float = 10_000.0) -> DataFrame:
    """period, n, rate of a word; periods without it have 0."""
    return tokens.groupBy(period).agg(F.count_if(F.col("word") == word).alias("n"), (F.count_if(F.col("word") == word) * unit / F.count("*")).alias("rate"))


def entity_card(stats: DataFrame, edges: DataFrame, contexts: DataFrame, name: str, k: int = 6) -> DataFrame:
    """One row: an entity's measures, its k heaviest neighbours and its examples."""
    near = G.neighbours(edges, k).where(F.col("src") == name).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("dst").alias("name"), "w"))).alias("neighbours"))
    quoted = contexts.where(F.col("word") == name).agg(F.array_sort(F.collect_list(F.struct("doc", "line"))).alias("examples"))
    return stats.where(F.col("word") == name).crossJoin(near).crossJoin(quoted)  # one row each


def entity_filter(stats: DataFrame, prefix: str | None = None, period: str | None = None, least: int = 1) -> DataFrame:
    """Entities by the beginning of their name and by presence in a period (its count column), in order of name."""
    found = stats.where(F.col("n") >= least)
    if prefix:
        found = found.where(F.col("word").startswith(prefix))
    if period:
        found = found.where(F.col(f"n_{period}") > 0)
    return found.orderBy("word")


def ranking(stats: DataFrame, keys: list[str], k: int, name: str = "word") -> DataFrame:
    """The k first by several columns, each from high to low, then by name."""
    return stats.orderBy(*[F.desc(c) for c in keys], name).limit(k)


def rare(stats: DataFrame, most: int = 2, name: str = "word") -> DataFrame:
    return stats.where(F.col("n") <= most).orderBy(name)


def shelf_groups(shelves: DataFrame, first: int = 8) -> DataFrame:
    """category, shelf, n, shown: the ``first`` largest shelves of a category are shown at once."""
    groups = shelves.where("category is not null and shelf is not null and word is null")
    return groups.withColumn("shown", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "shelf")) <= first)


def colour_counts(marks: DataFrame, mode: str, period: str) -> DataFrame:
    """period, hue, n, share of a mode: 'named' marks are also 'objects', and all are 'all'."""
    member = {"named": ["n"], "objects": ["n", "o"], "all": ["n", "o", "m"]}[mode]
    return share_table(marks.where(F.col("src").isin(member)), period, "hue")


def comparison(measures: DataFrame, value: str, name: str, own: str) -> DataFrame:
    """One row: own value, its competition rank (highest first), and the others' median, least and most."""
    mine = measures.where(F.col(name) == own).agg(F.max(value).alias("own"))
    rest = measures.where(F.col(name) != own).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    above = measures.crossJoin(mine).where(F.col(value) > F.col("own")).agg((F.count("*") + 1).alias("rank"))
    return mine.crossJoin(above).crossJoin(rest)  # one row each


def poem_lookup(docs: DataFrame, title: str, year: int | None = None) -> DataFrame:
    found = docs.where(F.lower("title") == title.lower())
    return found if year is None else found.where(F.col("year") == year)


def highlighted_examples(lines: DataFrame, word: str, k: int = 3) -> DataFrame:
    """The first k lines with a word of this stem, marked: doc_id, line_no, line."""
    marked = lines.withColumn("line", X.highlighted("line", word))
    return marked.where(F.col("line").contains("<b>")).orderBy("doc_id", "line_no").limit(k)


def word_map(vectors: DataFrame, lexicon: DataFrame, group: str, k: int = 6) -> DataFrame:
    """query, neighbour, cosine, rank among the lexicon's words (field, word): the words of one field with their
    nearest neighbours. vectors: word, vector."""
    from corpusforge.operators.style import cosine_neighbours

    inside = vectors.join(lexicon.select("word").distinct(), "word", "left_semi")
    asked = inside.join(lexicon.where(F.col("field") == group).select("word").distinct(), "word", "left_semi")
    return cosine_neighbours(inside, asked, "word", "vector", k)


def simile_series(rates: DataFrame, kind: str, period: str) -> DataFrame:
    """period, rate of one kind of simile, in order of period."""
    return rates.where(F.col("kind") == kind).select(period, F.col("per_1000").alias("rate")).orderBy(period)


def consonant_excess(ratios: DataFrame, k: int = 10) -> DataFrame:
    """The k consonants that one corpus has most in excess, in percent."""
    return ratios.select("letter", ((F.col("ratio") - 1) * 100).alias("excess")).orderBy(F.desc("excess"), "letter").limit(k)


def distance_map(distances: DataFrame, cuts: list, key_low: str = "a", key_high: str = "b") -> DataFrame:
    """Distances with ``crosses``: whether a change point lies between the two."""
    crosses = F.lit(False)
    for c in cuts:
        crosses = crosses | ((F.col(key_low) < F.lit(c)) & (F.col(key_high) >= F.lit(c)))
    return distances.withColumn("crosses", crosses)


def palette(counts: DataFrame, low: int, high: int, period: str = "y", k: int = 5) -> DataFrame:
    """The k commonest hues of a range of years: hue, n, share."""
    inside = counts.where(F.col(period).between(low, high)).groupBy("hue").agg(F.sum("n").alias("n"))
    total = inside.agg(F.sum("n").alias("t"))
    return inside.crossJoin(F.broadcast(total)).select("hue", "n", (100.0 * F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "hue").limit(k)  # one row
