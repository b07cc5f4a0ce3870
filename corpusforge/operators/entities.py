"""Names and things in texts: proper nouns, their kinds, aliases, co-mention, lexicon shelves.

Morphology is a table (form, lemma, pos, grammemes, ...) that callers supply; nothing here guesses tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(tokens: DataFrame, dictionary: DataFrame, form: str = "form") -> DataFrame:
    """Tokens (word) with the dictionary's columns by lower-case form; unknown forms are their own lemma.

    Of several entries for a form the first by ``ord`` counts, and ``grammemes`` unites those of the first four.
    """
    ranked = dictionary.withColumn("_r", F.row_number().over(Window.partitionBy(form).orderBy("ord"))).where("_r <= 4")
    first = ranked.groupBy(form).agg(F.min_by("lemma", "_r").alias("lemma"), F.min_by("pos", "_r").alias("tag"), F.array_distinct(F.flatten(F.collect_list("grammemes"))).alias("grammemes"))
    return tokens.join(first, F.lower("word") == F.col(form), "left").drop(form).withColumn("lemma", F.coalesce("lemma", F.lower("word")))


def content_lemmas(annotated: DataFrame, stop: DataFrame, proper: DataFrame, tags: list[str], names: list[str]) -> DataFrame:
    """Tokens with one of ``tags``, a lemma of two letters or more that is no stop word or proper noun, and none of the
    grammemes ``names``."""
    kept = annotated.where(F.col("tag").isin(tags) & (F.length("lemma") > 1) & ~F.coalesce(F.arrays_overlap("grammemes", F.array(*[F.lit(n) for n in names])), F.lit(False)))
    return kept.join(stop, "lemma", "left_anti").join(proper, "lemma", "left_anti")


def proper_nouns(tokens: DataFrame, share: float = 0.6, least: int = 1, mid_sentence: bool = False, always: list[str] | None = None) -> DataFrame:
    """word (lower case), n, capitalised: words written with a capital in ``share`` of their places or more (word as
    written); mid_sentence counts only places that don't begin a sentence (column starts_sentence). ``always`` come
    in whatever their share, once they have ``least`` places."""
    rows = tokens.where("not starts_sentence") if mid_sentence else tokens
    counts = rows.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.avg(F.col("word").rlike(r"^\p{Lu}").cast("int")).alias("capitalised"))
    return counts.where((F.col("n") >= least) & ((F.col("capitalised") >= share) | F.col("word").isin(always or [""])))


def votes(tokens: DataFrame, part: list[str], person_left: list[str], place_left: list[str]) -> DataFrame:
    """vote of each capitalised token: 'person' beside another capitalised word or after a word of ``person_left``,
    'prep' after one of ``place_left``, else null."""
    order = Window.partitionBy(*part).orderBy("pos")
    previous, following = F.lag("word").over(order), F.lead("word").over(order)
    capital = r"^\p{Lu}\p{Ll}"
    vote = F.when(F.lower(previous).isin(place_left), "prep").when(F.coalesce(previous.rlike(capital), F.lit(False)) | F.coalesce(following.rlike(capital), F.lit(False)) | F.lower(previous).isin(person_left), "person")
    return tokens.withColumn("vote", vote).where(F.col("word").rlike(capital))


def kinds(voted: DataFrame, lexicon_place: DataFrame, person: float = 0.3, place: float = 0.25, least: int = 2) -> DataFrame:
    """word, n, person, prep, kind: place if a gazetteer (column word) has it or prepositions lead to it often, person
    if names stand beside it often, else other; rare ones are null."""
    counts = voted.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("vote") == "person").cast("int"), F.lit(0))).alias("person"), F.avg(F.coalesce((F.col("vote") == "prep").cast("int"), F.lit(0))).alias("prep"))
    known = lexicon_place.select("word").distinct().withColumn("listed", F.lit(True))
    j = counts.join(known, "word", "left")
    kind = F.when(F.col("n") < least, None).when(F.col("listed"), "place").when((F.col("prep") >= place) & (F.col("prep") > F.col("person")), "place").when(F.col("person") >= person, "person").otherwise("other")
    return j.select("word", "n", "person", "prep", kind.alias("kind"))


def kinds_by_tags(voted: DataFrame, proper: DataFrame, excluded: list[str] | None = None, fixed: dict[str, str] | None = None) -> DataFrame:
    """lemma, n, person, prep (votes), kind of names with grammatical tags: columns lemma, vote, grammemes (array) for
    each occurrence, and lemma, capitalised (share of places with a capital) for each lemma.

    ``excluded`` lemmas have no kind and ``fixed`` ones that kind. A place name is a place unless neighbours make it a
    person twice, in 5 % of its places and more often than prepositions make it a place. What may be both is a person
    by 30 % of the neighbours, else a place by 25 % of the prepositions, else a person. A personal name is a person.
    Other words are persons by two neighbours and 15 %, places by half of three places or more after prepositions, if
    90 % are capitalised.
    """
    place, personal = F.array_contains("grammemes", "Geox"), F.arrays_overlap("grammemes", F.array(*map(F.lit, ("Name", "Surn", "Patr"))))
    of = voted.groupBy("lemma").agg(F.count("*").alias("n"), F.count_if(F.col("vote") == "person").alias("person"), F.count_if(F.col("vote") == "prep").alias("prep"), F.coalesce(F.bool_or(place), F.lit(False)).alias("place"), F.coalesce(F.bool_or(personal), F.lit(False)).alias("personal"))
    j = of.join(proper.select("lemma", "capitalised"), "lemma", "left")
    n, person, prep = F.col("n"), F.col("person"), F.col("prep")
    kind = (
        F.when(F.col("place") & ~F.col("personal"), F.when((person >= 2) & (person >= 0.05 * n) & (person > prep), "person").otherwise("place"))
        .when(F.col("place"), F.when(person >= 0.3 * n, "person").when(prep >= 0.25 * n, "place").otherwise("person"))
        .when(F.col("personal"), "person")
        .when((person >= 2) & (person >= 0.15 * n), "person")
        .when((prep >= 0.5 * n) & (n >= 3) & (F.col("capitalised") >= 0.9), "place")
    )
    for lemma, value in (fixed or {}).items():
        kind = F.when(F.col("lemma") == lemma, value).otherwise(kind)
    return j.select("lemma", "n", "person", "prep", F.when(~F.col("lemma").isin(excluded or [""]), kind).alias("kind"))


def drop_parts(occ: DataFrame, part: list[str], least: int = 2) -> DataFrame:
    """Name tokens less the parts of a longer name: a first name (and no surname) right before a person's word that is
    no patronymic, and a patronymic right after a person's first name. Persons left in fewer than ``least`` places lose
    their kind. occ: part, pos, lemma, kind, grammemes (array) of capitalised words."""
    order = Window.partitionBy(*part).orderBy("pos")
    sides = occ.withColumns({f"_{side}": move(F.struct("pos", "kind", "grammemes")).over(order) for side, move in (("next", F.lead), ("last", F.lag))})

    def tagged(column: str, tag: str) -> Column:
        return F.coalesce(F.array_contains(column, tag), F.lit(False))

    def beside(side: str, step: int) -> Column:
        return F.coalesce((F.col(f"_{side}.pos") == F.col("pos") + step) & (F.col(f"_{side}.kind") == "person"), F.lit(False))

    first = tagged("grammemes", "Name") & ~tagged("grammemes", "Surn") & beside("next", 1) & ~tagged("_next.grammemes", "Patr")
    patronymic = tagged("grammemes", "Patr") & beside("last", -1) & tagged("_last.grammemes", "Name")
    kept = sides.where(~((F.coalesce("kind", F.lit("")) == "person") & (first | patronymic))).drop("_next", "_last")
    n = F.count("*").over(Window.partitionBy("lemma"))
    return kept.withColumn("kind", F.when((F.col("kind") != "person") | (n >= least), F.col("kind")))


def with_alias(rows: DataFrame, aliases: DataFrame, column: str = "word") -> DataFrame:
    """``column`` replaced by its alias (columns alias, name) where it has one."""
    once = aliases.groupBy("alias").agg(F.min("name").alias("_name"))
    return rows.join(once, F.col(column) == F.col("alias"), "left").withColumn(column, F.coalesce("_name", column)).drop("alias", "_name")


def display_forms(tokens: DataFrame, lemma: str = "lemma", share: float = 0.25) -> DataFrame:
    """lemma, display: the lemma's own form if it occurs; else of the forms that are at least ``share`` as frequent as
    the commonest the most frequent nominative (column nominative, if there is one), else the shortest (ties: the more
    frequent, then in order)."""
    nominative = F.bool_or("nominative") if "nominative" in tokens.columns else F.lit(False)
    forms = tokens.groupBy(lemma, "word").agg(F.count("*").alias("n"), nominative.alias("nom"))
    own = F.lower("word") == F.col(lemma)
    near = forms.withColumn("_top", F.max("n").over(Window.partitionBy(lemma))).where(own | (F.col("n") >= share * F.col("_top")))
    pick = F.struct((~own).alias("other"), (~F.coalesce("nom", F.lit(False))).alias("oblique"), F.when(F.col("nom") & ~own, 0).otherwise(F.length("word")).alias("len"), (-F.col("n")).alias("m"), "word")
    return near.groupBy(lemma).agg(F.min(pick).alias("p")).select(lemma, F.col("p.word").alias("display"))


def pair_surfaces(pairs: DataFrame, keys: list[str], surface: str = "surface") -> DataFrame:
    """keys, surface, n: the commonest way in which each pair is written (ties: the first in order)."""
    from corpusforge.operators.stats import modal

    return modal(pairs, keys, surface)


def entity_stats(occ: DataFrame, group: str, groups: list, doc: str, year: str | None = None) -> DataFrame:
    """word, n, texts, first and last year, and a count for each group."""
    extra = [F.min(year).alias("first_year"), F.max(year).alias("last_year")] if year else []
    by = [F.count_if(F.col(group) == g).alias(f"n_{g}") for g in groups]
    return occ.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct(doc).alias("texts"), *extra, *by)


def co_mention(occ: DataFrame, scope: list[str], least: int = 1) -> DataFrame:
    """src, dst, w: in how many scopes (blocks, texts) two words stand together; each pair once.

    A scope's words are gathered once and paired in their list. They are few (names of a block or text); a scope's
    pairs grow with the square of that number, so use blocks where texts are long.
    """
    gathered = occ.groupBy(*scope).agg(F.array_sort(F.collect_set("word")).alias("words")).where(F.size("words") > 1)
    later = gathered.select("words", F.posexplode("words").alias("at", "src"))
    pairs = later.select("src", F.explode(F.slice("words", F.col("at") + 2, F.greatest(F.size("words") - F.col("at") - 1, F.lit(0)))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def network_core(stats: DataFrame, least: int = 3, top: int = 120) -> DataFrame:
    """The ``top`` words by texts, then n, of those in ``least`` texts or more."""
    return stats.where(F.col("texts") >= least).orderBy(F.desc("texts"), F.desc("n"), "word").limit(top)


def contexts(occ: DataFrame, k: int = 3, best: int = 12, short: int = 90) -> DataFrame:
    """Example lines of each word, one from each text: short lines first, then earlier texts; k evenly spaced among the
    best. occ: word, doc, line_no, line."""
    from corpusforge.operators.stats import evenly_spaced

    per_text = Window.partitionBy("word", "doc").orderBy(F.length("line") > short, "line_no")
    one = occ.withColumn("_r", F.row_number().over(per_text)).where("_r = 1").drop("_r")
    return evenly_spaced(one, ["word"], [F.length("line") > short, "doc"], best, k)


def shelves(tokens: DataFrame, lexicon: DataFrame, group: str | None = None) -> DataFrame:
    """category, shelf, word, n and the sums over shelves and categories (rollup: null where summed); of a word in two
    shelves the first (ord) counts. lexicon: category, shelf, word, ord."""
    once = lexicon.groupBy("word").agg(F.min_by(F.struct("category", "shelf"), "ord").alias("l")).select("word", F.col("l.category").alias("category"), F.col("l.shelf").alias("shelf"))
    counts = tokens.groupBy(*([group] if group else []), "word").agg(F.count("*").alias("c")).join(once, "word")
    return counts.rollup(*([group] if group else []), "category", "shelf", "word").agg(F.sum("c").alias("n"))


def epithets(annotated: DataFrame, part: list[str], adjective: str = "ADJF", noun: str = "NOUN", idioms: list[tuple[str, str]] | None = None) -> DataFrame:
    """adjective, noun, n: neighbouring pairs that agree in case, number and gender (gender counts in the singular), less
    the pairs of lemmas that are ``idioms``."""
    order = Window.partitionBy(*part).orderBy("pos")
    nxt = {c: F.lead(c).over(order) for c in ("lemma", "tag", "case", "number", "gender")}
    pairs = annotated.withColumns({f"n_{c}": v for c, v in nxt.items()}).where((F.col("tag") == adjective) & (F.col("n_tag") == noun))
    agree = (F.col("case") == F.col("n_case")) & (F.col("number") == F.col("n_number")) & ((F.col("number") == "plur") | F.col("gender").eqNullSafe(F.col("n_gender")))
    idiom = F.struct("lemma", "n_lemma").isin([F.struct(F.lit(a), F.lit(b)) for a, b in idioms]) if idioms else F.lit(False)
    return pairs.where(agree & ~idiom).groupBy(F.col("lemma").alias("adjective"), F.col("n_lemma").alias("noun")).agg(F.count("*").alias("n"))


def genitive_pairs(annotated: DataFrame, line: list[str]) -> DataFrame:
    """line, noun, genitive: a noun and the genitive after it in its line, both lower case, each pair of a line once."""
    order = Window.partitionBy(*line).orderBy("pos")
    nxt = annotated.withColumns({f"n_{c}": F.lead(c).over(order) for c in ("word", "tag", "case")})
    lower = (F.lower("word") == F.col("word")) & (F.lower("n_word") == F.col("n_word"))
    return nxt.where((F.col("tag") == "NOUN") & (F.col("n_tag") == "NOUN") & (F.col("n_case") == "gent") & lower).select(*line, F.col("word").alias("noun"), F.col("n_word").alias("genitive")).distinct()


def line_boundaries(annotated: DataFrame, doc: list[str], tags: tuple[str, ...] = ("ADJF",), preposition: str = "PREP") -> DataFrame:
    """Lines whose last word belongs to the next line's first: an adjective that agrees with a noun, or a preposition."""
    first_last = annotated.groupBy(*doc, "line_no").agg(F.min_by(F.struct("word", "tag", "case", "number"), "pos").alias("f"), F.max_by(F.struct("word", "tag", "case", "number"), "pos").alias("l"))
    nxt = F.lead("f").over(Window.partitionBy(*doc).orderBy("line_no"))
    j = first_last.withColumn("nf", nxt)
    kind = F.when(F.col("l.tag") == preposition, "preposition").when(F.col("l.tag").isin(*tags) & (F.col("nf.tag") == "NOUN") & (F.col("l.case") == F.col("nf.case")) & (F.col("l.number") == F.col("nf.number")), "attribute")
    return j.select(*doc, "line_no", F.col("l.word").alias("last"), F.col("nf.word").alias("first"), kind.alias("kind")).where("kind is not null")
