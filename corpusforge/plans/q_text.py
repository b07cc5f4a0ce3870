"""Queries on words, lines and sentences of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import stats as S
from corpusforge.operators import tokens as T
from corpusforge.plans.catalog import load, query

#: Words with their places, lines with their numbers, and what is left of stanzas, as SQL.
TOK = r"""t0 AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*') AS w FROM documents),
tok AS (SELECT doc_id, lang, source, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t0)"""
LIN = r"""l0 AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
lin AS (SELECT doc_id, lang, source, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM l0)"""
STANZA = LIN + r""",
b0 AS (SELECT *, trim(line) = '' AS blank FROM lin),
b1 AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), TRUE) AS starts FROM b0),
st AS (SELECT * FROM (SELECT doc_id, lang, source, line, line_no, blank, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS stanza_no FROM b1) WHERE NOT blank)"""
VOWELS = X.LATIN.vowels
SYL = f"len(regexp_extract_all(lower(line), '[{VOWELS}]'))"
FUNCTION_WORDS = ["the", "of", "and", "in", "to", "a", "is", "de", "la", "le", "der", "die", "und", "que", "en", "el"]
FW = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
KEYS = ["doc_id", "lang", "source"]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents")


def tok(spark: SparkSession, sf: str) -> DataFrame:
    return T.token_table(documents(spark, sf), KEYS)


def lin(spark: SparkSession, sf: str) -> DataFrame:
    return T.line_table(documents(spark, sf), KEYS)


def stanzas(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_stanzas(lin(spark, sf), ["doc_id"])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounds at the query's boundary: sums of doubles differ in their last bits with their order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("token_top_by_lang", f"""WITH {TOK}, c AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL),
r AS (SELECT lang, word, n, round(n * 10000.0 / sum(n) OVER (PARTITION BY lang), 6) AS per_10k, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c)
SELECT * FROM r WHERE rank <= 20""")
def token_top_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.top_terms(tok(spark, sf), ["lang"]), "per_10k")


@query("overview_by_source", f"""WITH {TOK} SELECT a.source, texts, tokens, types FROM (SELECT source, count(*) AS texts FROM documents GROUP BY 1) a
LEFT JOIN (SELECT source, count(*) AS tokens, count(DISTINCT word) AS types FROM tok GROUP BY 1) b USING (source)""")
def overview_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return S.overview(documents(spark, sf), tok(spark, sf), ["source"])


@query("line_syllable_stats", f"""WITH {STANZA} SELECT doc_id, count(*) AS lines, sum(len(regexp_extract_all(line, '\\p{{L}}+(?:-\\p{{L}}+)*'))) AS words,
median({SYL}) AS median_syllables, round(avg({SYL}), 6) AS mean_syllables FROM st GROUP BY doc_id""")
def line_syllable_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.line_stats(lin(spark, sf).where(F.trim("line") != ""), ["doc_id"]), "mean_syllables")


@query("syllable_quartiles", f"""WITH {STANZA}, v AS (SELECT source, {SYL} AS s FROM st)
SELECT source, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q3, round(avg(s), 6) AS mean, max(s) AS most, count(*) AS n FROM v GROUP BY source HAVING count(*) >= 40""")
def syllable_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    v = lin(spark, sf).where(F.trim("line") != "").select("source", X.syllables("line").alias("s"))
    return rounded(S.quartiles(v, ["source"], "s"), "q1", "median", "q3", "mean")


HIST = f"""{STANZA}, v AS (SELECT lang, least({SYL}, 30) AS bin FROM st), g AS (SELECT lang, unnest(range(31)) AS bin FROM (SELECT DISTINCT lang FROM v)),
h AS (SELECT g.lang, g.bin, count(v.bin) AS n FROM g LEFT JOIN v USING (lang, bin) GROUP BY ALL)"""


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    v = lin(spark, sf).where(F.trim("line") != "").select("lang", X.syllables("line").alias("s"))
    return S.clipped_histogram(v, ["lang"], "s", 30)


@query("syllable_histogram", f"WITH {HIST} SELECT lang, bin, n FROM h")
def syllable_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(spark, sf)


@query("syllable_p75_from_histogram", f"""WITH {HIST}, c AS (SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY lang) AS total FROM h)
SELECT lang, min(bin) AS bin FROM c WHERE cum >= 0.75 * total GROUP BY lang""")
def syllable_p75(spark: SparkSession, sf: str) -> DataFrame:
    return S.percentile_from_histogram(histogram(spark, sf), ["lang"], 0.75)


@query("stanza_buckets", f"""WITH {STANZA}, s AS (SELECT lang, doc_id, stanza_no, count(*) AS size FROM st GROUP BY ALL),
b AS (SELECT lang, CASE WHEN size = 1 THEN '1' WHEN size <= 3 THEN '2-3' WHEN size = 4 THEN '4' WHEN size <= 8 THEN '5-8' ELSE '9+' END AS bucket, count(*) AS n FROM s GROUP BY ALL)
SELECT lang, bucket, n, round(n * 100.0 / sum(n) OVER (PARTITION BY lang), 6) AS share FROM b""")
def stanza_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.stanza_buckets(stanzas(spark, sf), ["doc_id"], ["lang"]), "share")


@query("block_numbers", f"""WITH {STANZA}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stanza_no ORDER BY line_no) - 1 AS i FROM st)
SELECT doc_id, count(*) AS lines, count(DISTINCT stanza_no) AS stanzas, sum((i % 12 = 0)::INT) AS blocks FROM k GROUP BY doc_id""")
def block_numbers(spark: SparkSession, sf: str) -> DataFrame:
    b = T.with_blocks(stanzas(spark, sf), ["doc_id"])
    return b.groupBy("doc_id").agg(F.count("*").alias("lines"), F.countDistinct("stanza_no").alias("stanzas"), (F.max("block_no") + 1).alias("blocks"))


@query("sentence_starts", f"""WITH {STANZA}, p AS (SELECT doc_id, coalesce(regexp_matches(lag(rtrim(line)) OVER w, '[.!?…][»"'')]*$'), TRUE) AS s, regexp_matches(line, '^\\s*\\p{{Lu}}')::INT AS c FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, sum(s::INT) AS starts, avg(c) >= 0.8 AS caps_convention FROM p GROUP BY doc_id""")
def sentence_starts(spark: SparkSession, sf: str) -> DataFrame:
    s = T.with_sentence_start(stanzas(spark, sf), ["doc_id"])
    return s.groupBy("doc_id").agg(F.sum(F.col("starts_sentence").cast("int")).alias("starts"), F.bool_or("caps_convention").alias("caps_convention"))


PUNCT_SQL = {"comma": "len(regexp_extract_all(t, ','))", "period": "len(list_filter(regexp_extract_all(t, '\\.+'), lambda x: x = '.'))", "ellipsis": "len(regexp_extract_all(t, '\\.\\.\\.'))", "exclamation": "len(regexp_extract_all(t, '!'))", "question": "len(regexp_extract_all(t, '\\?'))", "colon": "len(regexp_extract_all(t, ':'))", "semicolon": "len(regexp_extract_all(t, ';'))", "dash": "len(regexp_extract_all(t, '—'))", "parenthesis": "len(regexp_extract_all(t, '\\('))", "quote": "len(regexp_extract_all(t, '[«\"“]'))"}


@query("punctuation_rates", "WITH n AS (SELECT source, len(regexp_extract_all(text, '\\p{L}+(?:-\\p{L}+)*')) AS w, replace(replace(replace(text, '--', '—'), ' - ', ' — '), '…', '...') AS t FROM documents), s AS (SELECT source, sum(w) AS words, " + ", ".join(f"sum({e}) AS {m}" for m, e in PUNCT_SQL.items()) + " FROM n GROUP BY source)\n" + " UNION ALL ".join(f"SELECT source, '{m}' AS mark, {m}::BIGINT AS n, round({m} * 1000.0 / words, 6) AS per_1000 FROM s" for m in PUNCT_SQL))
def punctuation_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.punctuation_rates(documents(spark, sf), ["source"]), "per_1000")


@query("open_line_ends", f"WITH {STANZA} SELECT lang, count(*) AS lines, round(100 * avg(regexp_matches(rtrim(line), '\\p{{L}}$')::INT), 6) AS open_share FROM st GROUP BY lang")
def open_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.open_line_share(lin(spark, sf), ["lang"]), "open_share")


@query("word_length_histogram", f"WITH {TOK}, c AS (SELECT lang, least(length(replace(word, '-', '')), 15) AS length, count(*) AS n FROM tok GROUP BY ALL) SELECT lang, length, n, round(n * 100.0 / sum(n) OVER (PARTITION BY lang), 6) AS share FROM c")
def word_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.word_lengths(tok(spark, sf), ["lang"]), "share")


@query("sentence_length_stats", r"""WITH s AS (SELECT lang, unnest(string_split(regexp_replace(text, '([.!?])\s+([«"(—\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents),
n AS (SELECT lang, len(regexp_extract_all(x, '\p{L}+(?:-\p{L}+)*')) AS w FROM s)
SELECT lang, count(*) AS n, median(w) AS median, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.9), 6) AS p90, max(w) AS most, count_if(w <= 5) AS w1_5, count_if(w BETWEEN 6 AND 10) AS w6_10, count_if(w BETWEEN 11 AND 20) AS w11_20, count_if(w BETWEEN 21 AND 40) AS w21_40, count_if(w > 40) AS w41 FROM n WHERE w > 0 GROUP BY lang""")
def sentence_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.sentence_stats(T.sentence_table(documents(spark, sf), KEYS), ["lang"]), "mean", "p90")


@query("longest_records", f"""WITH {TOK}, w AS (SELECT DISTINCT lang, word FROM tok), r AS (SELECT lang, word, length(word) AS value, row_number() OVER (PARTITION BY lang ORDER BY length(word) DESC, word) AS k FROM w) SELECT lang, value, word FROM r WHERE k = 1""")
def longest_records(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest(tok(spark, sf), ["lang"], F.length("word"), ["word"])


LOG_ODDS = """c AS (SELECT {g}, word, count(*) AS n FROM {src} GROUP BY ALL), w AS (SELECT word, sum(n) AS all_n FROM c GROUP BY 1), gr AS (SELECT {g}, sum(n) AS gn FROM c GROUP BY 1), tt AS (SELECT sum(gn) AS total FROM gr),
j AS (SELECT c.{g}, c.word, c.n, all_n - n AS rest, 0.01 * all_n AS a, 0.01 * total AS big, gn, total - gn AS rn FROM c JOIN w USING (word) JOIN gr USING ({g}), tt WHERE n >= {least}),
z AS (SELECT {g}, word, n, rest, (ln((n + a) / (gn + big - n - a)) - ln((rest + a) / (rn + big - rest - a))) / sqrt(1 / (n + a) + 1 / (rest + a)) AS z FROM j)"""


@query("distinctive_words_logodds", f"WITH {TOK}, {LOG_ODDS.format(g='lang', src='tok', least=5)}, r AS (SELECT lang, word, n::BIGINT AS n, rest::BIGINT AS rest, round(z, 6) AS z, row_number() OVER (PARTITION BY lang ORDER BY round(z, 6) DESC, word) AS rank FROM z) SELECT * FROM r WHERE rank <= 15")
def distinctive_words(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    z = rounded(S.log_odds(tok(spark, sf), "lang"), "z")
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("z"), "word"))).where("rank <= 15")


@query("theme_words_logodds", f"WITH {TOK}, m AS (SELECT CASE WHEN source = 'src1' THEN 'theme' ELSE 'rest' END AS side, word FROM tok), {LOG_ODDS.format(g='side', src='m', least=3)} SELECT word, n::BIGINT AS n, rest::BIGINT AS rest, round(z, 6) AS z FROM z WHERE side = 'theme'")
def theme_words(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.theme_log_odds(tok(spark, sf), F.col("source") == "src1"), "z")


@query("mattr_by_doc", f"""WITH {TOK}, p AS (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos), -1) AS last, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
s AS (SELECT doc_id, n, sum(greatest(least(pos, n - 100) - greatest(last + 1, pos - 99, 0) + 1, 0)) AS new FROM p GROUP BY ALL)
SELECT doc_id, n, CASE WHEN n >= 100 THEN round(new / (n - 99) / 100, 6) END AS mattr FROM s""")
def mattr_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.mattr(tok(spark, sf), ["doc_id"], 100), "mattr")


@query("hapax_by_source", f"WITH {TOK}, c AS (SELECT source, word, count(*) AS n FROM tok GROUP BY ALL) SELECT source, count(*) AS types, count_if(n = 1) AS hapax, sum(n)::BIGINT AS tokens FROM c GROUP BY source")
def hapax_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return S.hapax(tok(spark, sf), ["source"])


@query("zipf_points", f"""WITH {TOK}, c AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c),
k AS (SELECT DISTINCT round(exp(ln(1000.0) / 11 * i))::BIGINT AS rank FROM range(12) x(i)) SELECT lang, rank, word, n FROM r JOIN k USING (rank)""")
def zipf_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.zipf(tok(spark, sf), ["lang"]).select("lang", "rank", "word", "n")


@query("heaps_curve", f"""WITH {TOK}, o AS (SELECT source, doc_id, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t0),
f AS (SELECT tok.source, word, min(off + pos) AS place FROM tok JOIN o USING (source, doc_id) GROUP BY ALL), e AS (SELECT source, sum(n) AS total FROM o GROUP BY 1),
g AS (SELECT source, total, unnest(range(((total - 1) // 1500 + 1)::BIGINT)) AS bin FROM e WHERE total > 0), b AS (SELECT source, (place // 1500)::BIGINT AS bin, count(*) AS new FROM f GROUP BY ALL)
SELECT g.source, least((g.bin + 1) * 1500, total)::BIGINT AS tokens_to, (sum(coalesce(new, 0)) OVER (PARTITION BY g.source ORDER BY g.bin))::BIGINT AS types FROM g LEFT JOIN b ON g.source = b.source AND g.bin = b.bin""")
def heaps_curve(spark: SparkSession, sf: str) -> DataFrame:
    return S.heaps(documents(spark, sf), "source")


LEXICON = [("motion", "thing"), ("motion", "re"), ("motion", "st"), ("place", "in"), ("place", "on"), ("place", "at"), ("time", "then"), ("time", "er"), ("person", "he"), ("person", "er"), ("person", "elle"), ("person", "yo")]
LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{w}')" for f, w in LEXICON) + ") v(field, word))"


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "field string, word string")


@query("field_rates", f"""WITH {TOK}, {LEX_SQL}, t AS (SELECT lang, count(*) AS total FROM tok GROUP BY 1), h AS (SELECT lang, field, count(*) AS n FROM tok JOIN lex USING (word) GROUP BY ALL)
SELECT lang, field, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1000.0 / total, 6) AS rate FROM t CROSS JOIN (SELECT DISTINCT field FROM lex) LEFT JOIN h USING (lang, field)""")
def field_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.field_rates(tok(spark, sf), lexicon(spark), ["lang"]), "rate")


@query("field_words_pivot", f"""WITH {TOK}, {LEX_SQL} SELECT field, word, count_if(lang = 'en') AS en, count_if(lang = 'fr') AS fr, count_if(lang = 'de') AS de, count_if(lang = 'es') AS es FROM tok JOIN lex USING (word) GROUP BY ALL""")
def field_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.field_words(tok(spark, sf), lexicon(spark), "lang", ["en", "fr", "de", "es"])


@query("tfidf_top_terms", f"""WITH {TOK}, f AS (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS nd FROM documents),
s AS (SELECT doc_id, word, tf, df, round(tf * ln(nd / df), 6) AS score FROM f JOIN d USING (word), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s) SELECT doc_id, word, tf, df, score, rank FROM r WHERE rank <= 6""")
def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    found = S.tf_idf(tok(spark, sf), "doc_id", docs.count(), 6)
    return rounded(found, "score").select("doc_id", "word", "tf", "df", "score", "rank")


@query("inverted_index", f"""WITH {TOK}, p AS (SELECT word, doc_id, lang, count(*) AS c FROM tok GROUP BY ALL)
SELECT word, sum(c)::BIGINT AS n, count(*) AS docs, sum(CASE WHEN lang = 'en' THEN c ELSE 0 END)::BIGINT AS n_en, sum(CASE WHEN lang = 'fr' THEN c ELSE 0 END)::BIGINT AS n_fr, array_to_string(list_sort(list(doc_id)), ',') AS postings FROM p GROUP BY word HAVING sum(c) >= 5 AND count(*) >= 2""")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    found = S.inverted_index(tok(spark, sf), "lang", ["en", "fr"], "doc_id", 5, 2)
    return found.withColumn("postings", F.array_join(F.transform("postings", lambda x: x.cast("string")), ","))


@query("doc_cards", f"""WITH {STANZA}, m AS (SELECT doc_id, count(*) AS lines, sum(len(regexp_extract_all(line, '\\p{{L}}+(?:-\\p{{L}}+)*'))) AS words, median({SYL}) AS median_syllables, round(avg({SYL}), 6) AS mean_syllables, round(100 * avg(regexp_matches(rtrim(line), '\\p{{L}}$')::INT), 6) AS open_share,
round(100 * avg(coalesce(list_extract(regexp_extract_all(lower(line), '\\p{{L}}+(?:-\\p{{L}}+)*'), -1) IN ({FW}), FALSE)::INT), 6) AS function_end_share, count(DISTINCT stanza_no) AS stanzas FROM st GROUP BY doc_id),
z AS (SELECT doc_id, size, count(*) AS c FROM (SELECT doc_id, stanza_no, count(*) AS size FROM st GROUP BY ALL) GROUP BY ALL), y AS (SELECT doc_id, size AS modal_stanza FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, size) AS k FROM z) WHERE k = 1)
SELECT * FROM m JOIN y USING (doc_id)""")
def doc_cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.doc_cards(documents(spark, sf), function_words=FUNCTION_WORDS), "mean_syllables", "open_share", "function_end_share")


@query("line_final_function_words", f"""WITH {LIN}, e AS (SELECT lang, list_extract(regexp_extract_all(lower(line), '\\p{{L}}+(?:-\\p{{L}}+)*'), -1) AS word FROM lin), f AS (SELECT * FROM e WHERE word IS NOT NULL), t AS (SELECT lang, count(*) AS total FROM f GROUP BY 1),
c AS (SELECT lang, word, count(*) AS n FROM f WHERE word IN ({FW}) GROUP BY ALL), r AS (SELECT lang, word, n, round(n / total, 6) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c JOIN t USING (lang)) SELECT * FROM r WHERE rank <= 10""")
def line_final_function_words(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.line_final_words(lin(spark, sf), ["lang"], FUNCTION_WORDS), "share")


@query("token_neighbours", f"""WITH {TOK}, n AS (SELECT lang, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM tok), c AS (SELECT lang, word, following, count(*) AS n FROM n WHERE following IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word, following) AS rank FROM c) SELECT * FROM r WHERE rank <= 20""")
def token_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = T.with_neighbours(tok(spark, sf), ["doc_id"]).where("following is not null").groupBy("lang", "word", "following").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word", "following"))).where("rank <= 20")


@query("first_types", f"WITH {TOK}, r AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS k FROM tok) SELECT source, count(DISTINCT word) AS types FROM r WHERE k <= 2000 GROUP BY source")
def first_types(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_types(tok(spark, sf), ["source"], ["doc_id", "pos"], 2000)


@query("growing_words", f"""WITH {TOK}, c AS (SELECT source, word, count(*) AS n FROM tok GROUP BY ALL), x AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS g, sum(n) OVER (PARTITION BY word) AS w, sum(n) OVER () AS total FROM c),
y AS (SELECT source, word, n, round(g / (w / total), 6) AS growth FROM x WHERE n >= 6 AND g / (w / total) >= 1.5), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY growth DESC, word) AS rank FROM y) SELECT * FROM r WHERE rank <= 7""")
def growing_words(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    counts = tok(spark, sf).groupBy("source", "word").agg(F.count("*").alias("n"))
    g = rounded(S.growth(counts, "source", k=1 << 30), "growth")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("growth"), "word"))).where("rank <= 7")


@query("words_near_triggers", f"""WITH {TOK}, x AS (SELECT doc_id, word, max((word IN ('the', 'of'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS near FROM tok)
SELECT word, count(*) AS n FROM x WHERE near = 1 AND word NOT IN ('the', 'of') AND word NOT IN ('a', 'in', 'to') GROUP BY word ORDER BY n DESC, word LIMIT 70""")
def words_near_triggers(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("a",), ("in",), ("to",)], "word string")
    return S.words_near(tok(spark, sf), ["the", "of"], ["doc_id"], known=known)


@query("undercount_audit", f"""WITH {TOK}, s AS (SELECT * FROM (VALUES ('thing', 'thin'), ('then', 'the'), ('ander', 'ande')) v(word, stem)), c AS (SELECT word, count(*) AS n FROM tok GROUP BY 1), r AS (SELECT s.word, sum(c.n)::BIGINT AS raw FROM c JOIN s ON s.stem IN (left(c.word, 3), left(c.word, 4)) GROUP BY 1)
SELECT r.word, raw, coalesce(c.n, 0) AS got FROM r LEFT JOIN c USING (word) WHERE raw > coalesce(c.n, 0)""")
def undercount_audit(spark: SparkSession, sf: str) -> DataFrame:
    stems = spark.createDataFrame([("thing", "thin"), ("then", "the"), ("ander", "ande")], "word string, stem string")
    counted = tok(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    return S.undercount_audit(documents(spark, sf), counted, stems)


@query("word_count_difference", f"""WITH {TOK}, a AS (SELECT word, count(*) AS x FROM tok WHERE lang = 'en' AND source = 'src0' GROUP BY 1), b AS (SELECT word, count(*) AS y FROM tok WHERE lang = 'en' AND source <> 'src0' GROUP BY 1)
SELECT word, coalesce(x, 0) - coalesce(y, 0) AS n FROM a FULL JOIN b USING (word) WHERE coalesce(x, 0) > coalesce(y, 0)""")
def word_count_difference(spark: SparkSession, sf: str) -> DataFrame:
    en = tok(spark, sf).where("lang = 'en'")
    a = en.where("source = 'src0'").groupBy("word").agg(F.count("*").alias("n"))
    b = en.where("source <> 'src0'").groupBy("word").agg(F.count("*").alias("n"))
    return S.multiset_difference(a, b, "word")


@query("prefix_search", f"WITH {TOK} SELECT word, count(*) AS n FROM tok WHERE starts_with(word, 'thi') GROUP BY word ORDER BY n DESC, word LIMIT 10")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.plans.lookup import suggestions

    return suggestions(tok(spark, sf), "word", "thi", 10)


@query("sentence_length_by_speaker", r"""WITH w AS (SELECT role, regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*') AS w FROM conversations), t AS (SELECT role, unnest(w) AS word FROM w)
SELECT role, count(*) AS tokens, round(count_if(word IN ('i', 'you', 'he', 'she', 'it', 'we', 'they')) * 1000.0 / count(*), 6) AS pronouns, round(count_if(word = 'the') * 1000.0 / count(*), 6) AS articles FROM t GROUP BY role""")
def speaker_word_rates(spark: SparkSession, sf: str) -> DataFrame:
    t = T.token_table(load(spark, sf, "conversations"), ["role"])
    n = F.count("*")
    return rounded(t.groupBy("role").agg(n.alias("tokens"), (F.count_if(F.col("word").isin("i", "you", "he", "she", "it", "we", "they")) * 1000.0 / n).alias("pronouns"), (F.count_if(F.col("word") == "the") * 1000.0 / n).alias("articles")), "pronouns", "articles")


@query("english_subset", f"""WITH {TOK}, c AS (SELECT word, count(*) AS n FROM tok WHERE lang = 'en' AND word NOT IN ({FW}) GROUP BY 1) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c ORDER BY n DESC, word LIMIT 30""")
def english_subset(spark: SparkSession, sf: str) -> DataFrame:
    kept = tok(spark, sf).where((F.col("lang") == "en") & ~F.col("word").isin(FUNCTION_WORDS))
    return S.top_terms(kept.withColumn("all", F.lit(1)), ["all"], 30).select("word", "n", "rank")


@query("first_and_last_examples", f"""WITH {LIN}, e AS (SELECT doc_id, line_no, line, unnest(list_intersect(regexp_extract_all(lower(line), '\\p{{L}}+(?:-\\p{{L}}+)*'), ['thing', 'ander', 'the', 'der'])) AS word FROM lin WHERE length(line) BETWEEN 20 AND 80)
SELECT word, arg_min(line, doc_id * 100000 + line_no) AS first, arg_max(line, doc_id * 100000 + line_no) AS last FROM e GROUP BY word""")
def first_and_last_examples(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.operators.docs import first_and_last_examples as examples

    return examples(lin(spark, sf), ["thing", "ander", "the", "der"], ["doc_id"])


@query("author_measures", f"""WITH {STANZA}, a AS (SELECT source, avg({SYL}) AS syllables, 100 * avg(regexp_matches(rtrim(line), '\\p{{L}}$')::INT) AS open_share FROM st GROUP BY 1),
n AS (SELECT source, len(regexp_extract_all(text, '\\p{{L}}+(?:-\\p{{L}}+)*')) AS w, replace(replace(replace(replace(text, '--', '—'), ' - ', ' — '), '…', '...'), ' – ', ' — ') AS t FROM documents),
b AS (SELECT source, count(*) AS texts, sum(w)::BIGINT AS words, sum(len(regexp_extract_all(t, ','))) * 1000.0 / sum(w) AS commas, sum(len(regexp_extract_all(t, '—'))) * 1000.0 / sum(w) AS dashes FROM n GROUP BY 1),
s0 AS (SELECT source, unnest(string_split(regexp_replace(text, '([.!?])\\s+([«"(—\\p{{Lu}}0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS x FROM documents), s AS (SELECT source, len(regexp_extract_all(x, '\\p{{L}}+(?:-\\p{{L}}+)*')) AS w FROM s0), c AS (SELECT source, avg(w) AS sentence_words FROM s WHERE w > 0 GROUP BY 1),
{TOK}, k AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS k FROM tok), d AS (SELECT source, count(DISTINCT word) AS types FROM k WHERE k <= 3000 GROUP BY 1)
SELECT source, texts, words, round(commas, 6) AS commas, round(dashes, 6) AS dashes, round(syllables, 6) AS syllables, round(open_share, 6) AS open_share, round(sentence_words, 6) AS sentence_words, types FROM b LEFT JOIN a USING (source) LEFT JOIN c USING (source) LEFT JOIN d USING (source)""")
def author_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.author_measures(documents(spark, sf), "source", 3000), "commas", "dashes", "syllables", "open_share", "sentence_words")


@query("word_rate_series", f"WITH {TOK} SELECT source, count_if(word = 'the') AS n, round(count_if(word = 'the') * 10000.0 / count(*), 6) AS rate FROM tok GROUP BY source")
def word_rate_series(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.plans.lookup import rate_series

    return rounded(rate_series(tok(spark, sf), "the", "source"), "rate")


@query("without_notes", "SELECT doc_id, md5(string_split(text, chr(10) || chr(10) || 'Notes:')[1]) AS body FROM documents")
def without_notes(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.operators.docs import without_notes as cut

    return documents(spark, sf).select("doc_id", F.md5(cut("text")).alias("body"))
