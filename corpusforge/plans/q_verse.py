"""Queries on metre, line ends, sound and sentences across lines. The supplied texts carry no stress, so a mark is put
before the first vowel of words: the operators then run over all lines, and tests hold them to real stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import verse as V
from corpusforge.plans import lookup
from corpusforge.plans.catalog import query
from corpusforge.plans.q_text import LIN, STANZA, VOWELS, documents, lin, rounded, stanzas
from corpusforge.session import shared_folder

RHYME = f"""{STANZA}, e AS (SELECT doc_id, lang, line_no, list_extract(regexp_extract_all(lower(line), '\\p{{L}}+'), -1) AS last FROM st), f AS (SELECT *, right(last, 3) AS suffix FROM e WHERE length(last) >= 3),
r AS (SELECT *, len(list_distinct(list(last) OVER (PARTITION BY doc_id, suffix ORDER BY line_no RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))) > 1 AS rhymes FROM f)"""


@query("suffix_rhyme_share", f"WITH {RHYME} SELECT lang, count(*) AS lines, round(avg(rhymes::INT), 6) AS share FROM r GROUP BY lang")
def suffix_rhyme_share(spark: SparkSession, sf: str) -> DataFrame:
    r = V.suffix_rhymes(stanzas(spark, sf), ["doc_id"])
    return rounded(r.groupBy("lang").agg(F.count("*").alias("lines"), F.avg(F.col("rhymes").cast("int")).alias("share")), "share")


PAIRS = f"""{RHYME}, p AS (SELECT a.last AS word_i, b.last AS word_j FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.suffix = b.suffix AND a.last <> b.last AND b.line_no - a.line_no BETWEEN 1 AND 4),
d0 AS (SELECT word_i AS word, word_j AS other FROM p UNION ALL SELECT word_j, word_i FROM p), d AS (SELECT word, other, count(*) AS n FROM d0 GROUP BY ALL)"""


def suffix_pairs(spark: SparkSession, sf: str) -> DataFrame:
    last = F.try_element_at(X.lower_tokens("line", r"\p{L}+"), F.lit(-1))
    f = stanzas(spark, sf).select("doc_id", "line_no", last.alias("last")).where("length(last) >= 3").withColumn("suffix", F.right("last", F.lit(3)))
    a = f.select("doc_id", "suffix", F.col("last").alias("word_i"), F.explode(F.array(*[F.col("line_no") + i for i in range(1, 5)])).alias("line_no"))
    b = f.select("doc_id", "suffix", F.col("last").alias("word_j"), "line_no")
    return a.join(b, ["doc_id", "suffix", "line_no"]).where("word_i <> word_j").select("word_i", "word_j")


@query("rhyme_dictionary", f"WITH {PAIRS} SELECT word, sum(n)::BIGINT AS n, count(*) AS n_partners, array_to_string(list(other ORDER BY n DESC, other), ',') AS partners FROM d GROUP BY word")
def rhyme_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    d = V.rhyme_dictionary(suffix_pairs(spark, sf))
    return d.select("word", "n", F.size("partners").cast("long").alias("n_partners"), F.array_join(F.transform("partners", lambda x: x["word"]), ",").alias("partners"))


@query("rhyme_lookup", f"WITH {PAIRS}, m AS (SELECT min(word) AS q FROM (SELECT word FROM d GROUP BY word ORDER BY sum(n) DESC, word LIMIT 1)) SELECT word, sum(n)::BIGINT AS total, count(*) AS n_partners FROM d, m WHERE word = q GROUP BY word")
def rhyme_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = V.rhyme_dictionary(suffix_pairs(spark, sf))
    word = d.orderBy(F.desc("n"), "word").select("word").first()
    return lookup.rhyme_partners(d, word[0] if word else "").select("word", "total", F.col("n_partners").cast("long").alias("n_partners"))


@query("rhyme_examples", f"""WITH {RHYME}, p AS (SELECT a.doc_id, a.line_no, a.suffix, a.last AS word_i, b.last AS word_j FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.suffix = b.suffix AND a.last <> b.last AND b.line_no - a.line_no BETWEEN 1 AND 4), u AS (SELECT suffix, least(word_i, word_j) AS a, greatest(word_i, word_j) AS b, count(*) AS n FROM p GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, a, b) AS k FROM u) SELECT suffix, a, b, n FROM ex WHERE k <= 3""")
def rhyme_examples(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.operators.stats import examples

    u = suffix_pairs(spark, sf).select(F.right("word_i", F.lit(3)).alias("suffix"), F.least("word_i", "word_j").alias("a"), F.greatest("word_i", "word_j").alias("b")).groupBy("suffix", "a", "b").agg(F.count("*").alias("n"))
    return examples(u, ["suffix"], [F.desc("n"), "a", "b"], 3)


@query("unique_rhyme_sample")
def unique_rhyme_sample(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.operators.stats import unique_pairs

    p = suffix_pairs(spark, sf)
    lists = p.withColumns({"list": F.when(F.length("word_i") >= 10, "long").otherwise("short"), "priority": F.when(F.length("word_i") >= 10, 0).otherwise(1)})
    return unique_pairs(lists, "word_i", "word_j", "list", "priority", 20)


ALLIT = f"""{LIN}, a0 AS (SELECT doc_id, line_no, line, list_filter(list_distinct(regexp_extract_all(lower(line), '\\p{{L}}+')), lambda w: length(w) >= 3 AND w NOT IN ('the', 'that') AND NOT regexp_matches(substr(w, 1, 1), '[{VOWELS}]')) AS w FROM lin),
a1 AS (SELECT doc_id, line_no, line, list_transform(w, lambda x: substr(x, 1, 1)) AS f FROM a0), a2 AS (SELECT doc_id, line_no, line, coalesce(list_max(list_transform(list_distinct(f), lambda c: len(list_filter(f, lambda x: x = c)))), 0) AS score FROM a1)"""


@query("alliteration_lines", f"WITH {ALLIT}, r AS (SELECT doc_id, line_no, score, round(score / length(line), 6) AS density FROM a2 WHERE score >= 3 AND length(line) BETWEEN 25 AND 70) SELECT * FROM r ORDER BY score DESC, density DESC, doc_id, line_no LIMIT 50")
def alliteration_lines(spark: SparkSession, sf: str) -> DataFrame:
    scored = lin(spark, sf).where(F.length("line").between(25, 70)).withColumn("score", V.alliteration("line", ["the", "that"]))
    r = rounded(scored.where("score >= 3").select("doc_id", "line_no", "score", (F.col("score") / F.length("line")).alias("density")), "density")
    return r.orderBy(F.desc("score"), F.desc("density"), "doc_id", "line_no").limit(50)


@query("alliteration_share", f"WITH {ALLIT} SELECT doc_id % 10 AS part, count(*) AS lines, round(avg((score >= 3)::INT), 6) AS share FROM a2 WHERE trim(line) <> '' GROUP BY 1")
def alliteration_share(spark: SparkSession, sf: str) -> DataFrame:
    s = lin(spark, sf).where(F.trim("line") != "").select((F.col("doc_id") % 10).alias("part"), (V.alliteration("line", ["the", "that"]) >= 3).cast("int").alias("a"))
    return rounded(s.groupBy("part").agg(F.count("*").alias("lines"), F.avg("a").alias("share")), "share")


def _letters(where: str) -> str:
    return f"(SELECT letter, count(*) / sum(count(*)) OVER () AS share FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}]|[{VOWELS}]', '', 'g'), '')) AS letter FROM documents WHERE {where}) WHERE letter <> '' GROUP BY letter)"


@query("consonant_ratio", f"SELECT a.letter, round(a.share, 6) AS share_a, round(b.share, 6) AS share_b, round(a.share / b.share, 6) AS ratio FROM {_letters(chr(39).join(['lang = ', 'en', '']))} a JOIN {_letters(chr(39).join(['lang = ', 'fr', '']))} b USING (letter)")
def consonant_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return rounded(V.consonant_ratio(d.where("lang = 'en'"), d.where("lang = 'fr'"), "text"), "share_a", "share_b", "ratio")


@query("sentence_spans", f"""WITH {STANZA}, e AS (SELECT doc_id, line_no, stanza_no, rtrim(line) AS line, regexp_matches(rtrim(line), '[.!?…]+[»"'')]*(\\s|$)') AS ends, regexp_matches(rtrim(line), '[.!?…]+[»"'')]*$') AS closes FROM st),
c AS (SELECT doc_id, line_no, stanza_no, ends, ends AND NOT closes AS goes_on, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM e),
x AS (SELECT doc_id, line_no, stanza_no, unnest(CASE WHEN goes_on THEN [k, k + 1] ELSE [k] END) AS sentence_no FROM c), s AS (SELECT doc_id, sentence_no, count(*) AS lines, count(DISTINCT stanza_no) AS stanzas FROM x GROUP BY ALL)
SELECT doc_id, count(*) AS sentences, round(avg(lines), 6) AS mean_lines, max(lines) AS most_lines, count_if(stanzas > 1) AS across_stanzas FROM s GROUP BY doc_id""")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentence_spans(stanzas(spark, sf), ["doc_id"])
    return rounded(s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.avg("lines").alias("mean_lines"), F.max("lines").alias("most_lines"), F.count_if(F.col("stanzas") > 1).alias("across_stanzas")), "mean_lines")


@query("simile_rates", r"""WITH s AS (SELECT lang, sum(len(regexp_extract_all(text, '\p{L}+(?:-\p{L}+)*'))) AS words, sum(len(regexp_extract_all(lower(text), ' as '))) AS a, sum(len(regexp_extract_all(lower(text), ' like '))) AS b FROM documents GROUP BY lang)
SELECT lang, 'as' AS kind, a::BIGINT AS n, round(a * 1000.0 / words, 6) AS per_1000 FROM s UNION ALL SELECT lang, 'like', b::BIGINT, round(b * 1000.0 / words, 6) FROM s""")
def simile_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.simile_rates(documents(spark, sf), ["lang"], {"as": " as ", "like": " like "}), "per_1000")


PLAIN_VOWELS = "aeiouy"
_FROM, _TO = X.LATIN.accents_from, X.LATIN.accents_to
#: Lines as plain words; their profiles where words of four letters or more are stressed on the first vowel.
WORDS = f"""{STANZA}, fw AS (SELECT doc_id, lang, stanza_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, list_filter(string_split(regexp_replace(translate(lower(line), '{_FROM}', '{_TO}'), '[^a-z]+', ' ', 'g'), ' '), lambda w: regexp_matches(w, '[{PLAIN_VOWELS}]')) AS ws FROM st)"""
PROFILE = f"""{WORDS}, vc AS (SELECT doc_id, lang, line_no, list_transform(ws, lambda w: [length(w), length(regexp_replace(w, '[^{PLAIN_VOWELS}]', '', 'g'))]) AS c FROM fw),
pf AS (SELECT doc_id, lang, line_no, array_to_string(list_transform(c, lambda x: CASE WHEN x[2] = 1 THEN CASE WHEN x[1] >= 4 THEN 's' ELSE 'x' END WHEN x[1] >= 4 THEN 'S' || repeat('u', x[2] - 1) ELSE repeat('x', x[2]) END), '') AS p FROM vc),
told AS (SELECT doc_id, line_no, p, list_filter(range(length(p)), lambda i: p[i + 1] IN ('S', 's')) AS places FROM pf WHERE length(regexp_replace(p, '[ux]', '', 'g')) >= 2),
mt AS (SELECT * FROM (VALUES ('iamb', 2, 1, 1), ('trochee', 2, 0, 2), ('dactyl', 3, 0, 3), ('amphibrach', 3, 1, 4), ('anapaest', 3, 2, 5)) v(metre, k, a, ord)),
ft AS (SELECT doc_id, metre, ord, contains(p, 'S') AND len(list_filter(range(length(p)), lambda i: p[i + 1] = 'S' AND (i + k - a) % k <> 0)) = 0 AS fit, CASE WHEN list_max(places) >= a THEN (list_max(places) - a) // k + 1 ELSE 1 END AS feet FROM told, mt),
sh AS (SELECT doc_id, metre, ord, avg(fit::INT) AS share, count(*) AS lines FROM ft GROUP BY ALL HAVING count(*) >= 3),
be AS (SELECT doc_id, arg_min(metre, (-share, ord)) AS metre, max(share) AS share, any_value(lines) AS lines FROM sh GROUP BY doc_id),
gp AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, len(places)), lambda i: places[i + 1] - places[i] - 1), lambda g: g > 0)) AS g FROM told),
gs AS (SELECT doc_id, avg((g = 1)::INT) AS s1, avg((g = 2)::INT) AS s2, avg((g = 3)::INT) AS s3, avg((g >= 5)::INT) AS s5 FROM gp GROUP BY doc_id),
nm AS (SELECT be.doc_id, lines, be.metre AS classical, CASE WHEN share >= 0.85 THEN be.metre WHEN s1 + s2 >= 0.75 AND least(s1, s2) >= 0.15 AND s3 < 0.12 AND s5 <= 0.05 THEN 'dolnik' WHEN s1 + s2 + s3 >= 0.85 AND s3 >= 0.12 AND s5 <= 0.05 THEN 'taktovik' ELSE 'free' END AS metre FROM be LEFT JOIN gs USING (doc_id)),
fc AS (SELECT ft.doc_id, feet, count(*) AS c FROM ft JOIN nm ON ft.doc_id = nm.doc_id AND ft.metre = nm.metre WHERE fit GROUP BY ALL), fm AS (SELECT doc_id, arg_min(feet, (-c, feet)) AS feet, max(c) AS most, sum(c) AS every FROM fc GROUP BY doc_id),
metres AS (SELECT nm.doc_id, lines, metre, CASE WHEN most >= 0.6 * every THEN feet END AS feet FROM nm LEFT JOIN fm USING (doc_id))"""


def _plain_words(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that aren't blank, numbered without gaps, with their words in plain letters."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    flat = F.regexp_replace(X.fold_accents("line"), "[^a-z]+", " ")
    words = F.filter(F.split(flat, " "), lambda x: x.rlike(f"[{PLAIN_VOWELS}]"))
    return stanzas(spark, sf).select("doc_id", "lang", "stanza_no", (F.row_number().over(w) - 1).alias("line_no"), words.alias("ws"))


def _stressed(ws: str, least: int) -> Column:
    marked = F.transform(ws, lambda w: F.when(F.length(w) >= least, F.regexp_replace(w, f"^([^{PLAIN_VOWELS}]*)", "$1+")).otherwise(w))
    return F.array_join(marked, " ")


def _metres(spark: SparkSession, sf: str) -> DataFrame:
    lines = _plain_words(spark, sf).select("doc_id", V.profile(_stressed("ws", 4), PLAIN_VOWELS).alias("profile"))
    return V.classify_metre(lines, ["doc_id"])


@query("metres", f"WITH {PROFILE} SELECT * FROM metres")
def metres(spark: SparkSession, sf: str) -> DataFrame:
    return _metres(spark, sf)


@query("metre_table", f"WITH {PROFILE}, n AS (SELECT lang, metre AS key, sum(lines)::BIGINT AS n FROM metres JOIN documents USING (doc_id) GROUP BY ALL) SELECT lang, key, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM n")
def metre_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.metre_table(_metres(spark, sf), documents(spark, sf).select("doc_id", "lang"), ["doc_id"], "lang"), "share")


def _single(text: str) -> str:
    """SQL for a text of plain letters whose doubled ones are single."""
    for c in "abcdefghijklmnopqrstuvwxyz":
        text = f"replace({text}, '{c}{c}', '{c}')"
    return text


#: Line ends where every word is stressed on its first vowel, the pairs that rhyme, and what answers each line.
ENDS = f"""{WORDS}, e0 AS (SELECT doc_id, lang, stanza_no, line_no, ws[-1] AS last, array_to_string(ws[:-2], '') || regexp_extract(ws[-1], '^[^{PLAIN_VOWELS}]*') AS head, regexp_extract(ws[-1], '[{PLAIN_VOWELS}].*$') AS t FROM fw WHERE len(ws) > 0),
e1 AS (SELECT doc_id, lang, stanza_no, line_no, last, CASE WHEN head = '' OR regexp_matches(head, '[{PLAIN_VOWELS}]$') THEN '' ELSE right(head, 1) END AS support, t[1] AS v, {_single("t[2:]")} AS rest FROM e0),
en AS (SELECT *, v || rest AS key, length(regexp_replace(rest, '[^{PLAIN_VOWELS}]', '', 'g')) AS after, regexp_replace(rest, '[{PLAIN_VOWELS}]', '', 'g') AS cons FROM e1),
py AS (SELECT a.doc_id, a.lang, a.line_no AS i, b.line_no AS j, a.support <> '' AND a.support = b.support AS rich, CASE WHEN a.last = b.last OR a.v <> b.v OR a.after <> b.after THEN NULL WHEN a.key = b.key THEN CASE WHEN length(a.key) = 1 AND a.support <> b.support THEN 'assonance' ELSE 'exact' END
WHEN a.after = 0 AND regexp_matches(a.key, '[{PLAIN_VOWELS}]$') <> regexp_matches(b.key, '[{PLAIN_VOWELS}]$') THEN NULL WHEN a.cons = b.cons OR (levenshtein(a.cons, b.cons) <= 1 AND (a.after > 0 OR least(length(a.cons), length(b.cons)) >= 2)) THEN 'inexact' WHEN right(a.cons, 1) = right(b.cons, 1) THEN 'assonance' END AS type
FROM en a JOIN en b ON a.doc_id = b.doc_id AND b.line_no - a.line_no BETWEEN 1 AND 4 AND b.stanza_no - a.stanza_no <= 1),
pr AS (SELECT doc_id, lang, i, min(j) AS j, arg_min(type, j) AS type, arg_min(rich, j) AS rich FROM py WHERE type IN ('exact', 'inexact') OR (type = 'assonance' AND j - i <= 2) GROUP BY ALL),
wa AS (SELECT doc_id, j AS line_no, i AS partner, i AS o, type FROM pr UNION ALL SELECT doc_id, i, j, i, type FROM pr), pa AS (SELECT doc_id, line_no, arg_min(partner, o) AS partner, arg_min(type, o) AS type FROM wa GROUP BY ALL),
q0 AS (SELECT doc_id, lang, stanza_no, min(line_no) AS s, list(partner ORDER BY line_no) AS q FROM fw LEFT JOIN pa USING (doc_id, line_no) GROUP BY ALL HAVING count(*) = 4),
q1 AS (SELECT *, CASE WHEN q[1] IS NULL THEN '-' ELSE 'A' END AS l1 FROM q0),
q2 AS (SELECT *, l1 || CASE WHEN q[2] IS NULL THEN '-' WHEN q[2] - s = 0 THEN l1 ELSE substr('ABCD', 1 + contains(l1, 'A')::INT, 1) END AS l2 FROM q1),
q3 AS (SELECT *, l2 || CASE WHEN q[3] IS NULL THEN '-' WHEN q[3] - s BETWEEN 0 AND 1 THEN l2[(q[3] - s + 1)::INT] ELSE substr('ABCD', 1 + contains(l2, 'A')::INT + contains(l2, 'B')::INT, 1) END AS l3 FROM q2),
q4 AS (SELECT *, l3 || CASE WHEN q[4] IS NULL THEN '-' WHEN q[4] - s BETWEEN 0 AND 2 THEN l3[(q[4] - s + 1)::INT] ELSE substr('ABCD', 1 + contains(l3, 'A')::INT + contains(l3, 'B')::INT + contains(l3, 'C')::INT, 1) END AS letters FROM q3),
sc AS (SELECT doc_id, lang, stanza_no, letters, CASE WHEN letters IN ('AABB', 'ABAB', 'ABBA') THEN letters WHEN length(letters) - length(replace(letters, '-', '')) >= 2 THEN 'none' ELSE 'other' END AS scheme FROM q4)"""


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    shared_folder(spark)
    ends = _plain_words(spark, sf).withColumn("c", V.clausula(_stressed("ws", 1), PLAIN_VOWELS))
    return ends.select("doc_id", "lang", "stanza_no", "line_no", "c").checkpoint()  # read by pairs, schemes and tables


@query("rhyme_schemes", f"WITH {ENDS} SELECT doc_id, stanza_no, letters, scheme FROM sc")
def rhyme_schemes(spark: SparkSession, sf: str) -> DataFrame:
    ends = _ends(spark, sf)
    return V.quatrain_schemes(V.rhyme_pairs(ends, ["doc_id"], vowels=PLAIN_VOWELS), ends, ["doc_id"])


@query("rhyme_tables", f"""WITH {ENDS}, k AS (SELECT 'type' AS part, fw.lang, coalesce(type, 'none') AS key FROM fw LEFT JOIN pa USING (doc_id, line_no) UNION ALL SELECT 'ending', lang, least(after, 3)::VARCHAR FROM en
UNION ALL SELECT 'rich', lang, CASE WHEN rich THEN 'rich' ELSE 'plain' END FROM pr WHERE type = 'exact' UNION ALL SELECT 'compound', lang, 'simple' FROM pr UNION ALL SELECT 'scheme', lang, scheme FROM sc), n AS (SELECT part, lang, key, count(*) AS n FROM k GROUP BY ALL)
SELECT part, lang, key, n, round(n / sum(n) OVER (PARTITION BY part, lang), 6) AS share FROM n""")
def rhyme_tables(spark: SparkSession, sf: str) -> DataFrame:
    ends = _ends(spark, sf)
    pairs = V.rhyme_pairs(ends, ["doc_id"], vowels=PLAIN_VOWELS).checkpoint()
    poems = documents(spark, sf).select("doc_id", "lang")
    found = V.rhyme_tables(ends.drop("lang"), pairs, poems, ["doc_id"], "lang")
    return rounded(found.withColumnRenamed("table", "part"), "share")


@query("alliteration_against_chance")
def alliteration_against_chance(spark: SparkSession, sf: str) -> DataFrame:
    lines = lin(spark, sf).where(F.trim("line") != "").select("lang", "doc_id", "line_no", "line")
    return V.alliteration_against_chance(lines, ["lang"], ["doc_id", "line_no"], ["the", "that"])


SPANS = """s AS (SELECT lang, doc_id, sentence_no, count(*) AS lines, count(DISTINCT stanza_no) AS stanzas FROM x GROUP BY ALL)"""


@query("span_table", f"""WITH {STANZA}, e AS (SELECT lang, doc_id, line_no, stanza_no, regexp_matches(rtrim(line), '[.!?…]+[»"'')]*(\\s|$)') AS ends, regexp_matches(rtrim(line), '[.!?…]+[»"'')]*$') AS closes FROM st),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM e),
x AS (SELECT lang, doc_id, stanza_no, unnest(CASE WHEN ends AND NOT closes THEN [k, k + 1] ELSE [k] END) AS sentence_no FROM c), {SPANS}
SELECT lang, count(*) AS n, quantile_cont(lines, 0.5) AS median, round(avg(lines), 6) AS mean, quantile_cont(lines, 0.9) AS p90, round(avg((stanzas > 1)::INT), 6) AS across FROM s GROUP BY lang""")
def span_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.span_table(V.sentence_spans(stanzas(spark, sf), ["lang", "doc_id"]), ["lang"]), "mean", "across")
