"""Queries on names, co-mention and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import entities as E
from corpusforge.operators import graph as G
from corpusforge.operators import tokens as T
from corpusforge.plans import lookup
from corpusforge.plans.catalog import query
from corpusforge.plans.q_text import KEYS, TOK, documents, rounded, tok
from corpusforge.session import shared_folder

CASED = r"""c0 AS (SELECT doc_id, lang, regexp_extract_all(text, '\p{L}+(?:-\p{L}+)*') AS w FROM documents), cased AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS pos FROM c0)"""


@query("proper_nouns", f"WITH {CASED} SELECT lower(word) AS word, count(*) AS n, round(avg(regexp_matches(word, '^\\p{{Lu}}')::INT), 6) AS capitalised FROM cased GROUP BY 1 HAVING count(*) >= 3 AND avg(regexp_matches(word, '^\\p{{Lu}}')::INT) >= 0.6")
def proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    t = T.token_table(documents(spark, sf), KEYS, lower=False)
    return rounded(E.proper_nouns(t, least=3), "capitalised")


@query("mid_sentence_names", r"""WITH s0 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([«"(—\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents), w0 AS (SELECT regexp_extract_all(s, '\p{L}+(?:-\p{L}+)*') AS w FROM s0), t AS (SELECT unnest(w) AS word, unnest(range(len(w))) AS pos FROM w0)
SELECT lower(word) AS word, count(*) AS n, round(avg(regexp_matches(word, '^\p{Lu}')::INT), 6) AS capitalised FROM t WHERE pos > 0 GROUP BY 1 HAVING count(*) >= 2 AND avg(regexp_matches(word, '^\p{Lu}')::INT) >= 0.7""")
def mid_sentence_names(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentence_table(documents(spark, sf), ["doc_id"])
    t = s.select(F.posexplode(X.tokens("sentence")).alias("pos", "word")).withColumn("starts_sentence", F.col("pos") == 0)
    return rounded(E.proper_nouns(t, 0.7, 2, mid_sentence=True), "capitalised")


@query("name_votes", f"""WITH {CASED}, n AS (SELECT word, lag(word) OVER w AS p, lead(word) OVER w AS f FROM cased WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), v AS (SELECT lower(word) AS word, CASE WHEN lower(p) IN ('in', 'at', 'to') THEN 'prep' WHEN coalesce(regexp_matches(p, '^\\p{{Lu}}\\p{{Ll}}'), FALSE) OR coalesce(regexp_matches(f, '^\\p{{Lu}}\\p{{Ll}}'), FALSE) OR lower(p) IN ('mr') THEN 'person' END AS vote FROM n WHERE regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}')),
k AS (SELECT word, count(*) AS n, avg((coalesce(vote, '') = 'person')::INT) AS person, avg((coalesce(vote, '') = 'prep')::INT) AS prep FROM v GROUP BY word)
SELECT word, n, round(person, 6) AS person, round(prep, 6) AS prep, CASE WHEN n < 2 THEN NULL WHEN word = 'the' THEN 'place' WHEN prep >= 0.25 AND prep > person THEN 'place' WHEN person >= 0.3 THEN 'person' ELSE 'other' END AS kind FROM k""")
def name_votes(spark: SparkSession, sf: str) -> DataFrame:
    t = T.token_table(documents(spark, sf), ["doc_id"], lower=False)
    places = spark.createDataFrame([("the",)], "word string")
    return rounded(E.kinds(E.votes(t, ["doc_id"], ["mr"], ["in", "at", "to"]), places), "person", "prep")


#: Longer words that are in 0.8 to 4 % of the documents stand for names, since the supplied texts are invented: shares,
#: so the rule is the same at every size.
OCC = f"{TOK}, o0 AS (SELECT word FROM tok WHERE length(word) >= 7 GROUP BY word HAVING count(DISTINCT doc_id) * 1000 BETWEEN 8 * (SELECT count(*) FROM documents) AND 40 * (SELECT count(*) FROM documents)), occ AS (SELECT doc_id, lang, pos, word FROM tok JOIN o0 USING (word))"
EDGES = f"{OCC}, d AS (SELECT DISTINCT doc_id, word FROM occ), ed AS (SELECT a.word AS src, b.word AS dst, count(*) AS w FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL HAVING count(*) >= 2)"
BOTH = f"{EDGES}, bo AS (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed), rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM bo)"


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    n = docs.count()
    long = docs.select("doc_id", "lang", F.filter(F.transform(X.lower_tokens("text"), lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.length(x["word"]) >= 7).alias("w"))
    d = long.select(F.explode(F.array_distinct("w.word")).alias("word")).groupBy("word").agg(F.count("*").alias("d"))
    names = d.where((F.col("d") * 1000).between(8 * n, 40 * n)).select("word")
    return long.select("doc_id", "lang", F.explode("w").alias("x")).select("doc_id", "lang", "x.pos", "x.word").join(names, "word").select("doc_id", "lang", "pos", "word")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.co_mention(occurrences(spark, sf), ["doc_id"], 2)


@query("co_mention_edges", f"WITH {EDGES} SELECT * FROM ed")
def co_mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query("entity_stats", f"WITH {OCC} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS texts, count_if(lang = 'en') AS n_en, count_if(lang = 'fr') AS n_fr FROM occ GROUP BY word")
def entity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return E.entity_stats(occurrences(spark, sf), "lang", ["en", "fr"], "doc_id")


@query("network_core", f"WITH {OCC}, s AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS texts FROM occ GROUP BY word) SELECT * FROM s WHERE texts >= 3 ORDER BY texts DESC, n DESC, word LIMIT 120")
def network_core(spark: SparkSession, sf: str) -> DataFrame:
    return E.network_core(E.entity_stats(occurrences(spark, sf), "lang", [], "doc_id"))


@query("strong_edges", f"WITH {BOTH}, u AS (SELECT src, dst, w FROM bo WHERE w >= 3 UNION ALL SELECT src, dst, w FROM rk WHERE rank = 1) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS w FROM u GROUP BY 1, 2")
def strong_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.strong_edges(edges(spark, sf), 3)


@query("neighbours", f"WITH {BOTH} SELECT src, dst, w, rank FROM rk WHERE rank <= 6")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(edges(spark, sf))


HUB = f"{BOTH}, hb AS (SELECT src AS node FROM bo GROUP BY src ORDER BY sum(w) DESC, src LIMIT 24)"


@query("hub_map", f"WITH {HUB}, sh AS (SELECT node FROM hb UNION SELECT dst FROM rk JOIN hb ON src = node WHERE rank <= 5) SELECT src, dst, w FROM ed WHERE src IN (SELECT node FROM sh) AND dst IN (SELECT node FROM sh)")
def hub_map(spark: SparkSession, sf: str) -> DataFrame:
    return G.hub_map(edges(spark, sf))


@query("ego_graph", f"""WITH {HUB}, me AS (SELECT node FROM hb ORDER BY node LIMIT 1), one AS (SELECT dst AS node FROM bo JOIN me ON src = node ORDER BY w DESC, dst LIMIT 22), e0 AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM bo WHERE src IN (SELECT node FROM one) AND dst NOT IN (SELECT node FROM one) AND dst NOT IN (SELECT node FROM me)),
two AS (SELECT dst AS node FROM e0 WHERE r <= 3 GROUP BY dst ORDER BY max(w) DESC, dst LIMIT 45) SELECT node, 0 AS hop FROM me UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def ego_graph(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    hubs = G.strength(G.symmetric(e)).orderBy(F.desc("strength"), "node").limit(24)
    node = hubs.agg(F.min("node")).first()[0]
    return G.ego(e, node or "")


@query("graph_components", f"""WITH RECURSIVE {BOTH}, es AS (SELECT src, dst FROM bo WHERE w >= 5), reach AS (SELECT DISTINCT src AS node, src AS seen FROM es UNION SELECT reach.node, es.dst FROM reach JOIN es ON reach.seen = es.src) SELECT node, min(seen) AS label FROM reach GROUP BY node""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(edges(spark, sf).where("w >= 5").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("label_families")
def label_families(spark: SparkSession, sf: str) -> DataFrame:
    return G.families(G.family_labels(G.hub_map(edges(spark, sf))))


@query("chord_network")
def chord_network(spark: SparkSession, sf: str) -> DataFrame:
    shared_folder(spark)
    shown = G.hub_map(edges(spark, sf)).checkpoint()  # a network as shown, read by labels, arcs and ribbons
    labels = G.family_labels(shown)
    arcs = G.chord_arcs(shown, labels.select("node", F.col("label").alias("cluster"))).checkpoint()
    return rounded(G.chord_ribbons(shown, arcs), "src_start", "src_stop", "dst_start", "dst_stop")


@query("entity_filter", f"WITH {OCC}, s AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS texts, count_if(lang = 'en') AS n_en FROM occ GROUP BY word) SELECT * FROM s WHERE starts_with(word, 'th') AND n_en > 0 AND n >= 10")
def entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.entity_filter(E.entity_stats(occurrences(spark, sf), "lang", ["en"], "doc_id"), "th", "en", 10)


@query("entity_ranking", f"WITH {OCC}, s AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS texts FROM occ GROUP BY word) SELECT * FROM s ORDER BY texts DESC, n DESC, word LIMIT 15")
def entity_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.ranking(E.entity_stats(occurrences(spark, sf), "lang", [], "doc_id"), ["texts", "n"], 15)


@query("rare_words", f"WITH {TOK} SELECT word, count(*) AS n FROM tok GROUP BY word HAVING count(*) <= 2")
def rare_words(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.rare(tok(spark, sf).groupBy("word").agg(F.count("*").alias("n")))


@query("display_forms", f"""WITH {CASED}, f AS (SELECT lower(word) AS lemma, word, count(*) AS n FROM cased GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY lemma) AS top FROM f), r AS (SELECT lemma, word, row_number() OVER (PARTITION BY lemma ORDER BY (lower(word) <> lemma), length(word), n DESC, word) AS k FROM t WHERE n >= 0.25 * top OR lower(word) = lemma) SELECT lemma, word AS display FROM r WHERE k = 1""")
def display_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = T.token_table(documents(spark, sf), ["doc_id"], lower=False).withColumn("lemma", F.lower("word"))
    return E.display_forms(t)


SHELVES = [("motion", "paths", "there", 1), ("motion", "steps", "then", 2), ("place", "inside", "into", 3), ("place", "inside", "thin", 4), ("motion", "steps", "there", 5)]


@query("lexicon_shelves", f"""WITH {TOK}, l0 AS (SELECT * FROM (VALUES {', '.join(str(s) for s in SHELVES)}) v(category, shelf, word, ord)), l AS (SELECT word, arg_min(category, ord) AS category, arg_min(shelf, ord) AS shelf FROM l0 GROUP BY word)
SELECT category, shelf, tok.word AS word, count(*) AS n FROM tok JOIN l USING (word) GROUP BY ROLLUP (category, shelf, tok.word)""")
def lexicon_shelves(spark: SparkSession, sf: str) -> DataFrame:
    return E.shelves(tok(spark, sf), spark.createDataFrame(SHELVES, "category string, shelf string, word string, ord int"))


@query("entity_card")
def entity_card(spark: SparkSession, sf: str) -> DataFrame:
    occ = occurrences(spark, sf)
    stats = E.entity_stats(occ, "lang", ["en", "fr"], "doc_id")
    name = E.network_core(stats, 1, 1).agg(F.min("word")).first()[0] or ""
    lines = T.line_table(documents(spark, sf), ["doc_id"]).where(F.contains(F.lower("line"), F.lit(name)))
    contexts = E.contexts(lines.select(F.lit(name).alias("word"), F.col("doc_id").alias("doc"), "line_no", "line"))
    return lookup.entity_card(stats, E.co_mention(occ, ["doc_id"], 2), contexts, name)
