"""Queries on the star schema, events and conversations: series, periods, ranks, reports, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators import docs as D
from corpusforge.operators import stats as S
from corpusforge.operators import tokens as T
from corpusforge.plans import lookup
from corpusforge.plans.catalog import load, query
from corpusforge.plans.q_text import rounded


@query("yearly_zero_filled", "WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT x::INT AS y, coalesce(n, 0) AS n FROM range(1988, 2003) t(x) LEFT JOIN c ON c.y = x")
def yearly_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return S.zero_filled(load(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")), "y", 1988, 2002)


@query("smoothed_shares", """WITH c AS (SELECT year(o_orderdate)::INT AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT * FROM (VALUES (-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) v(d, weight)), b AS (SELECT min(y) AS lo, max(y) AS hi FROM c),
s AS (SELECT y + d AS y, p, sum(n * weight) / sum(weight) AS v FROM c, w, b WHERE y + d BETWEEN lo AND hi GROUP BY 1, 2) SELECT y, p, round(v / sum(v) OVER (PARTITION BY y), 6) AS share FROM s""")
def smoothed_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return rounded(S.smoothed_shares(c, "y", "p"), "share")


@query("multi_key_topk", "SELECT c_custkey, n, total FROM (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ORDER BY n DESC, total DESC, c_custkey LIMIT 25")
def multi_key_topk(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return lookup.ranking(o, ["n", "total"], 25, "c_custkey")


@query("menu_order", """WITH m AS (SELECT * FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(segment, ord)) SELECT c_custkey, coalesce(ord, 99) AS ord FROM customer LEFT JOIN m ON c_mktsegment = segment ORDER BY coalesce(ord, 99), c_mktsegment, c_custkey""")
def menu_order(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment string, ord int")
    return load(spark, sf, "customer").join(m, "c_mktsegment", "left").withColumn("ord", F.coalesce("ord", F.lit(99))).orderBy("ord", "c_mktsegment", "c_custkey").select("c_custkey", "ord")


@query("chronological_order", """WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 1995 END AS pe FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(y, pe, 9999), CASE WHEN y IS NOT NULL THEN 0 WHEN pe IS NOT NULL THEN 1 ELSE 2 END, o_orderkey) - 1 AS pid FROM k""")
def chronological_order(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.operators.stats import running_total

    o = load(spark, sf, "orders")
    y = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate"))
    pe = F.when(F.col("o_orderkey") % 14 != 0, F.lit(1995))
    keyed = o.select("o_orderkey", F.coalesce(y, pe, F.lit(9999)).alias("year"), F.when(y.isNotNull(), 0).when(pe.isNotNull(), 1).otherwise(2).alias("told"), F.lit(1).alias("one"))
    return running_total(keyed, [], ["year", "told", "o_orderkey"], "one", "pid").select("o_orderkey", "pid")


@query("control_break_report", """WITH j AS (SELECT r_name, n_name, c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY n_name, c_custkey) = 1 AS s, n_name IS DISTINCT FROM lag(n_name) OVER (PARTITION BY r_name ORDER BY n_name, c_custkey) AS b FROM j)
SELECT r_name, n_name, c_custkey, CASE WHEN s THEN '## ' || r_name || chr(10) ELSE '' END || CASE WHEN b OR s THEN '# ' || n_name || chr(10) ELSE '' END || c_custkey::VARCHAR || chr(10) || c_mktsegment AS line FROM f""")
def control_break_report(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.sources.sinks import control_break_lines

    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("title", F.col("c_custkey").cast("string"))
    return control_break_lines(j, ["r_name", "n_name", "c_custkey"], "r_name", "n_name", "title", "c_mktsegment")


@query("run_log", r"""SELECT lang, source, count(*) AS texts, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '\p{L}+(?:-\p{L}+)*')))::BIGINT AS words FROM documents GROUP BY ROLLUP (lang, source)""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    from corpusforge.sources.sinks import run_log as log

    return log(load(spark, sf, "documents"), "lang", "source")


@query("event_runs", """WITH b AS (SELECT user_id, event_type, row_number() OVER w AS k, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS br FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS events, sum(br::INT) AS runs FROM b GROUP BY user_id""")
def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = T.with_runs(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return r.groupBy("user_id").agg(F.count("*").alias("events"), F.max("run_no").alias("runs"))


@query("modal_event", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1")
def modal_event(spark: SparkSession, sf: str) -> DataFrame:
    return S.modal(load(spark, sf, "events"), ["user_id"], "event_type")


@query("evenly_spaced_orders", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS k FROM orders), t AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM r WHERE k < 12)
SELECT o_custkey, o_orderkey FROM t WHERE k IN (0, (n - 1) // 2, n - 1)""")
def evenly_spaced_orders(spark: SparkSession, sf: str) -> DataFrame:
    return S.evenly_spaced(load(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("interpolated_series", """WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT *, lead(y) OVER w AS y2, lead(n) OVER w AS n2 FROM y WINDOW w AS (PARTITION BY p ORDER BY y)), t AS (SELECT *, CASE WHEN y2 IS NULL THEN 0.0 ELSE (1995.25 - y) / (y2 - y) END AS t FROM x WHERE y <= 1995.25 AND (1995.25 < y2 OR y2 IS NULL))
SELECT p, round(n + (coalesce(n2, n) - n) * (3 * t * t - 2 * t * t * t), 6) AS at_value FROM t""")
def interpolated_series(spark: SparkSession, sf: str) -> DataFrame:
    y = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return rounded(S.interpolated(y, ["p"], "y", "n", F.lit(1995.25)), "at_value")


@query("set_operations", """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'customers' WHEN a.k IS NULL THEN 'suppliers' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("b").isNull(), "customers").when(F.col("a").isNull(), "suppliers").otherwise("both").alias("side"))


@query("ordered_distinct", "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("slug_ids", r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, md5(p_name) AS digest FROM part""")
def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", X.slug("p_name").alias("slug"), F.md5("p_name").alias("digest"))


@query("plural_forms", "SELECT p_partkey, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'штука' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'штуки' ELSE 'штук' END AS form FROM part")
def plural_forms(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", X.plural(F.col("p_size"), "штука", "штуки", "штук").alias("form"))


@query("punctuation_normalised", "SELECT doc_id, md5(replace(replace(replace(replace(text, '--', '—'), ' - ', ' — '), '…', '...'), ' – ', ' — ')) AS digest FROM documents")
def punctuation_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(X.normalised_punctuation("text", True)).alias("digest"))


@query("folded_skeletons", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) SELECT word, translate(word, '{X.LATIN.accents_from}', '{X.LATIN.accents_to}') AS folded, regexp_replace(word, '[{X.LATIN.vowels}]', '', 'g') AS skeleton, levenshtein(regexp_replace(translate(word, '{X.LATIN.accents_from}', '{X.LATIN.accents_to}'), '[^a-z]', '', 'g'), 'thing') AS distance FROM w WHERE word IS NOT NULL""")
def folded_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, "documents").select(F.explode(X.lower_tokens("text", r"\p{L}+")).alias("word")).distinct()
    return w.select("word", X.fold_accents("word").alias("folded"), X.consonants("word").alias("skeleton"), F.levenshtein(F.regexp_replace(X.fold_accents("word"), "[^a-z]", ""), F.lit("thing")).alias("distance"))


@query("event_properties", "SELECT event_id, len(json_keys(props)) AS keys FROM events")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.size(F.json_object_keys("props")).alias("keys"))


@query("map_projection", """SELECT s_suppkey, round(radians(s_acctbal / 100) * 6378137 * cos(radians(45.0)), 3) AS x, round(ln(tan(pi() / 4 + radians(s_suppkey % 60) / 2)) * 6378137 * cos(radians(45.0)), 3) AS y FROM supplier""")
def map_projection(spark: SparkSession, sf: str) -> DataFrame:
    m = X.mercator((F.col("s_suppkey") % 60).cast("double"), F.col("s_acctbal") / 100, 45.0)
    return load(spark, sf, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


LUM = "CASE WHEN {v} <= 0.03928 THEN {v} / 12.92 ELSE (({v} + 0.055) / 1.055) ** 2.4 END"


@query("colour_luminance", "WITH c AS (SELECT p_partkey, (p_partkey * 7919 % 256) / 255.0::DOUBLE AS r, (p_partkey * 104729 % 256) / 255.0::DOUBLE AS g, (p_partkey * 1299709 % 256) / 255.0::DOUBLE AS b FROM part) SELECT p_partkey, round(0.2126 * " + LUM.format(v="r") + " + 0.7152 * " + LUM.format(v="g") + " + 0.0722 * " + LUM.format(v="b") + ", 6) AS luminance FROM c")
def colour_luminance(spark: SparkSession, sf: str) -> DataFrame:
    def byte(m: int):  # noqa: ANN202
        return F.lpad(F.lower(F.hex(F.col("p_partkey") * m % 256)), 2, "0")

    colour = F.concat(F.lit("#"), byte(7919), byte(104729), byte(1299709))
    return rounded(load(spark, sf, "part").select("p_partkey", X.luminance(colour).alias("luminance")), "luminance")


@query("colour_marks_by_mode", """WITH m AS (SELECT year(ts) AS y, event_type AS hue, CASE user_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'o' ELSE 'm' END AS src FROM events), c AS (SELECT y, hue, count(*) AS n FROM m WHERE src IN ('n', 'o') GROUP BY ALL) SELECT y, hue, n, round(100.0 * n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c""")
def colour_marks_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    src = F.when(F.col("user_id") % 3 == 0, "n").when(F.col("user_id") % 3 == 1, "o").otherwise("m")
    m = load(spark, sf, "events").select(F.year("ts").alias("y"), F.col("event_type").alias("hue"), src.alias("src"))
    return rounded(lookup.colour_counts(m, "objects", "y"), "share")


@query("weighted_against_baseline", """WITH o AS (SELECT n_regionkey AS k, count(*) AS n, avg((c_acctbal > 0)::INT) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_regionkey AS k, avg((s_acctbal > 0)::INT) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT round(sum(o.s * n) / sum(n), 6) AS observed, round(sum(b.s * n) / sum(n), 6) AS baseline, round((sum(o.s * n) / sum(n)) / (sum(b.s * n) / sum(n)), 6) AS ratio FROM o JOIN b USING (k)""")
def weighted_against_baseline(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    o = load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("share"))
    b = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.avg((F.col("s_acctbal") > 0).cast("int")).alias("share"))
    return rounded(lookup.against_baseline(o, b, "k"), "observed", "baseline", "ratio")


@query("dated_rows", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END, CASE WHEN o_orderkey % 10 = 0 THEN 1996 END, CASE WHEN o_orderkey % 15 <> 0 THEN 1994 END) AS year_used, o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 AS approximate FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0 OR o_orderkey % 15 <> 0""")
def dated_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    year, manual, mid = F.when(k % 5 != 0, F.year("o_orderdate")), F.when(k % 10 == 0, F.lit(1996)), F.when(k % 15 != 0, F.lit(1994))
    return D.dated(load(spark, sf, "orders"), year, manual, mid).select("o_orderkey", "year_used", "approximate")


@query("undecided_customers", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def undecided_customers(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = load(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return D.undecided(load(spark, sf, "customer").where("c_acctbal > 9000"), verdicts, "c_custkey").select("c_custkey")


@query("period_share_table", "WITH c AS (SELECT year(o_orderdate) AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT y, s, n, round(100.0 * n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c")
def period_share_table(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s"))
    return rounded(lookup.share_table(o, "y", "s"), "share")
