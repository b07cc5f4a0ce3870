"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe_tree, dart_minhash, decontaminate, gif_media, langid, line_dedup, quality, secret_scan, token_counts, toxicity
from corpusforge.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document by the model of the labelled rows outside the held-out fold; null and empty texts get the lowest."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go (and for a line that isn't the same), and the digest of what stays; a null text is the empty one."""
    docs = table(spark, sf_dir, "documents")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", lines.alias("n_lines")))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("lines_gone").cast("long").alias("n_gone"), F.col("lines_near").cast("long").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored GIF and what is read back of it; a null text is the empty one."""
    return gif_media.payload_media(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every text, with linked weak ones; a null text has none."""
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text; a null text has none."""
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document; texts without words are one class."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "keeps")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the decoded bytes; a null text is the empty one."""
    return bpe_tree.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact windows and, as a further column n_near, proximity matches."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; null pages and addresses leave it to the other evidence."""
    return langid.identify(table(spark, sf_dir, "pages"), langid.learn(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document by the model of the labelled rows outside the held-out fold; a null text is the empty one."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_gif_media": op3_gif_media,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_counts": op5_token_counts,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
}

# DuckDB SQL -----------------------------------------------------------------------

#: Lines that aren't blank, the first place of each, and for those of five words or more the keys of their
#: neighbourhoods: the words left when one goes with its place, and all words with each place for one more.
_OP2 = """WITH l0 AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents), l1 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM l0),
l2 AS (SELECT * FROM (SELECT *, string_split(line, ' ') AS w FROM l1) WHERE trim(line) <> ''),
f AS (SELECT line, any_value(w) AS w, min((doc_id, line_no)) AS first FROM l2 GROUP BY line),
k AS (SELECT line, first, unnest(list_concat(list_transform(range(len(w)), lambda i: hash(list_concat(w[:i], w[i + 2:]), i)), list_transform(range(len(w) + 1), lambda i: hash(w, i)))) AS key FROM f WHERE len(w) >= 5),
g AS (SELECT key, min(first) AS lead FROM k GROUP BY key HAVING count(*) > 1), near AS (SELECT DISTINCT line FROM k JOIN g USING (key) WHERE lead < first),
gone AS (SELECT l2.doc_id, l2.line_no, near.line IS NOT NULL AS near FROM l2 JOIN f ON l2.line = f.line LEFT JOIN near ON l2.line = near.line WHERE near.line IS NOT NULL OR (l2.doc_id, l2.line_no) <> f.first),
kept AS (SELECT l1.doc_id, array_to_string(coalesce(list(l1.line ORDER BY l1.line_no) FILTER (WHERE gone.line_no IS NULL), []), chr(10)) AS t, count(*) AS n_lines, count(gone.line_no) AS n_gone, count_if(coalesce(near, FALSE)) AS n_near
FROM l1 LEFT JOIN gone ON l1.doc_id = gone.doc_id AND l1.line_no = gone.line_no GROUP BY l1.doc_id)
SELECT doc_id, n_lines, n_gone, n_near, sha256(t) AS kept_sha256 FROM kept"""

#: Exact weighted similarity of the shingles of five words in a row with their counts, and the components of what is
#: at 0.8 or more.
_OP6 = r"""WITH RECURSIVE w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), n AS (SELECT w, min(doc_id) AS id, count(*) AS copies FROM w0 GROUP BY w),
s AS (SELECT id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h, greatest(len(w) - 4, 1) AS n FROM n WHERE len(w) > 0), e AS (SELECT id, n, h, count(*) AS c FROM s GROUP BY ALL),
c AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, sum(least(x.c, y.c)) AS i FROM e x JOIN e y ON x.h = y.h AND x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM c WHERE i >= 0.8 * (na + nb - i) UNION SELECT b, a FROM c WHERE i >= 0.8 * (na + nb - i)),
reach AS (SELECT id AS node, id AS seen FROM n UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a), label AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node),
sizes AS (SELECT class_id, sum(copies)::BIGINT AS class_rows FROM label JOIN n ON node = id GROUP BY class_id)
SELECT doc_id, class_id, class_rows, doc_id = class_id AS keeps FROM w0 JOIN n USING (w) JOIN label ON node = id JOIN sizes USING (class_id)"""

_OP8 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: w[i + 1:i + 10])) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw), dw AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS p0, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, p0, bw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w[p0 + 1:p0 + dw.n] = bw.g),
inside AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY doc_id), which AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id),
dt AS (SELECT doc_id, p, w[p + 1:p + 3] AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS p FROM d)), wt AS (SELECT DISTINCT g, o, g[o + 1:o + 3] AS t FROM bw, (SELECT unnest([0, 3, 6]) AS o) WHERE n = 10),
met AS (SELECT DISTINCT doc_id, p - o AS p0, g FROM dt JOIN wt USING (t) WHERE p >= o),
near AS (SELECT DISTINCT doc_id, p0 FROM met JOIN d USING (doc_id) WHERE len(list_filter(range(1, 11), lambda i: coalesce(w[p0 + i] = g[i], FALSE))) BETWEEN 8 AND 9),
nears AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, p0 FROM near EXCEPT SELECT doc_id, p0 FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN inside ON d.doc_id = inside.doc_id LEFT JOIN which ON d.doc_id = which.doc_id LEFT JOIN nears ON d.doc_id = nears.doc_id"""

#: For the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": _OP2, "op6_dart_minhash": _OP6, "op8_decontaminate": _OP8}
