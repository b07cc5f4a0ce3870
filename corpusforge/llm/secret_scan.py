"""Secrets in texts, with credentials made of several parts linked by an interval join; DataFrame functions only.

Strong spans stand by themselves: ``assign`` (a name such as password or token with a value of 8 or more
characters), ``access`` (an access key id of 16 or more) and ``hex`` (32 or more lower-case hex digits). Weak
spans are reported only with their complement in reach, within the same text:

* ``login`` (an account name or client id that is assigned) with a secret: assign, hex or blob;
* ``blob`` (a 40-character base64 run that is no hex and holds both cases and a digit) with an identifier: access or login;
* ``url`` (an endpoint) with both an identifier and a secret.

Spans become rows, so their offsets are running sums and the interval join is a range frame over the spans of
one text: linear in their number, and no text is shuffled, only spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import only

#: Patterns of the kinds, in the order of their report (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOGIN = r"""(?i:user_?name|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
URL = r"https?://[A-Za-z0-9.-]+[A-Za-z0-9/?&=_.:%-]*"
#: What any text with an assigned value holds: a cheap test before the full pattern.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
KINDS = ("assign", "access", "hex", "login", "blob", "url")
#: Code points between the starts of two parts that belong together, at most.
REACH = 300


def _found(text: Column, kind: str, pattern: str, when: Column) -> Column:
    """A kind's matches in order, with the length of the text before each since the one before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.when(when, F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))).otherwise(F.lit(None))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), rows.alias("found"))


def secret_spans(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each reported span: id, text_hash, kind (index in KINDS), start, end (code points, end exclusive).

    Repeated rows (same id and text) give their spans once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, id_col, text_col).toDF("id", "text")
    hinted = rows.select(
        "id",
        text.alias("text"),
        text.rlike(ASSIGN_HINT).alias("a"),
        text.contains("AKIA").alias("k"),
        text.rlike(HEX).alias("h"),
        text.rlike(LOGIN).alias("l"),
    ).where("a or k or h or l")
    some_id = F.col("k") | F.col("l")
    t = F.col("text")
    kinds = [("assign", ASSIGN, F.col("a")), ("access", ACCESS, F.col("k")), ("hex", HEX, F.col("h")), ("login", LOGIN, F.col("l")), ("blob", BLOB, some_id), ("url", URL, some_id)]
    found = hinted.select("id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(*[_found(t, *k) for k in kinds])).alias("one"))
    hits = found.select("id", "text_hash", F.col("one.kind").alias("kind"), F.posexplode("one.found").alias("n", "m"))
    hits = hits.select("id", "text_hash", "kind", "n", F.col("m.gap").alias("gap"), F.col("m.hit").alias("hit")).dropDuplicates(["id", "text_hash", "kind", "n"])
    until = Window.partitionBy("id", "text_hash", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(until))
    value = F.length(F.regexp_extract("hit", ASSIGN, 2))
    mixed = F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]") & F.col("hit").rlike("[0-9]")
    kept = placed.where(F.when(F.col("kind") == 0, value >= 8).when(F.col("kind") == 4, mixed).otherwise(F.lit(True)))
    spans = kept.select("id", "text_hash", "kind", (F.col("end") - F.length("hit")).alias("start"), "end")
    near = Window.partitionBy("id", "text_hash").orderBy("start").rangeBetween(-reach, reach)
    with_id = F.max(F.col("kind").isin(1, 3)).over(near)
    with_secret = F.max(F.col("kind").isin(0, 2, 4)).over(near)
    linked = spans.withColumn("ok", F.when(F.col("kind") <= 2, F.lit(True)).when(F.col("kind") == 3, with_secret).when(F.col("kind") == 4, with_id).otherwise(with_id & with_secret))
    return linked.where("ok").drop("ok")


def secret_scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_linked (weak spans reported) of every row.

    A null or empty text has no spans (the digest is that of no bytes); a very long one is scanned whole; null ids are
    kept and matched as such; repeated rows give repeated results; spans that start together stand in the kinds'
    order; other columns are ignored; an empty table gives an empty one.
    """
    spans = secret_spans(docs, reach, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per_text = spans.groupBy("id", "text_hash").agg(listed.alias("s"), *[F.count_if(F.col("kind") == i).alias(f"n{i}") for i in range(3)])

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = joined(F.filter("s", lambda x: x["kind"] <= 2))
    out = per_text.select("id", "text_hash", "n0", "n1", "n2", F.sha2(base, 256).alias("sha"), joined(F.col("s")).alias("joined"), (F.size("s") - F.col("n0") - F.col("n1") - F.col("n2")).alias("weak"))
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row_hash"))
    matched = rows.join(out, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    zero = F.lit(0).cast("long")
    return matched.select(
        F.col("row_id").alias(id_col),
        *[F.coalesce(F.col(f"n{i}"), zero).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("joined", F.lit("")).alias("spans"),
        F.coalesce(F.col("weak").cast("long"), zero).alias("n_linked"),
    )
