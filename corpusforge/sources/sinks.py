"""Writers: JSON lines, staged tables, reports with control breaks, run logs, checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.operators.tokens import with_runs


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each statistic."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def control_break_lines(df: DataFrame, order: list[str], section: str, period: str, title: str, text: str) -> DataFrame:
    """key columns and ``line``: each text under its title, with a heading wherever section or period changes.

    Breaks are told inside a section, so sections stay independent tasks; sort by ``order`` when writing.
    """
    inner = [c for c in order if c != section]
    runs = with_runs(df, [section], inner, F.col(period))
    first = F.row_number().over(_first_in(section, inner)) == 1
    head = F.when(first, F.concat(F.lit("## "), F.coalesce(F.col(section), F.lit("")), F.lit("\n"))).otherwise("")
    sub = F.when(F.col("breaks") & F.col(period).isNotNull(), F.concat(F.lit("# "), F.col(period).cast("string"), F.lit("\n"))).otherwise("")
    return runs.select(*order, F.concat(head, sub, F.col(title), F.lit("\n"), F.col(text)).alias("line"))


def _first_in(section: str, order: list[str]):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(section).orderBy(*order)


def write_report(lines: DataFrame, order: list[str], path: str) -> None:
    """Text files whose order, file by file, is that of the rows."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def run_log(df: DataFrame, section: str, period: str, text_col: str = "text") -> DataFrame:
    """section, period, texts, chars, words, and their sums over periods and over all."""
    return df.rollup(section, period).agg(F.count("*").alias("texts"), F.sum(F.length(text_col)).alias("chars"), F.sum(F.size(X.tokens(text_col))).alias("words"))


def run_report(records: DataFrame, skipped: DataFrame, duplicates: DataFrame, near_duplicates: DataFrame, text_col: str = "text") -> dict[str, object]:
    """What a run wrote, skipped and left out, as counts: by section and period (small tables), in all, with the
    records' characters, words and replacement characters."""
    one = records.agg(F.count("*").alias("written_total"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.size(F.filter(F.split(text_col, r"\s+"), lambda w: w != ""))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length(text_col) - F.length(F.replace(text_col, F.lit("\ufffd"), F.lit("")))), F.lit(0)).alias("replacement_chars")).first()
    by = {name: {r[0]: r[1] for r in records.where(F.col(column).isNotNull()).groupBy(column).count().collect()} for name, column in (("written_by_section", "section"), ("by_period", "period")) if column in records.columns}
    return one.asDict() | by | {"skipped": skipped.count(), "duplicates": duplicates.count(), "near_duplicates": near_duplicates.count()}


def write_run_log(report: dict[str, object], lists: dict[str, DataFrame], folder: str) -> None:
    """The report as one JSON file, and each list (skipped, duplicates, ...) as JSON lines beside it."""
    spark = next(iter(lists.values())).sparkSession
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    for name, df in lists.items():
        write_jsonl(df, f"{folder}/{name}")


def compact_index(index: DataFrame, key: str = "word", display: str = "display") -> DataFrame:
    """Display forms that equal their key become null."""
    return index.withColumn(display, F.when(F.col(display) != F.col(key), F.col(display)))


def embed_json(template: str, marker: str, value: object) -> str:
    """A template with its marker, which must occur once, replaced by JSON that is safe inside a script element."""
    if template.count(marker) != 1:
        raise ValueError(f"{marker!r} occurs {template.count(marker)} times")
    return template.replace(marker, json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/"))


def check_counts(df: DataFrame, expected: dict[str, int]) -> None:
    """Fails if a condition (SQL) doesn't hold for exactly so many rows."""
    found = df.agg(*[F.count_if(F.expr(c)).alias(str(i)) for i, c in enumerate(expected)]).first()
    wrong = {c: found[i] for i, (c, n) in enumerate(expected.items()) if found[i] != n}
    if wrong:
        raise ValueError(f"counts differ: {wrong}")
