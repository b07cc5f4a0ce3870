"""Tables of tokens, lines, stanzas, blocks and sentences with their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text as X


def token_table(docs: DataFrame, keys: list[str], text_col: str = "text", lower: bool = True) -> DataFrame:
    """keys, pos (from 0), word."""
    words = X.lower_tokens(text_col) if lower else X.tokens(text_col)
    return docs.select(*keys, F.posexplode(words).alias("pos", "word"))


def line_table(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, line_no (from 0), line; all lines, empty ones too."""
    return docs.select(*keys, F.posexplode(X.lines(text_col)).alias("line_no", "line"))


def sentence_table(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, sentence_no, sentence, n_words; sentences without words are left out."""
    cut = docs.select(*keys, F.posexplode(X.sentences(text_col)).alias("sentence_no", "sentence"))
    return cut.withColumn("n_words", F.size(X.tokens("sentence"))).where("n_words > 0")


def with_stanzas(lines: DataFrame, doc_keys: list[str]) -> DataFrame:
    """Lines that aren't blank, with stanza_no from 0: blank runs part stanzas, those at the ends count for nothing."""
    order = Window.partitionBy(*doc_keys).orderBy("line_no")
    blank = F.trim("line") == ""
    starts = ~blank & F.coalesce(F.lag(blank).over(order), F.lit(True))
    return lines.withColumn("stanza_no", F.sum(starts.cast("int")).over(order) - 1).where(~blank)


def with_blocks(stanza_lines: DataFrame, doc_keys: list[str], size: int = 12) -> DataFrame:
    """block_no: stanzas, of which long ones are cut every ``size`` lines."""
    in_stanza = F.row_number().over(Window.partitionBy(*doc_keys, "stanza_no").orderBy("line_no")) - 1
    part = F.floor(in_stanza / size)
    starts = (F.pmod(in_stanza, F.lit(size)) == 0).cast("int")
    return stanza_lines.withColumn("_part", part).withColumn("block_no", F.sum(starts).over(Window.partitionBy(*doc_keys).orderBy("line_no")) - 1).drop("_part")


def with_sentence_start(stanza_lines: DataFrame, doc_keys: list[str], capitalised: float = 0.8) -> DataFrame:
    """starts_sentence: the line before ends one, or there is none; only where lines aren't all written with a capital
    (a share of ``capitalised`` or more), since then a capital tells nothing, as caps_convention says."""
    order = Window.partitionBy(*doc_keys).orderBy("line_no")
    ended = F.lag(F.rtrim("line")).over(order).rlike(r"[.!?…][»\"')]*$")
    caps = F.avg(F.col("line").rlike(r"^\s*\p{Lu}").cast("int")).over(Window.partitionBy(*doc_keys))
    return stanza_lines.withColumns({"starts_sentence": F.coalesce(ended, F.lit(True)), "caps_convention": caps >= capitalised})


def with_neighbours(tokens: DataFrame, part_keys: list[str], word: str = "word") -> DataFrame:
    """previous and following word of each token."""
    order = Window.partitionBy(*part_keys).orderBy("pos")
    return tokens.withColumns({"previous": F.lag(word).over(order), "following": F.lead(word).over(order)})


def with_runs(rows: DataFrame, part_keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Control breaks: breaks (the value isn't the last row's) and run_no, counted in each part."""
    w = Window.partitionBy(*part_keys).orderBy(*order)
    breaks = ~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("breaks", breaks).withColumn("run_no", F.sum(F.col("breaks").cast("int")).over(w))
