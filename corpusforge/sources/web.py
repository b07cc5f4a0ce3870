"""Pages and other files as tables. Fetching is a caller's matter; what is fetched is told here."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions import text as X

DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("section", T.StringType()), ("title", T.StringType()), ("text", T.StringType()), ("pagination", T.BooleanType()), ("period", T.StringType()), ("section_title", T.StringType()))])


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """ord, url of every <loc> of sitemap texts."""
    return sitemaps.select(F.posexplode(F.regexp_extract_all(xml_col, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("ord", "url")).withColumn("url", X.unescape("url"))


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, link of every anchor."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))).alias("link"))


def uncached(pages: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose address (md5, as cache_key) isn't in the cache table yet."""
    return pages.withColumn("cache_key", F.md5(url_col)).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def fetched(urls: DataFrame, fetch: Callable[[str], bytes | None], partitions: int = 4) -> DataFrame:
    """cache_key, url, body of every address by a caller's ``fetch``, at most ``partitions`` at a time."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"cache_key": part["cache_key"], "url": part["url"], "body": [fetch(u) for u in part["url"]]})

    return urls.select(F.md5("url").alias("cache_key"), "url").repartition(partitions, "url").mapInPandas(run, "cache_key string, url string, body binary")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as UTF-8, or as Windows-1251 where that leaves fewer replacement characters. Python, since the SQL
    function fails on malformed bytes instead of replacing them."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        utf, cyr = bytes(data).decode("utf-8", "replace"), bytes(data).decode("cp1251", "replace")
        return cyr if utf.count("�") > cyr.count("�") else utf

    return raw.map(one)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", article: str = "article", heading: str = "h1", content_class: str | None = None, dropped: tuple[str, ...] = ("nav", "meta"), listing: float = 0.6, bare: bool = True) -> DataFrame:
    """id, title, text, pagination, reason (why a page is to be skipped; null if it isn't) of every page.

    A page's text is that of the first ``article`` element with its own ``heading``: of its block with the class
    ``content_class`` (up to the article's last closing div) if one is named, else of what stands around the heading;
    elements ``dropped`` go. A page whose links hold more than ``listing`` of the text is a listing. Without ``bare``,
    character references need their semicolon.
    """
    element = rf"(?is)<{article}\b[^>]*>.*?</{article}\s*>"
    titled = rf"(?is)<{heading}\b[^>]*>.*?</{heading}\s*>"
    found = F.filter(F.regexp_extract_all(html_col, F.lit(element), F.lit(0)), lambda x: x.rlike(titled))
    one = pages.select(id_col, F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("_article"))
    block = F.regexp_extract("_article", rf"(?is)<div\b[^>]*\bclass\s*=\s*[\"']?[^\"'>]*\b{content_class}\b[^>]*>(.*)</div\s*>", 1) if content_class else F.regexp_replace("_article", titled, "")
    gone = "|".join(dropped)
    kept = F.regexp_replace(F.regexp_replace(block, rf"(?is)<({gone})\b.*?</\1\s*>", ""), rf"(?is)<({gone})\b[^>]*>", "")
    cut = one.select(id_col, X.tag_text("_article", heading, bare).alias("title"), kept.alias("_content"), F.col("_article").rlike(r"(?i)rel=\"?next|class=\"?pagination").alias("pagination"))
    out = cut.select(id_col, "title", X.html_to_text("_content", bare).alias("text"), "pagination", X.link_share("_content").alias("_share"))
    reason = F.when(F.col("title") == "", "no article with a heading").when(F.col("_share") > listing, "listing").when(F.col("text") == "", "no text")
    return out.withColumn("reason", reason).drop("_share")


def read_pages(raw: DataFrame, id_col: str = "page_id", body_col: str = "body", **how: object) -> DataFrame:
    """``extracted`` of pages as bytes, decoded with repair."""
    return extracted(raw.select(id_col, decoded(body_col).alias("html")), id_col, "html", **how)  # type: ignore[arg-type]


def jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole files, each one JSON value."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def xml_corpus(spark: SparkSession, path: str, row_tag: str = "item", schema: str = "author string, text string, date_from string") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def colour_marks(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """pid, line, hue, src, basis, conf of marks kept as {pid: {line: [hue, src, basis, conf]}}."""
    outer = rows.select(F.explode(F.from_json(json_col, "map<string, map<string, array<string>>>")).alias("pid", "lines"))
    flat = outer.select("pid", F.explode("lines").alias("line", "m"))
    return flat.select("pid", F.col("line").cast("int").alias("line"), *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(("hue", "src", "basis"))], F.get("m", F.lit(3)).cast("int").alias("conf"))


def accented_lines(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """pid, line_no, line of {pid: [line, ...]}."""
    outer = rows.select(F.explode(F.from_json(json_col, "map<string, array<string>>")).alias("pid", "l"))
    return outer.select("pid", F.posexplode("l").alias("line_no", "line"))


def with_stress(tokens: DataFrame, dictionary: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """``stressed``: the dictionary's form (form, stressed) of each word; unknown ones by ``model``, each form once, or null."""
    forms = tokens.select(F.lower("word").alias("form")).distinct()
    known = forms.join(dictionary.groupBy("form").agg(F.min("stressed").alias("stressed")), "form", "left")
    if model is not None:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield part.assign(stressed=[s if isinstance(s, str) else model(f) for f, s in zip(part["form"], part["stressed"], strict=True)])

        known = known.mapInPandas(run, "form string, stressed string")
    return tokens.join(known, F.lower("word") == F.col("form"), "left").drop("form")


def zip_aligned(raw: DataFrame, accented: DataFrame, key: str = "pid") -> DataFrame:
    """Raw and accented lines side by side, of the texts that have as many of both."""
    counts = raw.groupBy(key).agg(F.count("*").alias("n")).join(accented.groupBy(key).agg(F.count("*").alias("m")), key).where("n = m").select(key)
    return raw.join(accented.withColumnRenamed("line", "accented"), [key, "line_no"]).join(counts, key, "left_semi")


def map_elements(rows: DataFrame, tags: dict[str, str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Elements whose tags match all the patterns, inside a box (south, west, north, east)."""
    from corpusforge.operators.geo import in_box, tag_is

    out = rows
    for key, pattern in tags.items():
        out = out.where(tag_is(key, pattern))
    return out.where(in_box(*box)) if box else out


def free_images(hits: DataFrame, least_width: int = 1000) -> DataFrame:
    """Image search hits that may be used: free licence, JPEG or PNG, wide enough, each title once."""
    ok = hits.where(X.is_free_licence("licence") & F.col("mime").isin("image/jpeg", "image/png") & (F.col("width") >= least_width))
    return ok.withColumn("author", X.author_name("author")).dropDuplicates(["title"])
