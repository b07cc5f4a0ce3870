"""Language of web pages by Bayesian fusion of evidence.

log P(language | page) is, but for a constant, the sum of

* the visible text's likelihood under hashed letter trigrams, tempered, since neighbouring trigrams aren't independent;
* the declared markup language's likelihood, from counts of (declared, language) over all pages;
* the address suffix's likelihood, counted likewise;
* the host's prior, smoothed towards its domain's, which is smoothed towards the whole table's.

The counts are sums of the pages' text posteriors by grouped aggregation over all pages; a page's own share is
taken out of its host's and domain's counts before they judge it. The trigram model is fitted on a bounded sample
of rows whose language is known.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import by_chunks, only
from corpusforge.session import shared_folder

#: Buckets of hashed trigrams, pseudo-count of each, weight of one trigram's evidence, and its bound in all.
BUCKETS, PSEUDO, TEMPER, MOST_TRIGRAMS = 1 << 16, 0.1, 0.2, 40.0
#: Labelled rows to fit the trigrams on, about; all of them if there are fewer.
SAMPLE_ROWS = 8_000
#: Pages' worth of the domain's prior in a host's, and of the whole table's in a domain's.
HOST_STRENGTH, DOMAIN_STRENGTH = 5.0, 20.0
#: Pseudo-count of each value of an attribute in each language.
ATTRIBUTE_PSEUDO = 0.5

_DROPPED = re.compile(r"<!--.*?-->|<(script|style|noscript|nav|template)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def visible_text(page: str) -> str:
    """What a page shows, about: without scripts, styles, navigation, comments and tags."""
    return html_lib.unescape(_TAG.sub(" ", _DROPPED.sub(" ", page)))


def trigram_buckets(text: str) -> np.ndarray:
    """Hashed trigrams of lower-case letters and single spaces."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else _ASCII.sub(" ", text.lower())
    codes = np.frombuffer(f" {' '.join(letters.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 4:
        return np.zeros(0, np.int64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(48)).astype(np.int64)


_ASCII = re.compile(r"[^a-z]+")


@dataclass
class TrigramModel:
    languages: list[str]
    log_odds: np.ndarray  # buckets x languages

    def evidence(self, text: str) -> np.ndarray:
        """Tempered log likelihood of a text in each language, the highest 0; all 0 for a text without letters."""
        found = trigram_buckets(text)
        if not len(found):
            return np.zeros(len(self.languages))
        total = TEMPER * self.log_odds[found].mean(axis=0) * min(len(found), MOST_TRIGRAMS)
        return total - total.max()


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> TrigramModel:
    """Trigram likelihoods from about ``rows`` rows with a known language; one language ("und") if there are none."""
    known = labelled.select(F.lower(F.col(f"`{lang_col}`")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("lang is not null")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 20)) < int(rows / n * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in by_chunks(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    sums = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    found = np.unique(trigram_buckets(text), return_counts=True)
                    sums[found[0]] += found[1]
        for lang, sums in counts.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], names=["lang", "bucket", "n"])

    summed = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    languages = sorted(summed["lang"].unique()) or ["und"]
    counts = np.full((BUCKETS, len(languages)), PSEUDO)
    counts[summed["bucket"], [languages.index(x) for x in summed["lang"]]] += summed["n"]
    return TrigramModel(languages, np.log(counts / counts.sum(axis=0)))


def _posterior(evidence: Column) -> Column:
    """The probabilities that log evidence stands for."""
    raised = F.transform(evidence, lambda x: F.exp(x - F.array_max(evidence)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def page_evidence(pages: DataFrame, model: TrigramModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, host, domain, suffix, declared and the text's log evidence of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    source = only(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    kind = source.schema[0].dataType.simpleString()
    rows = source.select("id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1)).alias("declared"), F.col("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_chunks(batch, 3):
                made = [shared.value.evidence(visible_text(t)).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(made, pa.list_(pa.float64()))], names=["id", "host", "declared", "text"])

    out = rows.mapInArrow(run, f"id {kind}, host string, declared string, text array<double>")
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).otherwise(F.col("host"))
    return out.select("id", "host", domain.alias("domain"), F.element_at(labels, -1).alias("suffix"), "declared", "text")


def identify(pages: DataFrame, model: TrigramModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, lang, confidence, text_lang, declared, host and posterior (a probability for each of the model's languages) of every page.

    Without readable text, a declaration or a host (null or empty html and url) the other evidence decides; ties
    go to the first language in order. Null ids are kept; repeated rows each count and give equal results; other
    columns are ignored.
    """
    shared_folder(pages.sparkSession)
    languages = model.languages
    k = len(languages)
    seen = page_evidence(pages, model, id_col, url_col, html_col).withColumn("p", _posterior(F.col("text"))).checkpoint()  # one small row for each page; read five times

    def summed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(name))

    everywhere = seen.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
    total = [float(x) + 1.0 for x in everywhere]
    prior = F.array(*[F.lit(t / sum(total)) for t in total])

    def likelihood(counts: DataFrame, key: str, name: str) -> DataFrame:
        """log P(value | language) of an attribute's values; a missing value says nothing."""
        values = counts.count()
        logs = F.array(*[F.log((F.col("c")[i] + ATTRIBUTE_PSEUDO) / F.lit(total[i] + ATTRIBUTE_PSEUDO * (values + 1))) for i in range(k)])
        return counts.select(key, F.when(F.col(key) != "", logs).otherwise(F.array(*[F.lit(0.0)] * k)).alias(name))

    by_host = seen.groupBy("host", "domain", "suffix").agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias("host_n"))
    by_domain = by_host.groupBy("domain").agg(F.array(*[F.sum(F.col("host_n")[i]) for i in range(k)]).alias("domain_n"))
    by_suffix = likelihood(by_host.groupBy("suffix").agg(F.array(*[F.sum(F.col("host_n")[i]) for i in range(k)]).alias("c")), "suffix", "suffix_e")
    hosts = by_host.join(by_domain, "domain").join(by_suffix, "suffix").select("host", "host_n", "domain_n", "suffix_e").checkpoint()
    declared = likelihood(summed(seen, "declared", "c"), "declared", "declared_e").checkpoint()

    joined = seen.join(hosts, "host").join(declared, "declared")

    def share(counts: str, i: int) -> Column:
        """A count without the page's own part."""
        return F.greatest(F.col(counts)[i] - F.col("p")[i], F.lit(0.0))

    def of_all(counts: str) -> Column:
        return sum((share(counts, i) for i in range(k)), F.lit(0.0))

    domain_p = F.array(*[(share("domain_n", i) + DOMAIN_STRENGTH * prior[i]) / (of_all("domain_n") + DOMAIN_STRENGTH) for i in range(k)])
    smoothed = joined.withColumn("domain_p", F.when(F.col("host") != "", domain_p).otherwise(prior))
    host_p = F.array(*[(share("host_n", i) + HOST_STRENGTH * F.col("domain_p")[i]) / (of_all("host_n") + HOST_STRENGTH) for i in range(k)])
    with_prior = smoothed.withColumn("host_p", F.when(F.col("host") != "", host_p).otherwise(prior))
    fused = with_prior.withColumn("posterior", _posterior(F.array(*[F.col("text")[i] + F.col("declared_e")[i] + F.col("suffix_e")[i] + F.log(F.col("host_p")[i]) for i in range(k)])))
    names = F.array(*[F.lit(x) for x in languages])

    def best(p: str) -> Column:
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    return fused.select(F.col("id").alias(id_col), best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"), best("p").alias("text_lang"), "declared", "host", "posterior")
