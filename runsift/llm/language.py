"""Language of web pages: text likelihood, declared language, address suffix and host prior in one posterior.

1. Word counts per language come from texts of known language by grouped aggregation; words are hashed to ``BINS`` bins.
2. A page's text alone gives a first posterior. Its sums per declared code, suffix, registered domain and host are
   soft counts, combined before the exchange, so a host with a third of all pages is one row per task.
3. P(declared | language) and P(suffix | language) are smoothed shares of these counts. The prior of a host is smoothed
   towards its domain's, that towards the whole table's; a page's own share is taken out before.
4. The posterior adds the logs. A missing declaration or address adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm import words as W
from runsift.llm.storage import store

BITS = 14
BINS = 1 << BITS
MAX_LANGUAGES = 512  # more distinct codes in the training texts are an error, not a cut
TEXT_WORDS = 60  # a text counts like at most so many words
SMOOTH = 5.0


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities."""
    hidden = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(hidden, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def declared(html: Column) -> Column:
    code = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})\b""", 1))
    return F.when(code != "", code)


def host(url: Column) -> Column:
    name = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name)


def _counter(column: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1 - column).to_pylist()
            for chunk in W.chunks(batch.column(column)):
                found = W.words(chunk, W.ALNUM)
                bins = (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
                for r in range(chunk.rows):
                    own = bins[found.rows[r]:found.rows[r + 1]]
                    total = totals.setdefault(langs[chunk.first + r], np.zeros(BINS, np.int64))
                    np.add.at(total, own, 1)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bin", "n"])
    return run


def word_model(texts: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and smoothed log probabilities of the word bins; rows without a language are left out."""
    rows = texts.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    counts = rows.mapInArrow(_counter(1), "lang string, bin long, n long").groupBy("lang", "bin").agg(
        F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(names), BINS), 0.5)
    for r in counts.toLocalIterator():  # at most languages times bins
        table[names.index(r["lang"]), r["bin"]] += r["n"]
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def _likelihood(shared, text: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(table)))
            for chunk in W.chunks(batch.column(text)):
                found = W.words(chunk, W.ALNUM)
                rows, bins = W.row_of(found), (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
                scale = np.minimum(1.0, TEXT_WORDS / np.maximum(np.diff(found.rows), 1))
                for k in range(len(table)):
                    own = np.bincount(rows, table[k][bins], minlength=chunk.rows) if len(rows) else np.zeros(chunk.rows)
                    out[chunk.first:chunk.first + chunk.rows, k] = own * scale
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * len(table), pa.int32()), pa.array(out.ravel()))
            keep = [i for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], lists], [*[batch.schema.names[i] for i in keep], "text_log"])
    return run


def _normal(logs: Column) -> Column:
    """Posterior from an array of logs."""
    likely = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(likely, lambda v: v / F.aggregate(likely, F.lit(0.0), lambda a, x: a + x))


def _soft_counts(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Sums of the text posterior per key, as an array ``c_<last key>``."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get("first", F.lit(k))).alias(f"s{k}") for k in range(n)])
    return sums.select(*keys, F.array(*[F.col(f"s{k}") for k in range(n)]).alias(f"c_{keys[-1] if keys else 'all'}"))


def _add(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def identify(pages: DataFrame, texts: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
             text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per page: ``key``, ``host``, ``declared_lang``, ``text_lang``, ``lang`` and its ``posterior``.

    Null and empty pages are judged by their address and host alone, and a page with nothing known by the table's
    prior; ties go to the first language by name. Without training texts ``lang`` is null. Other columns are ignored.
    """
    spark = pages.sparkSession
    names, table = word_model(texts, text, lang)
    facts = pages.select(
        F.col(key).alias("id"), host(F.col(url)).alias("host"), declared(F.col(html)).alias("declared"),
        visible(F.coalesce(F.col(html), F.lit(""))).alias("__text"))
    facts = facts.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))
    facts = facts.withColumn("domain", F.substring_index("host", ".", -2)).select(
        "id", "host", "domain", "suffix", "declared", "__text")
    if not names:
        return facts.select(F.col("id").alias(key), "host", F.col("declared").alias("declared_lang"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("posterior"))
    n = len(names)
    shared = spark.sparkContext.broadcast(table)
    schema = facts.drop("__text").withColumn("text_log", F.expr("cast(null as array<double>)")).schema
    rows = store(facts.mapInArrow(_likelihood(shared, 5), schema).withColumn("first", _normal(F.col("text_log"))))

    whole = [v or 0.0 for v in _soft_counts(rows, n).first()["c_all"]]
    total = sum(whole)
    base = F.array(*[F.lit((v + 1.0) / (total + n)) for v in whole])
    out = rows
    for name in ("declared", "suffix", "domain", "host"):
        counts = store(_soft_counts(rows.where(F.col(name).isNotNull()), n, name))
        out = out.join(counts, name, "left")

    def others(counts: Column) -> Column:
        """Counts without the page's own share; zeros where the key is missing."""
        return F.coalesce(F.zip_with(counts, "first", lambda c, q: F.greatest(c - q, F.lit(0.0))),
                          F.array_repeat(F.lit(0.0), n))

    def smoothed(counts: Column, towards: Column) -> Column:
        own = others(counts)
        return F.zip_with(own, towards, lambda c, p: (c + SMOOTH * p) / (_add(own) + SMOOTH))

    all_counts = F.array(*[F.lit(float(v)) for v in whole])

    def given_language(counts: Column) -> Column:
        """log P(value | language), smoothed towards the value's share of all pages; zeros if there is no value."""
        own = others(counts)
        share = _add(own) / F.lit(max(total, 1.0))
        logs = F.zip_with(own, all_counts, lambda c, w: F.log((c + SMOOTH * share + 1e-9) / (w + SMOOTH)))
        return F.when(counts.isNotNull(), logs).otherwise(F.array_repeat(F.lit(0.0), n))

    out = (out.withColumn("p_domain", smoothed(F.col("c_domain"), base))
           .withColumn("p_host", smoothed(F.col("c_host"), F.col("p_domain")))
           .withColumn("e_declared", given_language(F.col("c_declared")))
           .withColumn("e_suffix", given_language(F.col("c_suffix"))))
    logs = F.zip_with(
        F.zip_with("text_log", "e_declared", lambda a, b: a + b),
        F.zip_with("e_suffix", "p_host", lambda a, b: a + F.log(b)), lambda a, b: a + b)
    out = out.withColumn("all_logs", logs).withColumn("posterior", _normal(F.col("all_logs")))
    known = F.array(*[F.lit(v) for v in names])

    def best(values: Column) -> Column:
        return F.get(known, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    return out.select(
        F.col("id").alias(key), "host", F.col("declared").alias("declared_lang"),
        best(F.col("first")).alias("text_lang"), best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("posterior"))
