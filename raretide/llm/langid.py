"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a naive Bayes likelihood over hashed byte trigrams, counted over all rows by the language they declare;
* declared: P(declared tag | language), so that a tag counts as much as it has proved right;
* suffix: P(address suffix | language);
* host: a prior over languages, smoothed from all rows to the domain and from the domain to the host.

The three tables of the last kinds are grouped sums of each row's text posterior. Rows are then fused as
log prior(host) + text + log P(declared | l) + log P(suffix | l); evidence that a row lacks is left out.

A background class of even trigrams stands for every text unlike the known languages: where the text
is likelier under it than under each language, by more than its prior odds, neither tag nor host makes up for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretide.llm import kernels as K
from raretide.llm.workspace import Workspace

U = np.uint64
BITS = 13
#: Trigrams of a text that count as independent; the likelihood of a longer text is scaled down to that many.
EVIDENCE = 50.0
#: Pseudo-counts: of trigrams, of tags and suffixes, and of a parent's prior.
ALPHA, BETA, KAPPA = 0.5, 1.0, 5.0
#: Prior odds of the background class against a language of much text; nearer to 1 the more smoothing makes up its table.
BACKGROUND = 1e-6
LANGUAGE = r"^[a-z]{2,3}$"
#: All but letters of other scripts; letters a-z stay, the rest of ASCII is one separator.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and separators, and the first of each text. Runs of separators count once."""
    raw, offsets = K.buffers(text)
    x = FOLD[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    x = x[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    inside = (of[2:] == of[:-2]) & (x[1:-1] != 0x20)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return bucket[inside].astype(np.int64), np.searchsorted(of[:-2][inside], np.arange(len(offsets)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in K.pieces(batches, "text"):
        grams, first = trigrams(b.column("text"))
        declared = b.column("declared").to_pylist()
        langs = sorted(set(declared) - {None})
        place = {lang: i for i, lang in enumerate(langs)}
        of = np.repeat(np.array([place.get(d, -1) for d in declared], np.int64), np.diff(first))
        known = of >= 0
        counts = np.bincount(of[known] << BITS | grams[known], minlength=len(langs) << BITS).reshape(len(langs), 1 << BITS)
        for lang, n in zip(langs, counts, strict=True):
            total[lang] = total.get(lang, 0) + n
    for lang, n in total.items():
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n[found], pa.int64())], names=["lang", "gram", "n"])


def _likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value  # trigram x language, log P
        for b in K.pieces(batches, "text"):
            grams, first = trigrams(b.column("text"))
            n = np.diff(first)
            sums = np.zeros((len(n), table.shape[1]))
            full = np.flatnonzero(n)
            if len(full):
                sums[full] = np.add.reduceat(table[grams], first[:-1][full], axis=0, dtype=np.float64)
            sums *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            ends = np.arange(len(n) + 1, dtype=np.int32) * table.shape[1]
            rest = [c for c in b.schema.names if c != "text"]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1))) for x in (sums, _normal(sums))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n), *lists], names=[*rest, "n_grams", "text_log", "text_p"])

    return run


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities of rows of logarithms."""
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _total(weights: str) -> Column:
    """The sum of arrays of one length, as an aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array  # large modules, which workers have no use for
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(F.col(weights))))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Grouped sums of the posteriors: keys, s (array)."""
    return rows.groupBy(*keys).agg(_total("text_p").alias("s"))


def _smoothed(sums: Column, parent: Column) -> Column:
    """(s + kappa * parent) / (sum of s + kappa)."""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    # the total is worked out once, not for each language
    return F.get(F.transform(F.array(total), lambda t: F.zip_with(sums, parent, lambda s, p: (s + KAPPA * p) / (t + KAPPA))), F.lit(0))


def _fused(names: list[str], base: np.ndarray, odds: np.ndarray, least: float):
    """Posteriors of all evidence, the language they favour, and whether the row is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names)

        def rows(b: pa.RecordBatch, name: str, without: np.ndarray) -> np.ndarray:
            column = b.column(name)
            out = np.tile(without, (len(column), 1))
            out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            return out

        for b in batches:
            nothing, n = np.zeros(len(names)), b.column("n_grams").to_numpy()
            text = rows(b, "text_log", nothing)
            p = _normal(np.log(rows(b, "prior", base)) + text + rows(b, "declared_log", nothing) + rows(b, "suffix_log", nothing))
            sure = p.max(1, initial=0.0)
            like = (text + odds).max(1, initial=-np.inf) >= -np.minimum(n, EVIDENCE) * np.log(1 << BITS)
            of_text = pa.array(rows(b, "text_p", nothing).argmax(1), mask=n == 0)
            kept = (n > 0) & (sure >= least) & like
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), labels.take(pa.array(p.argmax(1))), pa.array(sure), labels.take(of_text), b.column("declared"), b.column("n_grams"), pa.array(kept)], names=["doc_id", "lang", "confidence", "text_lang", "declared", "n_grams", "kept"])

    return run


def identify(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, least: float = 0.5, languages: int | None = None) -> DataFrame:
    """One row per row: doc_id, lang, confidence, text_lang, declared, n_grams, kept.

    declared, suffix, host and domain (the host's parent; by default its last two labels) are expressions over the
    row; null or absent ones give no evidence. Tags are cut to their primary subtag of two or three letters; every tag is a
    language, which bounds them by 26 ** 2 + 26 ** 3 (``languages`` asks for the most frequent ones alone; rarer tags then
    count as evidence by the texts that carry them). A row carries two numbers for each language. kept: the posterior
    is at least ``least``, the text has a trigram at all, and some language is at least as likely for it
    as the background at its prior odds (a language of few texts, whose table is nearly even, has hardly any in its
    favour); an empty or null text, or one without letters, is not kept, and its language rests on the other
    evidence. A text unlike every language has the nearest one as lang and is not kept. Without
    any declared language lang is null and nothing is kept. Ties go to the alphabetically first language. Repeated
    rows are each judged alike; null identifiers are allowed; an empty table gives an empty result.
    """
    spark, none = rows.sparkSession, F.lit(None).cast("string")
    tag = F.lower(F.regexp_extract(F.coalesce(declared if declared is not None else none, F.lit("")).cast("string"), r"^\s*([A-Za-z]{2,3})(?:$|[-_\s])", 1))
    host = F.lower(host.cast("string")) if host is not None else none
    domain = F.lower(domain.cast("string")) if domain is not None else F.regexp_extract(F.coalesce(host, F.lit("")), r"([^.]+(?:\.[^.]+)?)$", 1)
    source = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(tag.rlike(LANGUAGE), tag).alias("declared"), (F.lower(suffix.cast("string")) if suffix is not None else none).alias("suffix"), host.alias("host"), F.when(F.length(domain) > 0, domain).alias("domain"))
    kind = source.schema["doc_id"].dataType.simpleString()
    with Workspace(spark, "langid") as work:
        frequent = source.filter("declared IS NOT NULL").groupBy("declared").count()
        if languages is not None:
            frequent = frequent.orderBy(F.desc("count"), "declared").limit(languages)
        names = sorted(r.declared for r in frequent.select("declared").collect())  # two or three letters each
        if not names:
            return source.select("doc_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
        tagged = source.select("text", F.when(F.col("declared").isin(names), F.col("declared")).alias("declared") if languages is not None else "declared")
        counted = tagged.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most languages * 2**BITS rows
        table = np.full((1 << BITS, len(names)), ALPHA)
        place = pa.compute.index_in(counted["lang"], pa.array(names)).to_numpy()
        table[counted["gram"].to_numpy(), place] += counted["n"].to_numpy()
        shared = spark.sparkContext.broadcast(np.log(table / table.sum(0)).astype(np.float32))
        read = work.table(source.mapInArrow(_likelihoods(shared), f"doc_id {kind}, declared string, suffix string, host string, domain string, n_grams long, text_log array<double>, text_p array<double>"), "likelihoods")
        # a row's posterior for the sums: of its text alone
        whole = read.agg(_total("text_p").alias("s"), F.count(F.lit(1)).alias("n")).first()
        base = np.array(whole["s"] if whole["n"] else [0.0] * len(names)) + 1.0
        base /= base.sum()
        even = F.array(*(F.lit(float(x)) for x in base))

        def reliability(key: str) -> DataFrame:
            """log P(value | language) of each value, relative to its mean over languages."""
            sums = _sums(read.filter(F.col(key).isNotNull()), [key])
            over = sums.agg(_total("s").alias("all"), F.count(F.lit(1)).alias("values")).filter("values > 0")
            return sums.join(over, F.lit(True)).select(key, F.zip_with("s", "all", lambda s, a: F.log((s + BETA) / (a + BETA * F.col("values")))).alias(f"{key}_log"))

        tags, suffixes = reliability("declared"), reliability("suffix")
        domains = _sums(read.filter("domain IS NOT NULL"), ["domain"]).select("domain", _smoothed(F.col("s"), even).alias("domain_p"))
        hosts = _sums(read.filter("host IS NOT NULL"), ["host", "domain"]).join(domains, "domain", "left").select("host", _smoothed(F.col("s"), F.coalesce("domain_p", even)).alias("prior"))
        hosts = hosts.groupBy("host").agg(F.max("prior").alias("prior"))
        both = read.join(tags, "declared", "left").join(suffixes, "suffix", "left").join(hosts, "host", "left")
        odds = -np.log(BACKGROUND) * (1 - ALPHA * len(table) / table.sum(0))
        both = both.select("doc_id", "declared", "n_grams", "text_log", "text_p", "prior", "declared_log", "suffix_log")
        return work.keep(both.mapInArrow(_fused(names, base, odds, least), f"doc_id {kind}, lang string, confidence double, text_lang string, declared string, n_grams long, kept boolean"))


def identify_pages(pages: DataFrame, **how) -> DataFrame:
    """identify over raw web pages (page_id, url, html): text without markup, lang attribute, suffix and host."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[A-Za-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").alias("page_id"), text.alias("page_text"), F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("tag"), F.when(host != "", host).alias("page_host"))
    suffix = F.regexp_extract(F.coalesce("page_host", F.lit("")), r"\.([a-z]+)$", 1)
    out = identify(rows, id_col="page_id", text_col="page_text", declared=F.col("tag"), suffix=F.when(suffix != "", suffix), host=F.col("page_host"), **how)
    return out.withColumnRenamed("doc_id", "page_id")


def without_unknown_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, **how) -> DataFrame:
    """The rows of docs, with all their columns, that identify keeps. Rows of one identifier are judged by their texts."""
    body = F.xxhash64(text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), body.alias("body")).alias("row_key"), F.col(text_col).alias("row_text"), *(c.alias(n) for n, c in (("row_tag", declared), ("row_host", host)) if c is not None))
    judged = identify(rows, id_col="row_key", text_col="row_text", declared=F.col("row_tag") if declared is not None else None, host=F.col("row_host") if host is not None else None, **how)
    gone = judged.filter("NOT kept").select(F.col("doc_id.id").alias("of"), F.col("doc_id.body").alias("of_body")).distinct()
    whole = docs.select(F.struct("*").alias("whole"))
    own = F.col("whole").getField
    kept = whole.join(gone, own(id_col).eqNullSafe(F.col("of")) & (F.xxhash64(own(text_col)) == F.col("of_body")), "left_anti")
    return kept.select(*(own(c).alias(c) for c in docs.columns))
