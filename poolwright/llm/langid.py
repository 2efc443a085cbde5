"""Language ID by Bayesian fusion of evidence.

Text likelihoods come from byte trigrams, fitted on a bounded sample of
declared texts.  The declared language, the address suffix and the host are
further evidence: confusion tables of the first two and the host's prior are
grouped counts over all records, and a host's prior is smoothed towards its
domain's, that towards its top-level domain's, that towards the whole.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm import textnp
from poolwright.llm.graph import join_by_key
from poolwright.llm.stage import PLACE, frugal, materialize, placed, without

BUCKETS = 1 << 16
#: At most so many declared texts of a language are expected in the sample
#: that fits the text model; every declared language is modelled, so many of
#: them counted at a time.
SAMPLE, BLOCK = 1500, 32
#: Trigrams of a text depend on each other: its log-likelihood counts so much.
TEMPER = 0.3
#: Letters in lower case; every other ASCII byte is a space, so numbers, codes
#: and markup say nothing of a language.
LETTERS = textnp.LOWER.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32
#: A language code, with script, region or more after it.
TAG = r"^([A-Za-z]{2,3})(?:[-_](?:[A-Za-z]{2}|[A-Za-z]{4}|[0-9]{3})(?:[-_].*)?)?$"
#: Pseudo-counts: of a level above in a prior, of each cell in a confusion.
PRIOR, CELL = 20.0, 1.0


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def buckets(data: np.ndarray) -> np.ndarray:
    """A bucket per byte trigram."""
    x = LETTERS[data].astype(np.uint32)
    x = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(16)


def tongue(tag: Column) -> Column:
    """The language of a declared value: codes of two or three letters in lower
    case, without script or region (en-US, EN: en); other values as they are."""
    return F.when(F.regexp_like(tag, F.lit(TAG)), F.lower(F.regexp_extract(tag, TAG, 1))).otherwise(tag)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram shares of every declared language in a sample by id hash."""
    rows = docs.select(F.col(id_col).alias("i"), tongue(F.col(lang_col).cast("string")).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    space = 1 << 40
    share = docs.sparkSession.createDataFrame([(x, k, min(space, space * sample // sizes[x])) for k, x in enumerate(languages)], "l string, k int, share long")
    rows = rows.join(F.broadcast(share), "l").where(F.pmod(F.xxhash64("i"), F.lit(space)) < F.col("share")).select("k", "t")
    if len(languages) > BLOCK:
        rows = materialize(rows)
    log_p = np.empty((BUCKETS, len(languages)), np.float32)
    for first in range(0, len(languages), BLOCK):
        some = slice(first, min(first + BLOCK, len(languages)))
        log_p[:, some] = _log_shares(rows.where(F.col("k").between(some.start, some.stop - 1)), some)
    return Model(languages, log_p)


def _log_shares(rows: DataFrame, some: slice) -> np.ndarray:
    """BUCKETS x languages of a block, from rows (k: number of the language, t)."""
    first, width = some.start, some.stop - some.start

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, BUCKETS), np.int64)
        for batch in batches:
            tongues = batch.column(0).to_numpy() - first
            for start, end, data, offsets in textnp.chunks(batch.column(1)):
                for i in range(start, end):
                    text = data[offsets[i - start] : offsets[i - start + 1]]
                    if len(text) > 2:
                        sums[tongues[i]] += np.bincount(buckets(text), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<i8").tobytes()])], ["sums"])

    parts = rows.repartition(8).mapInArrow(count, "sums binary").collect()  # a table of fixed size from each of 8 tasks
    sums = sum(np.frombuffer(r["sums"], "<i8").reshape(width, BUCKETS) for r in parts)
    p = (sums + 0.05) / (sums + 0.05).sum(1, keepdims=True)
    return np.log(p).T.astype(np.float32)


def text_scores(records: DataFrame, model: Model) -> DataFrame:
    """``records`` with the column text replaced by n_bytes and ``ll``, the
    log-likelihoods of the whole text by language."""
    frugal(records.sparkSession)
    kept = [f for f in records.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_bytes long, ll array<double>"
    width, log_p = len(model.languages), model.log_p

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            sums, sizes = np.zeros((len(column), width)), np.zeros(len(column), np.int64)
            for first, last, data, offsets in textnp.chunks(column, 1 << 19):
                sizes[first:last] = np.diff(offsets)
                if len(data) < 3:
                    continue
                at = buckets(data)
                lo, hi = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - 2)
                full = np.flatnonzero(hi > lo)
                marks = np.stack([lo[full], hi[full]], 1).ravel()
                for k in range(width):
                    each = np.append(log_p[:, k][at], np.float32(0)).astype(np.float64)
                    sums[first + full, k] = np.add.reduceat(each, marks)[::2] if len(full) else 0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(f.name)) for f in kept] + [pa.array(sizes), flat], [f.name for f in kept] + ["n_bytes", "ll"])

    return records.mapInArrow(score, schema)


def _one_hot(languages: list[str], value: Column) -> list[Column]:
    return [F.sum(F.when(value == x, 1.0).otherwise(0.0)) for x in languages]


def _counts(scored: DataFrame, key: str, languages: list[str]) -> DataFrame:
    return scored.where(F.col(key).isNotNull() & F.col("text_lang").isNotNull()).groupBy(key).agg(F.array(*_one_hot(languages, F.col("text_lang"))).alias("c"))


def _smooth(counts: Column, above: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + PRIOR * p) / (total + PRIOR))


def _host_priors(scored: DataFrame, languages: list[str]) -> tuple[DataFrame, list[float]]:
    """host, prior for each host, and the prior of the whole."""
    hosts = materialize(_counts(scored, "host", languages).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$|^[^.]*$", 0)).withColumn("top", F.regexp_extract("host", r"[^.]*$", 0)))
    add = lambda by: hosts.groupBy(by).agg(F.array(*(F.sum(F.col("c")[i]) for i in range(len(languages)))).alias("c"))
    whole = hosts.agg(*(F.sum(F.col("c")[i]) for i in range(len(languages)))).first()
    whole = [(x or 0.0) + CELL for x in whole]
    whole = [x / sum(whole) for x in whole]
    tops = add("top").select("top", _smooth(F.col("c"), F.array(*map(F.lit, whole))).alias("top_p"))
    domains = add("domain").withColumn("top", F.regexp_extract("domain", r"[^.]*$", 0)).join(tops, "top").select("domain", _smooth(F.col("c"), F.col("top_p")).alias("domain_p"))
    return hosts.join(domains, "domain").select("host", _smooth(F.col("c"), F.col("domain_p")).alias("prior")), whole


def _confusion(scored: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """key, P(key | language) per language, from all records."""
    rows = materialize(_counts(scored, key, languages))
    total = rows.agg(F.count("*"), *(F.sum(F.col("c")[i]) for i in range(len(languages)))).first()
    sums = [(x or 0.0) + CELL * (total[0] + 1) for x in total[1:]]
    return rows.select(key, F.zip_with("c", F.array(*map(F.lit, sums)), lambda c, s: (c + CELL) / s).alias(f"{key}_p"))


def identify(records: DataFrame, model: Model, *, least: float = 0.6) -> DataFrame:
    """``records`` (any columns, text, host, declared, suffix; the last three
    may be null) with n_bytes, language, posterior and kept in place of text.

    Rejected are texts without three bytes, texts that every language finds
    less likely than random bytes, and those whose posterior is under ``least``.
    Without a model (no declared text at all) every row is rejected.  Repeated
    rows count as often as they occur.  Evidence is joined to the distinct
    (host, declared, suffix), and these to the records, of which one may hold a
    large part.  Columns called n_bytes, ll, text_lang, language, posterior or
    kept are dropped first.
    """
    records = records.drop("n_bytes", "ll", "text_lang", "language", "posterior", "kept")
    langs = model.languages
    if not langs:
        return records.select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept")).drop("text")
    names = F.array(*map(F.lit, langs))
    scored = text_scores(records, model)
    clear = (F.col("n_bytes") >= 20) & (F.array_max("ll") > F.lit(-np.log(BUCKETS)) * F.col("n_bytes"))
    scored = materialize(scored.withColumn("text_lang", F.when(clear, F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")))))
    priors, whole = _host_priors(scored, langs)
    known = ["host", "declared", "suffix"]
    seen = scored.select(*known).distinct()
    seen = seen.join(priors, "host", "left").join(_confusion(scored, "declared", langs), "declared", "left").join(_confusion(scored, "suffix", langs), "suffix", "left")
    ones = F.array(*(F.lit(1.0) for _ in langs))
    told = F.transform(F.coalesce("prior", F.array(*map(F.lit, whole))), F.ln)
    for evidence in (F.coalesce("declared_p", ones), F.coalesce("suffix_p", ones)):
        told = F.zip_with(told, evidence, lambda a, p: a + F.ln(p))
    key = F.to_json(F.struct(*known)).alias("_known")  # null fields are left out, so no two are alike
    told = materialize(seen.select(key, told.alias("_told")))
    out = join_by_key(scored.select("*", key), told, "_known")
    out = out.withColumn("_f", F.zip_with(F.transform("ll", lambda x: x * TEMPER), "_told", lambda a, p: a + p)).withColumn("_m", F.array_max("_f"))
    share = 1 / F.aggregate("_f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
    out = out.withColumn("language", F.element_at(names, F.array_position("_f", F.col("_m")).cast("int"))).withColumn("posterior", F.round(share, 6))
    random = F.array_max("ll") <= F.lit(-np.log(BUCKETS)) * F.col("n_bytes")
    out = out.withColumn("kept", (F.col("n_bytes") >= 3) & ~random & (F.col("posterior") >= least))
    return out.select(*(c for c in records.columns if c != "text"), "n_bytes", "language", "posterior", "kept")


def document_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Documents declare a language and have a source as host, no address."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("declared"), F.lower(F.col(host_col).cast("string")).alias("host"), F.lit(None).cast("string").alias("suffix"), F.col(text_col).alias("text"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages declare a language in markup; the address has host and suffix (a
    language segment of the path, else the top-level domain)."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    segment = F.lower(F.regexp_extract("url", r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select("page_id", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.when(segment != "", segment).otherwise(F.regexp_extract(host, r"[^.]*$", 0)), F.lit("")).alias("suffix"), text.alias("text"))


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, without those rejected.  Each row is
    judged by itself, whatever its id."""
    model, docs = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), placed(docs)
    rows = docs.select(*PLACE, *(F.col("_all")[c].alias(name) for c, name in ((lang_col, "declared"), (host_col, "host"), (text_col, "text"))))
    rows = rows.select(*PLACE, F.col("declared").cast("string"), F.lower(F.col("host").cast("string")).alias("host"), F.lit(None).cast("string").alias("suffix"), "text")
    return without(docs, materialize(identify(rows, model).where("not kept").select(*PLACE)))
