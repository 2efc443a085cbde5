"""The registered queries of the operators, over whole tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolwright.llm import automaton, decontaminate, hosts, langid, licenses, mixing, neardup, quality, secrets, suffixes
from poolwright.llm.stage import stage_root, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5 % of the good documents of a language rejected, with 90 % confidence."""
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stratum=F.col("lang"), false_rejection=0.05, delta=0.1)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a ledger kept as files, new with each call."""
    return secrets.digest(table(spark, sf_dir, "documents"), ledger=secrets.Ledger(spark, f"{stage_root(spark)}/ledger-{uuid.uuid4().hex}"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second scan of a ledger adds: the base rules have met all documents,
    then all rules meet the documents and the turns of conversations."""
    docs, ledger = table(spark, sf_dir, "documents").select("text"), secrets.Ledger(spark, f"{stage_root(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(docs, rules=secrets.BASE)
    new = ledger.scan(docs.union(table(spark, sf_dir, "conversations").select("text")))
    return new.select("blob", F.array_join(F.transform("scanned", lambda x: F.concat_ws(":", x["kind"], x["version"])), ",").alias("rules"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrate(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return automaton.score_texts(table(spark, sf_dir, "documents"), held_out=held_out, order=3)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(langid.document_records(docs), langid.fit(docs))


def op9_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.page_records(table(spark, sf_dir, "pages")), langid.fit(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_quality_rules, op3_secret_scans, op3_secret_ledger, op4_mix_sources, op5_url_filters,
    op6_lm_scoring, op7_license_scans, op8_decontaminate, op9_language_id, op9_language_id_pages, op10_suffix_dedup,
)}
