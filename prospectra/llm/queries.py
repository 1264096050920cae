"""Queries of the training-data operators, as registered in __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, langid, oracle, packing, periodic_runs, quality_classifier, quality_rules, rans, secrets, sharding, simhash, url_filter, warc
from .common import ship_package, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: fingerprint and component; null, empty and repeated rows as near_duplicates() says."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: predicted language, score, proportions; null and letterless texts are `und`, an empty table gives no rows."""
    return langid.held_out(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of a document and an item it holds; null texts hold nothing, repeated rows count once."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: base counts and verdict; null texts have no words and fail, repeated rows come back as often."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: score and prediction; null texts are scored as empty ones, a tie at the threshold predicts 1."""
    return quality_classifier.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece; null texts are the end id alone, repeated rows are packed one by one."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: shard and slot; null texts count no bytes, null sources are one source, repeated rows are placed one by one."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, read back from archives; null html is an empty payload, repeated rows are responses each."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, decoded from token files; null texts are the end id alone, rows with a null id come first."""
    return rans.token_files(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: counts and spans; null texts have none, repeated rows have the same."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its runs' digests and the run of greatest exponent; null texts have no word, repeated rows come back as often."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: groups and links of two tokenizers' tokens; null texts have none, repeated rows are counted one by one."""
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: host, path, rule and verdict; null urls have an empty host and path, repeated rows come back as often."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


_ALL = {
    f.__name__: f
    for f in (
        op1_simhash, op2_language_mixture, op3_decontamination, op4_quality_rules, op5_quality_classifier,
        op6_packing, op7_sharding, op8_warc, op9_rans, op10_secrets, op11_periodic_runs, op12_alignment, op13_url_filter,
    )
}


def _with_package(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_package(f) for name, f in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": oracle.decontamination(), "op8_warc": oracle.warc(), "op10_secrets": oracle.secret_scans(), "op13_url_filter": oracle.url_filter()}
