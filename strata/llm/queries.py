"""One query per operator over its whole table, under the names that __spark_entry__ registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, collocations, filter_audit, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, search, token_counts, url_filter, warc
from strata.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is of the text that is left, in UTF-8. All near lines are found, whatever their keys' groups hold."""
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), per=line_dedup.PER, rounds=None)
    return left.select("doc_id", "n_lines_dropped", "n_lines_near", "n_lines_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places").alias("first_word"), F.array_max("base_places").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap or a damaged record in what was just written fails the query."""
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    sound = F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("archive record "), F.col("offset").cast("string"), F.lit(" of "), "file", F.lit(": "), "problem")).cast("long"))
    return records.withColumn("page_id", sound).select("page_id", "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of documents whose id is divisible by 50, as queries against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where(F.col("doc_id") % 50 == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_line_dedup, op3_bpe, op4_licenses, op5_warc, op6_mix, op7_token_counts, op8_search, op9_quality_rules, op10_quality, op11_collocations, op12_url_filter, op13_filter_audit)}
ORACLE_SQL = {"op5_warc": warc.ROUND_TRIP_SQL, "op6_mix": mixing.MIX_SQL, "op8_search": search.TOP_SQL, "op9_quality_rules": quality_rules.JUDGE_SQL, "op11_collocations": collocations.COLLOCATIONS_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
