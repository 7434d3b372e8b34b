"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id, oracles, quality
from .conversations import damage, repair
from .decontamination import contamination
from .license_scan import scan
from .lm_scoring import score
from .mixing import copies
from .neighbours import nearest
from .ngram_join import near_duplicates
from .pii import redact
from .point_in_time import feature_table
from .substring_dedup import remove_repeats
from .warc import read, write


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "types")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(_table(spark, sf_dir, "conversations")))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(*[_table(spark, sf_dir, t) for t in ("sales", "clicks", "sale_lines")])


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_neighbours, op3_ngram_join, op4_substring_dedup, op5_pii, op6_mixing, op7_quality, op8_warc, op9_decontamination, op10_lm_scoring, op11_conversation_repair, op12_point_in_time, op13_language_id)}
ORACLE_SQL = oracles.SQL
