"""The subpackage's queries, one for each operator, over whole tables, with their SQL."""

from __future__ import annotations

from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaster.llm import chat_format, decontaminate, hard_negatives, jaccard_join, line_crf, line_dedup, packing, quality_bt, substring_dedup, suffix_dedup, toxicity_ftrl, url_filter, whitening
from cadaster.llm.oracles import ORACLES
from cadaster.llm.shared import held_out, small_batches


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    # Python workers import this package too, from wherever the driver runs
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], given.schema)
    return chat_format.digest(chat_format.format_conversations(given.unionByName(hard)))


def _scored(docs: DataFrame, out: DataFrame, threshold: float, folds: int, fold: int) -> DataFrame:
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_bt.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return _scored(docs, quality_bt.score(docs, model), quality_bt.CUT, 5, 0)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_crf.digest(line_crf.judge(docs, line_crf.fit(docs), ["doc_id"]))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return jaccard_join.link(read(spark, sf_dir, "documents"), 4, Fraction(85, 100))


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity_ftrl.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return _scored(docs, toxicity_ftrl.score(docs, weights), toxicity_ftrl.THRESHOLD, 3, 1)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, by rule or else by the model."""
    weights = url_filter.fit(url_filter.labelled(spark))
    return url_filter.judge(read(spark, sf_dir, "pages"), weights).drop("p_block")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), ["doc_id"]))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the bins that hold them."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's lines."""
    return line_dedup.digest(line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return substring_dedup.digest(substring_dedup.dedup(read(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first components, whitened."""
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's bytes."""
    return suffix_dedup.digest(suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, against all; a seventh of the labels moved to the next."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_bt, op3_line_crf, op4_jaccard_join, op5_toxicity_ftrl, op6_url_filter, op7_decontaminate, op8_best_fit_packing, op9_line_dedup, op10_substring_dedup, op11_whitening, op12_suffix_dedup, op13_hard_negatives)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
