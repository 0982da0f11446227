"""A training corpus from `documents`: rank and filter, drop repeated lines, near copies and
benchmark passages, and pack what is left into sequences.

Each stage calls one operator and works on all that its predecessor kept. The stages but the last
return the columns of documents, also columns that have the names of the operators' own; the last
returns the packed pieces.

Every stage takes empty tables (and gives none), texts of any length, and repeated rows, which are
decided alike. A null text has the features of no words for the quality stage, no lines, no near copy
and no contamination, and packs as a document without tokens. A row without doc_id is ranked by its
text; no line of it goes, it is nobody's copy, and it is packed. Ties: of equal lines or near copies
that of the smallest doc_id, then of the smallest line number, stays; equal scores are kept alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaster.llm import decontaminate, jaccard_join, line_dedup, packing, quality_bt
from cadaster.llm.queries import read
from cadaster.llm.shared import forget, held_out, passing, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut; fitted on labelled ones among them. Without any, all score 0.5 and stay."""
    model = quality_bt.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    scored = quality_bt.score(docs.withColumnRenamed("score", "__score"), model)
    return scored.where(F.col("score") >= quality_bt.CUT).drop("score").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no line is left go.

    n_chars, where documents have it, is counted anew for texts that lost a line.
    """
    own = {c: f"__{c}" for c in ("n_lines", "n_removed") if c in docs.columns}  # columns that the operator would replace
    cut = line_dedup.dedup(docs.withColumnsRenamed(own))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.drop("n_lines", "n_removed").withColumnsRenamed({b: a for a, b in own.items()}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near copies: five-word shingles, similarity 0.8 or more; documents without words are no copies."""
    others = jaccard_join.link(docs).where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(saved(others, "copies"), "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate: with a hit word, a twentieth of their words or more being hit."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; those without tokens have no bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]

#: A fitted classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what stages write in between is deleted when they end."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        keep: list[DataFrame] = []
        with passing(keep):
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if before is not None:
            forget(before)
        before = docs
    return docs
