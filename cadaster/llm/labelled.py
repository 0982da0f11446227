"""Labelled documents, the rows that a classifier here is fitted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import by_merge


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: dict[int, int | None]) -> DataFrame:
    """docs of the labelled documents to learn from, with y and a hash h: the order of h and doc_id looks random.

    keep: which doc_ids may be learned from. most: the bound on each label's rows, None for all of them; past a bound
    those of smallest hash are taken, so a sample does not depend on the order of rows. Labels that are null or
    contradict each other are left out. Ids are broadcast only if every label has a bound, which is their size.
    """
    known = labels.where(F.col(label).isin(*most) & keep).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other").select("doc_id", "y")
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    if all(n is None for n in most.values()):
        return by_merge(docs, known, "doc_id")
    each = ((n, known.where(F.col("y") == y)) for y, n in most.items())
    taken = reduce(DataFrame.unionByName, (rows if n is None else rows.orderBy("h", "doc_id").limit(n) for n, rows in each))
    return by_merge(docs, taken, "doc_id") if None in most.values() else docs.join(F.broadcast(taken), "doc_id")
