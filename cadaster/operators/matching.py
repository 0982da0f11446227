"""Pairs of texts of which one may hold the other, or shares enough words with it, found by their rarest parts.

What a text must share with every text that it matches includes one of its few rarest parts: a text goes
into the join under those alone, and the other side under all its parts. Parts that many texts have pair nothing
unless a text has no other; and no pair that matches is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters of the parts by which a text that holds another is found.
GRAM = 4


def held_parts(value: Column) -> Column:
    """Of which parts a text that holds this one has all: its runs of GRAM letters, or all of it, if it is shorter."""
    return F.when(F.length(value) < GRAM, F.array(value)).otherwise(F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)))


def holding_parts(value: Column) -> Column:
    """All parts that a text has: its runs of up to GRAM letters, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in range(1, GRAM + 1))))


def candidates(some: DataFrame, all_: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: the pairs that can match, each once.

    some: by, a, tag, part, need: each a's parts, of which a match has one of the `need` rarest of a tag. all_: by, b, tag, part.
    The tables of parts are many times what Spark takes exploded ones for: they are joined by shuffles, never broadcast.
    """
    key = [*by, "tag", "part"]
    times = all_.groupBy(*key).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*by, "a", "tag").orderBy(F.coalesce("n", F.lit(0)), "part"))
    rare = some.join(times.hint("merge"), key, "left").withColumn("place", place).where("place <= need AND n IS NOT NULL").select(*key, "a")
    return rare.join(all_.hint("merge"), key).select(*by, "a", "b").distinct()


def containment(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: the pairs of keys (by, key) in which the left one is in the right one."""
    some = left.select(*by, F.col("key").alias("a"), F.lit("").alias("tag"), F.explode(held_parts(F.col("key"))).alias("part"), F.lit(1).alias("need"))
    all_ = right.select(*by, F.col("key").alias("b"), F.lit("").alias("tag"), F.explode(holding_parts(F.col("key"))).alias("part"))
    return candidates(some, all_, by).where(F.contains("b", F.col("a")))
