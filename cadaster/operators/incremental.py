"""Incremental runs: reuse of unchanged files, differences between inventories, fingerprints, refresh decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.functions import text


def path_key(path: Column) -> Column:
    return F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def concerns_people(path: Column) -> Column:
    return text.person_folder(path).isNotNull()


def concerns_accounts(path: Column) -> Column:
    return text.path_has_segments(path, F.lit("*Opérateur/*Eléments financiers")) | F.contains(F.lower(path), F.lit("bilan"))


def reuse(files: DataFrame, before: DataFrame, chunked: DataFrame) -> DataFrame:
    """Adds `reuse`: the file had the same path and size before, and has chunks."""
    same = before.select("project_id", "source_path", "file_size_bytes").distinct().withColumn("known", F.lit(True))
    done = chunked.select("document_id").distinct().withColumn("chunked", F.lit(True))
    rows = files.join(same, ["project_id", "source_path", "file_size_bytes"], "left").join(done, "document_id", "left")
    return rows.withColumn("reuse", F.coalesce(F.col("known") & F.col("chunked"), F.lit(False))).drop("known", "chunked")


def stale(before: DataFrame, files: DataFrame) -> DataFrame:
    """What was listed before and is no more."""
    return before.join(files, ["project_id", "source_path"], "left_anti")


def difference(before: DataFrame, now: DataFrame) -> DataFrame:
    """project_id, source_path, change: added, removed or modified in size."""
    side = lambda df, s: df.select("project_id", path_key(F.col("source_path")).alias("key"), F.col("source_path").alias(f"{s}_path"), F.col("file_size_bytes").alias(f"{s}_size"))
    both = side(before, "old").join(side(now, "new"), ["project_id", "key"], "full_outer")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "removed").when(~F.col("old_size").eqNullSafe(F.col("new_size")), "modified")
    return both.select("project_id", F.coalesce("new_path", "old_path").alias("source_path"), change.alias("change")).where("change IS NOT NULL")


def change_flags(changes: DataFrame) -> DataFrame:
    both = F.struct(concerns_people(F.col("source_path")).alias("people"), concerns_accounts(F.col("source_path")).alias("accounts"))
    changes = text.once(changes, "__of", both)
    return changes.groupBy("project_id").agg(
        *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")), F.count("*").alias("changed"),
        F.coalesce(F.bool_or("__of.people"), F.lit(False)).alias("people_related"), F.coalesce(F.bool_or("__of.accounts"), F.lit(False)).alias("financial_related"))


def _fingerprint(keep: Column) -> Column:
    lines = F.sort_array(F.collect_list(F.when(keep, F.concat(F.col("source_path"), F.lit("::"), F.col("file_size_bytes").cast("string")))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)


def fingerprints(files: DataFrame) -> DataFrame:
    """sha256 over the sorted `path::size` lines of each project's people and accounts files."""
    both = F.struct(concerns_people(F.col("source_path")).alias("people"), concerns_accounts(F.col("source_path")).alias("accounts"))
    files, people, accounts = text.once(files, "__of", both), F.col("__of.people"), F.col("__of.accounts")
    return files.groupBy("project_id").agg(_fingerprint(people).alias("people"), _fingerprint(accounts).alias("financial"), F.count_if(people).alias("people_inputs"), F.count_if(accounts).alias("financial_inputs"))


def refresh_decision(before: DataFrame, now: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether a project's people and accounts are to be computed anew; before, now: fingerprints().

    People are, where there are inputs for them, if these changed or people are missing. stored: project_id, persons: how many the last
    extraction has, has_file: whether their file is there; a project that is not in it has neither.
    """
    old = before.select("project_id", F.col("people").alias("old_people"), F.col("financial").alias("old_financial"))
    rows = now.join(old, "project_id", "left").join(stored.select("project_id", "persons", "has_file"), "project_id", "left")
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    missing = (F.coalesce("persons", F.lit(0)) == 0) | ~F.coalesce("has_file", F.lit(False))
    return rows.select("project_id", ((F.col("people_inputs") > 0) & (changed("people") | missing)).alias("people_recomputed"), changed("financial").alias("financial_recomputed"))
