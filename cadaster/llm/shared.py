"""Tables written between jobs, and small schema helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cadaster-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of bounded size: a few MB, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder, with a directory for each value of `by`, and reads it back.

    This cuts lineage in a way that survives lost executors. The write's shuffle files are
    dropped when it ends, as the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadaster-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if (scope := _scope.get()) is not None:
        scope.append(out)
    return out


#: Tables saved in the innermost passing() of this thread.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def passing(keep: list[DataFrame]) -> Iterator[None]:
    """Tables saved inside are deleted at the end, but for those in `keep` by then, which the result is read from."""
    outer, made = _scope.get(), []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        kept = {t.saved_at for t in keep}
        forget(*(t for t in made if t.saved_at not in kept))
        if outer is not None:
            outer.extend(t for t in made if t.saved_at in kept)


def forget(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the corpus: shuffled at every size, never a broadcast."""
    return left.join(right.hint("merge"), on, how)


#: Rows of one key that meet one copy of its row in split_join().
PER_COPY = 64


def split_join(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """many, a saved table, joined with the one row of each key: a key with many rows is dealt, by `spread`, to as many copies of its row as it needs."""
    hot = many.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > PER_COPY).select(key, F.ceil(F.col("__n") / PER_COPY).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("__part", F.pmod(F.hash(spread), parts)).drop("__parts")
    copies = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return by_merge(dealt, copies, [key, "__part"]).drop("__part")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is fold; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def map_texts(docs: DataFrame, keep: list[str], fields: str, per_text, text: str = "text") -> DataFrame:
    """The kept columns of docs with the fields that per_text returns for each whole text (UTF-8 bytes or None).

    fields: DDL of the added columns. per_text: a function made by a maker that workers call once, so
    that what it builds (automata, tables) is built once a task: per_text() -> (bytes | None) -> tuple.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(fields)
    rows = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    types = [to_arrow_type(f.dataType) for f in added]
    names = [*keep, *added.names]

    def run(batches):
        function = per_text()
        for batch in batches:
            # a few hundred texts at a time bound what is held beside the batch
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [function(x) for x in part.column(len(keep)).to_pylist()]
                columns = [pa.array(list(c), type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=names)

    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *added.fields]))
