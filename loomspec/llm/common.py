"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspec.sources.sinks import shared_root

ID = "__id"
TEXT = "__text"
ROW = "__row"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/loomspec/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def saved(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here and survives lost executors.

    A small table, of far fewer rows than it was made from, goes to as many files as there are cores, however many tasks made
    it: Hadoop's local file system starts two processes for each file, which count as large as the executor until they run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.repartition(spark.sparkContext.defaultParallelism) if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the table that saved() returned, once nothing will read it."""
    for file in df.inputFiles()[:1]:
        drop_scratch(df.sparkSession, file.rpartition("/")[0])


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their workers import what the functions refer to."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loomspec-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for x in sorted(root.rglob("*.py")):
            out.write(x, x.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among the given ones, whatever their case."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str, text_col: str, null_as_empty: bool = True) -> DataFrame:
    """Only the id and the text, under names of our own, so that no other column can clash."""
    ship(docs.sparkSession)
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("bigint").alias(ID), (F.coalesce(text, F.lit("")) if null_as_empty else text).alias(TEXT))


def crc_of_id(col: Column) -> Column:
    """crc32 of the id written as decimal text; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than this part of all rows is hot. Fewer keys than HOT_PARTS can be.
HOT_PARTS = 1000


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], value: str, weight: str, spread: Column, hint: str | None = None) -> DataFrame:
    """rows, with the value that found has for their keys (null where it has none). found is a written table with a row for each key.

    weight is how many rows have the key. Hot keys, fewer than HOT_PARTS by counting, are broadcast; the rows that they serve
    go anywhere (by spread, a 64-bit number) in the join with the others, so no task gets all rows of one key. A hint holds for that join.
    """
    total = found.agg(F.sum(weight)).first()[0] or 0
    key = F.xxhash64(*keys)  # only deals the rows out; the keys themselves are compared, too
    hot = found.where(F.col(weight) * HOT_PARTS > total).select(*(F.col(k).alias(f"__hot_{k}") for k in keys), F.col(value).alias("__hot"))
    rest = found.where(F.col(weight) * HOT_PARTS <= total).select(*(F.col(k).alias(f"__rest_{k}") for k in keys), F.col(value).alias("__rest"), key.alias("__key"))
    rest = rest.hint(hint) if hint else rest

    def same(side: str) -> Column:
        out = F.col(keys[0]) == F.col(f"__{side}_{keys[0]}")
        for k in keys[1:]:
            out = out & (F.col(k) == F.col(f"__{side}_{k}"))
        return out

    known = rows.join(F.broadcast(hot), same("hot"), "left").withColumn("__deal", F.when(F.col("__hot").isNull(), key).otherwise(spread))
    return known.join(rest, same("rest") & (F.col("__deal") == F.col("__key")), "left").select(*rows.columns, F.coalesce("__hot", "__rest").alias(value))


def bounded_memo(limit: int):
    """A dict that computes what it lacks with .make and is emptied when it holds `limit` entries, so memory stays bounded."""

    class Memo(dict):
        def __missing__(self, key):
            if len(self) >= limit:
                self.clear()
            value = self[key] = self.make(key)
            return value

    return Memo()


def pieces(batches: Iterator[pa.RecordBatch], at_once: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of few texts is held at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, at_once):
            yield batch.slice(first, at_once)


def give_back() -> None:
    """Hand this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the GNU library alone
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, for mapInArrow, whose memory goes back after its last batch: Spark keeps a worker for later tasks, and what it
    still holds would count beside theirs."""

    def outer(batches):
        yield from run(batches)
        give_back()  # nothing holds what run had any more

    return outer
