"""Structured Streaming forms of ingestion: file streams into appended, upserted or replaced tables, with row rules enforced.

Batches go through foreachBatch into a versioned table, which commits a batch's number with its rows; a batch that is run
again, after a failure, finds its number and changes nothing. Appends add files; upserts and snapshots write the table anew. Checkpoints and tables live where the caller says, in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomspec.operators.ingest import after_batch, appends, apply_post_rules, batch_rows, latest, max_sequence, upsert
from loomspec.operators.suite import enforce
from loomspec.plans.compiler import compile_table
from loomspec.sources.sinks import VersionedTable
from loomspec.spec import Rule, TableDefinition


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """New files of a folder, with a declared schema."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order_by: tuple[str, ...] = ("_load_ts",), policy: str = "max_sequence_wins", after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keep one row per key. max_sequence_wins: an older row never replaces a newer one, so late batches do no harm;
    last_batch_wins: the latest row of a batch replaces what is there. `after` sees the table after each batch."""
    spark = stream.sparkSession
    table = VersionedTable(spark, path)

    def one(batch: DataFrame, number: int) -> None:
        if table.has(number):
            return
        old = table.read()
        table.write(max_sequence(old, batch, keys, order_by) if policy == "max_sequence_wins" else upsert(old, latest(batch, keys, order_by), keys), number)
        if after is not None:
            after(table.read())

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def snapshot_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the table."""
    table = VersionedTable(stream.sparkSession, path)
    return stream.writeStream.foreachBatch(lambda batch, number: None if table.has(number) else table.write(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(raw: DataFrame, spec: TableDefinition, path: str, checkpoint: str, rules: list[Rule] = (), quarantine: str | None = None, reference: DataFrame | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Batches into a table as `ingest_batch` has it: the same casts, exclusions, modes, merge strategies and rules afterwards.
    Without a key only the batch's rows are written. Rows that break a rule are set aside, or stop the stream, by its
    severity; a batch's number names the folder of those set aside, so that a repeated batch replaces it. `after` sees the
    table, and the batch's number, when the batch is in it; it may see one again."""
    table = VersionedTable(raw.sparkSession, path)

    def one(batch: DataFrame, number: int) -> None:
        if not table.has(number):
            take(batch, number)
        if after is not None:
            after(table.read(), number)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch_rows(batch, spec, reference=reference)
        if rules:
            rows, bad = enforce(rows, list(rules))
            if quarantine:
                bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if appends(spec):
            table.append(apply_post_rules(rows, spec.ingestion.post_rules), number)
        else:
            table.write(after_batch(table.read(), rows, spec), number)

    watched = raw.observe("rows", F.count("*").alias("read"))
    return watched.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gold_after(spark: SparkSession, gold: TableDefinition, name: str, others: dict[str, DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """What `ingest_stream` calls to keep a derived table, a versioned one, up to date with the table that it fills, called `name` in
    gold's specification; others are the tables that gold reads besides."""
    out = VersionedTable(spark, path)

    def refresh(table: DataFrame, number: int) -> None:
        if not out.has(number):
            out.write(compile_table(spark, gold, others | {name: table}), number)

    return refresh


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling windows; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
