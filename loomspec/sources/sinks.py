"""Sinks: versioned Parquet tables, single CSV files, history tables, and the form of values on the way out."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions.formats import to_java
from loomspec.spec import TableDefinition


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, one of our own, on a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspec-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Folders of a version that appends have made, beyond which the next append writes them as one.
MOST_FOLDERS = 200


class VersionedTable:
    """A Parquet table whose versions are lists of folders; a pointer file has the current list and the last batch's number.

    Readers see a whole version or the one before; a folder that is being read is never written. Folders are told apart by
    random names; the pointer is replaced by one overwriting rename, so a version and the number of the batch that made it
    are committed together: a batch that is run again after a failure finds its number, or none of its rows. An append adds
    a folder; rows that are there already are not written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> tuple[list[str], int | None]:
        """The folders, and the number of the last batch."""
        fs, pointer = _fs(self.spark, f"{self.path}/CURRENT")
        if not fs.exists(pointer):
            return [], None
        state = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).collect()))
        return state["folders"], state["batch"]

    def read(self) -> DataFrame | None:
        folders, _ = self.current()
        if not folders:
            return None
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.path}/{x}" for x in folders))

    def has(self, batch: int) -> bool:
        """Whether this batch, or a later one, is in the table."""
        last = self.current()[1]
        return last is not None and batch <= last

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        """df replaces the rows. Folders of the version before stay until the next replacement, for those who read them."""
        folders, last = self.current()
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._commit([name], last if batch is None else batch)
        self._remove_but({name, *folders})

    def append(self, df: DataFrame, batch: int | None = None) -> None:
        folders, last = self.current()
        name = f"v-{uuid.uuid4().hex}"
        if len(folders) >= MOST_FOLDERS:
            return self.write(self.read().unionByName(df, allowMissingColumns=True), batch)
        df.write.parquet(f"{self.path}/{name}")
        self._commit([*folders, name], last if batch is None else batch)

    def _remove_but(self, kept: set[str]) -> None:
        fs, root = _fs(self.spark, self.path)
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)

    def _commit(self, folders: list[str], batch: int | None) -> None:
        fs, pointer = _fs(self.spark, f"{self.path}/CURRENT")
        temp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/.new-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"folders": folders, "batch": batch}).encode()))
        out.close()
        fs_package = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = fs_package.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(fs_package, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(temp), fs.makeQualified(pointer), how)


def format_for_output(df: DataFrame, spec: TableDefinition) -> DataFrame:
    """Dates and timestamps by their pattern, and NULLs by their text, where the specification has them."""
    columns = {c.output_name: c for c in spec.columns}
    out = []
    for f in df.schema.fields:
        x, c = F.col(f"`{f.name}`"), columns.get(f.name)
        if c and c.format and isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            x = F.date_format(x, to_java(c.format))
        if c and c.null_output_value is not None:
            x = F.coalesce(x.cast("string"), F.lit(c.null_output_value))
        out.append(x.alias(f.name))
    return df.select(*out)


def write_single_csv(df: DataFrame, path: str, sep: str = "|", footer: bool = False) -> None:
    """One file, for deliveries that need one; with footer a last line with the count of records. Rows go through one task."""
    spark = df.sparkSession
    if footer:
        lines = df.select(F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value"), F.lit(1).alias("part"))
        head = spark.createDataFrame([(sep.join(df.columns), 0)], "value string, part int")
        tail = df.agg(F.concat(F.lit("TRAILER"), F.lit(sep), F.count("*")).alias("value"), F.lit(2).alias("part"))
        ordered = head.unionByName(lines).unionByName(tail).repartition(1).sortWithinPartitions("part")
        ordered.select("value").write.mode("overwrite").text(path + ".parts")
    else:
        df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path + ".parts")
    fs, folder = _fs(spark, path + ".parts")
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)


class History:
    """An append-only table of runs, by run_date; results of rules, baselines and profiles are kept like this."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, df: DataFrame) -> None:
        if "run_date" not in df.columns:
            df = df.withColumn("run_date", F.to_date("run_timestamp"))
        df.write.mode("append").partitionBy("run_date").parquet(self.path)

    def read(self, **equal) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        for k, v in equal.items():
            df = df.where(F.col(k) == v)
        return df

    def recent(self, limit: int, **equal) -> DataFrame:
        return self.read(**equal).orderBy(F.desc("run_timestamp"), "run_id").limit(limit)

    def last_run(self, **equal):
        return self.read(**equal).agg(F.max("run_timestamp")).first()[0]

    def latest(self, keys: list[str]) -> DataFrame:
        """The row of the last run for each key."""
        df = self.read()
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max(F.struct("run_timestamp", "run_id", *(c for c in rest if c not in ("run_timestamp", "run_id")))).alias("r")).select(*keys, "r.*")
