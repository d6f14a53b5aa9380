"""Reading the input tables and cutting lineage through the shared folder.

Iterative operators write each round as Parquet into the folder that
``spark.checkpoint.dir`` names.  Unlike a local checkpoint this survives the
loss of an executor, and unlike an RDD checkpoint it keeps column pruning and
file statistics for the plans that read it back.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` with Spark's own reader."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where the session names none, a local master gets a temporary folder; on a
    cluster there would be a different one on each machine, so that is refused.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not is_local(master):
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set: executors of {master} need a folder that all of them share")
    return _own_dir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


@functools.cache
def _own_dir() -> str:
    """A folder of this process, gone when it ends."""
    top = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(top, exist_ok=True)
    own = tempfile.mkdtemp(prefix="stemma-", dir=top)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemma-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts, tag: str) -> DataFrame | None:
    """What a sequence of DataFrames of one schema gives, worked off one after another into one table; None if there are none."""
    path = read = None
    for part in parts:
        if path is None:
            path = f"{shared_dir(part.sparkSession)}/stemma-{tag}-{uuid.uuid4().hex}"
            read = part.sparkSession.read.schema(part.schema)
        part.write.mode("append").parquet(path)
    return None if path is None else read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/stemma-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Within ``lean_writes``: shuffle files go with the job that made them, tables are packed more tightly, and two folders are filled without a sort.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.maxConcurrentOutputFileWriters": "2"}


@contextlib.contextmanager
def lean_writes(spark: SparkSession):
    """Within this, jobs take little disk: a written table's shuffle files are deleted as soon as it is written.

    Else they stay until the driver happens to collect its garbage, which a
    chain of jobs over a large table seldom gives it reason to.
    """
    before = {name: spark.conf.get(name, None) for name in _LEAN}
    for name, value in _LEAN.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Stored:
    """A table in folders of the shared one, which several of the same columns can be read as; its folders go when it is dropped."""

    def __init__(self, spark: SparkSession, schema, folders: list[str]):
        self.spark, self.schema, self.folders = spark, schema, folders

    @classmethod
    def write(cls, df: DataFrame, tag: str) -> Stored:
        folder = scratch(df.sparkSession, tag)
        df.write.parquet(folder)
        return cls(df.sparkSession, df.schema, [folder])

    @classmethod
    def together(cls, tables: list[Stored]) -> Stored:
        return cls(tables[0].spark, tables[0].schema, [folder for table in tables for folder in table.folders])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.folders)

    def drop(self) -> None:
        for folder in self.folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(path, True)
            # The last part of a table takes its folder along.
            if "=" in path.getName() and not any(f.isDirectory() for f in files.listStatus(path.getParent())):
                files.delete(path.getParent(), True)


def parted(df: DataFrame, flag: str, tag: str) -> tuple[Stored, Stored]:
    """``df`` as two tables written in one job, that can be dropped one by one: where ``flag`` holds, and where not."""
    spark = df.sparkSession
    top = scratch(spark, tag)
    df.write.partitionBy(flag).parquet(top)
    schema = df.drop(flag).schema

    def part(value: str) -> Stored:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/{flag}={value}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return Stored(spark, schema, [f"{top}/{flag}={value}"])

    return part("true"), part("false")


#: Into how many slices a large table is dealt, one after another, and how many rows in each make it large.
SLICES = 8
SLICE_ROWS = 250_000


def slice_of(key):
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")


def within(part: range, key):
    """Whether a key is in ``part``, some slices or all, as a column."""
    from pyspark.sql import functions as F

    return F.lit(True) if len(part) == SLICES else slice_of(key).between(part.start, part.stop - 1)


def slices(*, large: bool) -> list[range]:
    """The slices that a table is worked off in, one after another: all at once where it is not large."""
    return [range(k, k + 1) for k in range(SLICES)] if large else [range(SLICES)]


def sliced(rows: DataFrame, key, tag: str) -> list[tuple[range, Stored]]:
    """``rows`` written once, dealt by the slice of a key: a table for each, or one where they are not large."""
    spark = rows.sparkSession
    top, name = scratch(spark, tag), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SLICES))
    try:
        # As many files are open in a task: small blocks bound their memory.
        rows.withColumn("slice", slice_of(key)).write.option("parquet.block.size", str(16 << 20)).partitionBy("slice").parquet(top)
    finally:
        spark.conf.set(name, before)
    tables = []
    for k in range(SLICES):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/slice={k}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        tables.append(Stored(spark, rows.schema, [f"{top}/slice={k}"]))
    one = Stored.together(tables)
    large = one.read().count() > SLICES * SLICE_ROWS
    return list(zip(slices(large=True), tables)) if large else [(slices(large=False)[0], one)]


def read_slices(rows: DataFrame, key) -> list[range]:
    """The slices by ``key`` for a table that is not written but read again for each: all at once where the first slice is not large."""
    first = slices(large=True)[0]
    return slices(large=rows.filter(within(first, key)).count() > SLICE_ROWS)


def coarser(parts: list[range]) -> list[range]:
    """The same slices, two and more of them at once, for steps that have room for it: a quarter of all."""
    step = max(1, SLICES // 4)
    return parts if len(parts) == 1 else [range(k, min(k + step, SLICES)) for k in range(0, SLICES, step)]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Within this, Python workers get at most ``rows`` rows at a time: for jobs whose rows are whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, tag: str) -> str:
    """The path of a new folder in the shared one, for files that a job writes and reads again."""
    return f"{shared_dir(spark)}/stemma-{tag}-{uuid.uuid4().hex}"


def join_counted(rows: DataFrame, counted: DataFrame, on: str, n: str, *, most: int = 1000) -> DataFrame:
    """``rows`` joined with one row for each key of ``on``, which says in ``n`` how many rows have the key.

    Keys that more than one in ``most`` rows have are ``most`` at most: they are
    broadcast, and only the others are dealt by hash, so no task meets a hot key.
    Both tables are read twice.
    """
    from pyspark.sql import functions as F

    limit = (counted.agg(F.sum(n)).first()[0] or 0) // most
    hot = F.broadcast(counted.filter(F.col(n) > limit))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(counted.filter(F.col(n) <= limit), on))


def numbered(rows: DataFrame, columns: list[str], into: str = "nth") -> DataFrame:
    """``rows`` with their place in the order of ``columns``, from 0: counted inside ranges, whose sums go before."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = rows.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    # One row for each range.
    ends = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*columns)) - 1
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return placed.select(*rows.columns, (F.col("__start") + F.col("__inside")).alias(into))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compacted(parts: list[DataFrame], most: int = 16) -> list[DataFrame]:
    """The tables that a loop has gathered, as one once there are more than ``most``: plans stay short in deep graphs."""
    if len(parts) <= most:
        return parts
    one = materialise(union_all(parts), "compacted")
    for part in parts:
        discard(part)
    return [one]


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a counted, materialised table has at most ``max_rows`` rows.

    Beyond that the table is returned as it is, and the join is a shuffle join.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
