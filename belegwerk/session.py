"""Session settings, the shared scratch folder, written tables and ranks."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Size bounds of what may be broadcast; larger tables are joined by shuffle."""

    rows: int = 4096
    bytes: int = 64 << 20


LIMITS = Limits()
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH, SPARK_BATCH = "2097152b", "67108864b"


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="belegwerk-")


def shared_folder(spark: SparkSession) -> str:
    """A new path inside the folder named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def sound_unions(spark: SparkSession) -> None:
    """Keep unions from claiming their children's partitioning.

    Spark 4.1 lets a union of equally partitioned children count as partitioned
    and then aggregates without a shuffle. When adaptive execution coalesces the
    children differently, e.g. because one reuses an exchange, keys of one group
    sit in different partitions and the aggregate returns doubles.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession) -> None:
    """Send wide rows to Python 2 MB at a time instead of Spark's 10,000 rows or 64 MB.

    A batch of texts is held several times over, outside the heap and in each worker, and
    neither gives the memory back. A size that the session has set itself stays.
    """
    if spark.conf.get(ARROW_BYTES) == SPARK_BATCH:
        spark.conf.set(ARROW_BYTES, SMALL_BATCH)


@contextmanager
def large_batches(spark: SparkSession) -> Iterator[None]:
    """Spark's own size of batches for the jobs run within, if ``small_batches`` has lowered it."""
    lowered = spark.conf.get(ARROW_BYTES) == SMALL_BATCH
    if lowered:
        spark.conf.set(ARROW_BYTES, SPARK_BATCH)
    try:
        yield
    finally:
        if lowered:
            spark.conf.set(ARROW_BYTES, SMALL_BATCH)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    sound_unions(df.sparkSession)
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def input_size(df: DataFrame) -> int:
    """The optimizer's size estimate, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Write a frame, and mark it for broadcast if it turned out small enough.

    Its files are compressed; in memory they may take some eight times as much.
    """
    out = materialise(df)
    return F.broadcast(out) if 8 * input_size(out) <= limits.bytes else out


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """Use every core on a small table that sits in too few row groups.

    Tables above ``small`` bytes have enough splits and are never shuffled here.
    """
    if input_size(df) > small:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def collect_bounded(df: DataFrame, limits: Limits = LIMITS) -> pa.Table:
    """Fetch a frame whose size is checked, not assumed."""
    table = df.limit(4 * limits.rows + 1).toArrow()
    if table.num_rows > 4 * limits.rows or table.nbytes > 8 * limits.bytes:
        raise ValueError(f"{table.num_rows} rows, {table.nbytes} bytes: more than one block holds")
    return table


def ranked(df: DataFrame, by: list[str], order: list, rank: str = "rank") -> DataFrame:
    """Every row with its 1-based rank within its key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, by: list[str], order: list, rank: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per key with their 1-based rank.

    The rank filter lets Spark cut every partition to ``k`` rows per key before
    the shuffle, so a hot key never reaches one task whole.
    """
    return ranked(df, by, order, rank).filter(F.col(rank) <= k)
