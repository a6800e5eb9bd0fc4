"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tidewright", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A temporary one is made only where that setting is absent and Spark runs on one machine.
    """
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return folder


#: Narrow rows to a partition, where a table of few rows need not be spread over all partitions of a shuffle.
NARROW_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there, so that a lost executor never takes the data with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` for rows of a few numbers: in as many partitions as its rows ask for (at most as many as before), and that number."""
    written = cut(df)
    parts = max(1, -(-written.count() // NARROW_ROWS))
    return written.coalesce(parts), parts


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed by ``key`` and removed in the end.

    What is grouped or joined on ``key`` with it is dealt out to its buckets, and its own rows
    are not shuffled. There are as many buckets as a shuffle has partitions, since Spark
    passes over fewer.
    """
    spark = df.sparkSession
    name = f"rows_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    buckets = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or usual)
    try:
        df.write.format("parquet").option("path", folder).bucketBy(buckets, key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        remove(spark, folder)


#: Rows of whole texts in one Arrow batch, and bytes after which a batch ends sooner.
TEXT_ROWS, BATCH_BYTES = 2000, 8_000_000


def text_batches(df: DataFrame) -> None:
    """Limit the session's Arrow batches to ``TEXT_ROWS`` rows and ``BATCH_BYTES``, as texts are wide and a batch is held on both sides; lower limits stay.

    The limits are read when a query runs, which is after an operator has returned it, so they stay set.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        # A limit in another unit is the caller's choice.
        now = conf.get(key)
        if (number := now.removesuffix("b")).lstrip("-").isdigit() and not 0 < int(number) <= most:
            conf.set(key, str(most))


def free_memory() -> None:
    """Give memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(task: Callable) -> Callable:
    """``task``, a function of a task's batches, and ``free_memory`` when it ends.

    A worker waits for other tasks for up to a minute, beside whatever its executor runs
    then, and would hold the most that a task of its has taken for as long.
    """

    @wraps(task)
    def rows(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            free_memory()

    return rows
