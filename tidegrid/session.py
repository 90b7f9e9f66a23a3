"""Session helpers: time zone, local sessions for tests, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType


def pin_utc(spark: SparkSession) -> SparkSession:
    """Hours are wall-clock values; a fixed UTC session keeps them as written."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Blocks of rows as bytes are a few MB each, and by itself the Parquet writer looks at its size once in a hundred rows:
# a whole file would be one page, which it and every reader hold several times over.
_BLOCK_FILES = {
    "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(2**23),
    "parquet.enable.dictionary": "false",
}
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_LIMITED: list[str] = []  # the limits that were set before, one per block of code that runs
_LOCK = Lock()


@contextmanager
def small_batches(spark: SparkSession, limit: int = 2**21) -> Iterator[None]:
    """What runs meanwhile gets Arrow batches of ``limit`` bytes (a row more at most), also in other threads.

    Rows of a few MB would otherwise be handed over up to 64 MB at a time, and the executor holds a batch several
    times outside its heap, for every task.
    """
    with _LOCK:
        before = spark.conf.get(_BATCH_BYTES)
        _LIMITED.append(before)
        if len(_LIMITED) == 1:
            spark.conf.set(_BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        with _LOCK:
            if len(_LIMITED) == 1:
                spark.conf.set(_BATCH_BYTES, _LIMITED[0])
                _LIMITED.clear()
            else:
                _LIMITED.pop()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    all tasks see the same disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
        current = context.getCheckpointDir()
    return current


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and runs the plan only once."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid4().hex}"
    blocks = any(isinstance(f.dataType, BinaryType) for f in df.schema)
    df.write.options(**(_BLOCK_FILES if blocks else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` for several readers: stored if its plan deals the rows of a join anew, else as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, label) if "SortMergeJoin" in plan or "ShuffledHashJoin" in plan else df
