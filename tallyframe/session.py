"""Session helpers: settings the operators read, and the checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task may sort; larger groups are cut into pieces.
GROUP_ROWS = ("spark.tallyframe.groupRows", 1_000_000)
# Bytes of a written table, as stored, that may be broadcast. Other tables are left to the adaptive planner.
BROADCAST_BYTES = ("spark.tallyframe.broadcastBytes", 8 << 20)
# Entries of a table that a driver-side step may hold.
BROADCAST_ROWS = ("spark.tallyframe.broadcastRows", 500_000)


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    name, default = entry
    return int(spark.conf.get(name, str(default)))


def prepare(spark: SparkSession) -> SparkSession:
    """Make sure checkpoints have a home; no setting of the session is changed."""
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not ctx.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-tallyframe-", dir="/tmp")
        ctx.setCheckpointDir(folder)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is left there goes when Python ends."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tallyframe-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone with its folder
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone that date functions depend on, once, where a session is started."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write an expensive intermediate once, as Parquet in the shared folder, and read it back from there.

    Columns can be pruned and sizes are known; ``stored_bytes`` tells how much was written.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_bytes = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return out


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of a table that ``cut`` wrote; None for any other table."""
    return getattr(df, "_stored_bytes", None)


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    """The session used by tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
