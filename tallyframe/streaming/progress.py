"""Following an append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.profiling import run_progress
from tallyframe.sources.records import EVENT


def latest_by_case(events: DataFrame) -> DataFrame:
    """Newest status and longest wall time per case: one aggregate, so repeats do no harm."""
    return events.groupBy("case").agg(
        F.max_by("status", F.struct("utc", "status")).alias("status"), F.max("wall_seconds").alias("wall_seconds")
    )


def newest(spark: SparkSession, folder: str, below: int | None = None) -> str | None:
    """The finished batch folder with the highest number (below ``below``)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    done = [s.getPath() for s in files.listStatus(where)]
    done = [p.toString() for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    done = [p for p in done if below is None or int(p.rsplit("/", 1)[1]) < below]
    return max(done, default=None)


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """The progress table of the newest finished batch."""
    return spark.read.parquet(newest(spark, f"{out}/progress"))


def run_progress_stream(spark: SparkSession, path: str, out: str, checkpoint: str, total: int):
    """Read new log files and publish the progress table after each batch.

    Batches bring the cases that changed (update mode). The table of latest states is written under the batch's number
    from the one before it and the changes; a batch that is run again writes the same folder again, and readers use
    ``latest_progress``, which takes the newest finished one.
    """
    events = spark.readStream.schema(EVENT).json(path)

    def publish(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/changes/{epoch:012d}")  # the only pass over the batch
        rows = changed = here.read.parquet(f"{out}/changes/{epoch:012d}")
        before = newest(here, f"{out}/cases", epoch)
        if before is not None:
            rows = here.read.parquet(before).join(changed, "case", "left_anti").unionByName(changed)
        rows.write.mode("overwrite").parquet(f"{out}/cases/{epoch:012d}")
        shown = run_progress(here.read.parquet(f"{out}/cases/{epoch:012d}"), "case", "status", "wall_seconds", F.lit(total))
        shown.write.mode("overwrite").parquet(f"{out}/progress/{epoch:012d}")

    return (
        latest_by_case(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
