"""Case records, landmark lists, run logs, checker logs, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.ordered import small
from tallyframe.session import cut

CHANNEL = "struct<mean:double,median:double,p75:double,p95:double,max:double,min:double,std:double,n_gt_0p7:bigint>"
ITEM = (
    "struct<label:int,name:string,n_voxels:bigint,centroid_world_ras_mm:array<double>,"
    f"channels:map<string,{CHANNEL}>,"
    "mapping_free:struct<margin:double,entropy_inv:double,top1:double,agree:double,modal_channel:int>,"
    "raw_class_hist:map<string,bigint>,raw_class_modal:int>"
)
CASE = (
    "case string, status string, wall_seconds double, n_vertebrae int, timings_s map<string,double>,"
    f" vertebrae array<{ITEM}>, _corrupt_record string"
)
EVENT = "case string, status string, wall_seconds double, utc string"
LANDMARK = "array<struct<direction:array<string>,label:int,X:double,Y:double,Z:double>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case file; unreadable files are kept and marked."""
    return (
        spark.read.schema(CASE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("file", F.col("_metadata.file_name"))
        .withColumn("case", F.coalesce("case", F.regexp_replace("file", r"\.json$", "")))
    )


def scan_cases(cases: DataFrame, truth: DataFrame, masks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable cases, and the count of every reason the others were skipped.

    ``truth`` holds one row per case with its number of landmarks ``n_truth``.  Reasons follow the
    order of the checks: unreadable, the case's own status, no items, no reference, empty reference.
    """
    joined = cases.join(small(cut(truth.select("case", "n_truth"))), "case", "left")
    status = F.coalesce("status", F.lit("?"))
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
        .when(~status.startswith("ok"), status)
        .when(F.coalesce(F.size("vertebrae"), F.lit(0)) <= 0, "no_vertebrae")
        .when(F.col("n_truth").isNull(), "no_gt_mask")
        .when(F.col("n_truth") == 0, "empty_gt")
    )
    marked = joined.withColumn("reason", reason)
    used = marked.filter("reason IS NULL").drop("reason", "_corrupt_record", "n_truth")
    skipped = marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return used, skipped


def explode_items(cases: DataFrame) -> DataFrame:
    rows = cases.select("case", F.posexplode("vertebrae").alias("item", "v"))
    place = F.col("v.centroid_world_ras_mm")
    return rows.select(
        "case",
        "item",
        F.col("v.name").alias("name"),
        F.col("v.n_voxels").alias("n_cells"),
        F.get(place, F.lit(0)).alias("x"),
        F.get(place, F.lit(1)).alias("y"),
        F.get(place, F.lit(2)).alias("z"),
        F.col("v.mapping_free.entropy_inv").alias("entropy_inv"),
        F.transform(
            F.map_entries("v.channels"),
            lambda e: F.struct(
                e["key"].cast("int").alias("channel"),
                e["value"]["mean"].alias("mean"),
                e["value"]["p95"].alias("p95"),
                e["value"]["n_gt_0p7"].alias("n_gt"),
            ),
        ).alias("channels"),
    )


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Landmark lists: the direction entry is set aside, entries without numbers are skipped."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    clean = F.regexp_replace("value", r"\bNaN\b|\bnan\b", "null")
    rows = raw.select("file", F.explode(F.from_json(clean, LANDMARK)).alias("e"))
    known = F.col("e.label").isNotNull() & F.col("e.X").isNotNull() & F.col("e.Y").isNotNull() & F.col("e.Z").isNotNull()
    return rows.filter(F.col("e.direction").isNull() & known).select(
        "file", "e.label", F.col("e.X").alias("x"), F.col("e.Y").alias("y"), F.col("e.Z").alias("z")
    )


def complete_sets(names: DataFrame, name: str, suffixes: dict[str, str], required: list[str]) -> DataFrame:
    """Stems that have every required part, with the parts found."""
    kind, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for part, suffix in suffixes.items():
        hit = F.col(name).endswith(suffix)
        kind = F.when(hit, F.lit(part)).otherwise(kind)
        stem = F.when(hit, F.expr(f"left({name}, length({name}) - {len(suffix)})")).otherwise(stem)
    rows = names.select(stem.alias("stem"), kind.alias("kind"), F.col(name)).filter("kind IS NOT NULL")
    wide = rows.groupBy("stem").pivot("kind", list(suffixes)).agg(F.min(name))
    for part in required:
        wide = wide.filter(F.col(part).isNotNull())
    return wide


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File listing without contents: path, name, size, modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def read_checker_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one log per file, numbered inside the file; ``path`` tells files of one name apart."""
    raw = spark.read.text(path, wholetext=True)
    raw = raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    return raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"), "path")


def manifest(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """SHA-256 and size of every file; expected files that are absent are marked missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")
    )
    if expected is None:
        return found.withColumn("missing", F.lit(False))
    return expected.select("name").join(found, "name", "left").withColumn("missing", F.col("sha256").isNull())


def write_manifest(rows: DataFrame, path: str, run: str) -> None:
    """One manifest per run; an existing run is never overwritten."""
    rows.withColumn("run", F.lit(run)).write.mode("errorifexists").parquet(f"{path}/run={run}")


def incremental(inputs: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Inputs whose (name, size, mtime) key is not in the stored table yet."""
    return inputs.join(stored.select(*key).distinct(), key, "left_anti")


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """Small result tables as JSON lines."""
    rows.write.mode("overwrite").json(path)


