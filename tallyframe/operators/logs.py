"""Checker logs, findings and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, first_of, ratio
from tallyframe.functions.ordered import Grouped
from tallyframe.operators.sequences import log_sessions

# Line shapes of the checker, in the order they are tried.
MISSING = r"^Error - Missing attribute Type (\S+) \S+ Element=<([^>]+)> Module=<([^>]+)>"
OUTSIDE = r"^Warning - Attribute is not present in standard DICOM IOD - \((0x[0-9a-fA-F]{4},0x[0-9a-fA-F]{4})\) (\S+) (.+?)\s*$"
NAMED = r"^([A-Z][A-Za-z0-9]{3,})\s*$"
ERROR = r"^Error - (.+?)\s*$"
WARNING = r"^Warning - (.+?)\s*$"


def split_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines of every text with their 1-based number."""
    parts = F.split(F.col(text), "\n")
    return docs.select(*keys, F.posexplode(parts).alias("line_no", "line")).withColumn(
        "line_no", (F.col("line_no") + 1).cast("bigint")
    )


def classify(line: Column, shapes: list[tuple[str, str]]) -> Column:
    """Kind of the first matching shape; NULL when none matches."""
    return first_of([(line.rlike(pattern), kind) for kind, pattern in shapes])


def parse_checker(lines: DataFrame, source: str) -> DataFrame:
    """Typed findings of a checker log; only a file's first bare name is its recognised type.

    Later bare names fall through to the remaining shapes, which they do not match.
    """
    text = F.rtrim("line")
    rows = lines.withColumn("line", text).filter("line <> ''")
    kind = classify(
        F.col("line"),
        [("missing", MISSING), ("outside", OUTSIDE), ("type", NAMED), ("error", ERROR), ("warning", WARNING)],
    )
    rows = rows.withColumn("kind", kind).filter("kind IS NOT NULL")

    def part(pattern: str, at: int, of: str) -> Column:
        return F.when(F.col("kind") == of, F.regexp_extract("line", pattern, at))

    rows = rows.select(
        source,
        "line_no",
        "kind",
        part(MISSING, 1, "missing").alias("need"),
        part(MISSING, 2, "missing").alias("element"),
        part(MISSING, 3, "missing").alias("module"),
        F.lower(part(OUTSIDE, 1, "outside")).alias("tag"),
        part(OUTSIDE, 2, "outside").alias("vr"),
        F.coalesce(part(OUTSIDE, 3, "outside"), part(NAMED, 1, "type")).alias("name"),
        F.coalesce(part(ERROR, 1, "error"), part(WARNING, 1, "warning")).alias("message"),
    )
    first = rows.filter("kind = 'type'").groupBy(source).agg(F.min("line_no").alias("__first"))
    rows = Grouped(rows, [source]).join_stats(first, ["line_no"])
    return rows.filter((F.col("kind") != "type") | (F.col("line_no") == F.col("__first"))).drop("__first")


def files_affected(findings: DataFrame, source: str, finding: str, total: Column) -> DataFrame:
    """Distinct files per finding, never occurrences, and their share."""
    pairs = findings.select(source, finding).distinct()
    return (
        pairs.groupBy(finding)
        .agg(F.count(F.lit(1)).cast("bigint").alias("files"))
        .withColumn("of", total.cast("bigint"))
        .withColumn("share", ratio(F.col("files"), F.col("of")))
    )


def type_census(files: DataFrame, findings: DataFrame, source: str) -> DataFrame:
    """Recognised type per file, and how many of its files are clean (nothing missing, no error)."""
    per = findings.groupBy(source).agg(
        F.min(F.when(F.col("kind") == "type", F.col("name"))).alias("type"),
        F.bool_or(F.col("kind").isin("missing", "error")).alias("dirty"),
    )
    rows = files.select(source).join(per, source, "left")
    return rows.groupBy(F.coalesce("type", F.lit("(unrecognised)")).alias("type")).agg(
        F.count(F.lit(1)).cast("bigint").alias("files"), count_if(~F.coalesce("dirty", F.lit(False))).alias("clean")
    )


def checker_agreement(rows: DataFrame, ok1: Column, ok2: Column) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        count_if(ok1).alias("ok_first"),
        count_if(ok2).alias("ok_second"),
        count_if(ok1 != ok2).alias("disagree"),
    )


def finding_sets(rows: DataFrame, item: str, finding: str) -> DataFrame:
    """Objects per distinct set of findings (findings come from a fixed vocabulary)."""
    per = rows.groupBy(item).agg(F.array_join(F.array_sort(F.collect_set(finding)), ",").alias("finding_set"))
    return per.groupBy("finding_set").agg(F.count(F.lit(1)).cast("bigint").alias("objects"))


def funnel(rows: DataFrame, item: str, stages: dict[str, Column]) -> DataFrame:
    """Objects reaching each stage, of all."""
    per = rows.groupBy(item).agg(*[F.bool_or(c).alias(n) for n, c in stages.items()])
    counted = per.agg(F.count(F.lit(1)).alias("of"), *[F.count_if(n).alias(n) for n in stages])
    options = F.array(
        *[F.struct(F.lit(n).alias("stage"), F.col(n).cast("bigint").alias("reached"), F.col("of").cast("bigint").alias("of")) for n in stages]
    )
    return counted.select(F.explode(options).alias("__s")).select("__s.*")


def repair_ablation(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Objects passing under no repair, either one, or both: a defect fails unless it is repaired."""
    options = F.array(
        *[
            F.struct(F.lit(n).alias("repair"), ((a | F.lit(fix_a)) & (b | F.lit(fix_b))).alias("passes"))
            for n, fix_a, fix_b in (("none", False, False), ("a", True, False), ("b", False, True), ("both", True, True))
        ]
    )
    long = rows.select(F.explode(options).alias("__o")).select("__o.*")
    return long.groupBy("repair").agg(count_if(F.col("passes")).alias("n_pass"), F.count(F.lit(1)).cast("bigint").alias("of"))


def flag_census(sessions: DataFrame, n: str, penalties: str, top_z: str) -> DataFrame:
    """Sessions, penalties, the largest z with its bound sqrt(n-1), and sessions beyond their bound."""
    bound = F.sqrt(F.greatest(F.col(n) - 1, F.lit(1)).cast("double"))
    with_z = F.when(F.col(top_z).isNotNull(), F.struct(F.col(top_z).alias("z"), F.col(n).alias("n")))
    top = F.max(with_z)
    return sessions.agg(
        F.count(F.lit(1)).cast("bigint").alias("sessions"),
        count_if(F.col(penalties) > 0).alias("sessions_with_penalty"),
        F.sum(n).cast("bigint").alias("items"),
        F.sum(penalties).cast("bigint").alias("n_penalties"),
        F.max(top_z).alias("max_z"),
        top["n"].cast("bigint").alias("max_z_n"),
        F.when(top["n"] >= 1, F.round(F.sqrt((top["n"] - 1).cast("double")), 4)).alias("max_z_bound"),
        count_if(F.col(top_z) > bound + 1e-9).alias("over_bound"),
    )


def line_overlap(a: DataFrame, b: DataFrame, source: str, line: str, longer_than: int = 25) -> DataFrame:
    """Share of the substantive lines of each file of A that also occur in B, and in total."""
    def substantive(df):
        return df.withColumn(line, F.trim(line)).filter(F.length(line) > longer_than)

    known = substantive(b).select(line).distinct().withColumn("__hit", F.lit(1))
    # distinct lines first, so a line copied a million times is looked up once
    ours = substantive(a).groupBy(line, source).agg(F.count(F.lit(1)).alias("c"))
    looked = ours.join(known, line, "left")
    out = looked.groupingSets([[], [F.col(source)]], source).agg(
        F.grouping_id().alias("grain"),
        F.sum("c").cast("bigint").alias("lines"),
        F.sum(F.when(F.col("__hit").isNotNull(), F.col("c")).otherwise(0)).cast("bigint").alias("shared"),
    )
    return out.withColumn("share", ratio(F.col("shared"), F.col("lines")))


def subset_violations(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of `part` missing from `whole`."""
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), keys, "left_anti")




# Line shapes of the emitter's log.
PATIENT = r"Processing patient: pat_(\S+)"
EXTRACTED = r"Extracted confidence for (\d+) vertebrae"
SMALL_BOX = r"Excluded small box: vertebrae_(\S+)"
PENALTY = r"Penalty for (\S+): z-score=([\d.]+)"
# What the second checker's lines hold.
AFFECTED = r"Affected attribute:\s*(.*?)\s*$"
STATE_WARNING = r"^W: (.*(?:presentation state|instanceNumber).*?)\s*$"


def emitter_sessions(lines: DataFrame, source: str) -> DataFrame:
    """One row per source and patient: count extracted (the last one counts), small boxes, penalties (last per label).

    Lines before a source's first patient say nothing; a patient named again goes on where it was.
    """

    def part(pattern: str, at: int = 1) -> Column:
        return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, at))

    tagged = log_sessions(lines, [source], ["line_no"], part(PATIENT))
    label = part(PENALTY)
    marked = tagged.select(
        source, "session", "line_no", part(EXTRACTED).cast("bigint").alias("extracted"), part(SMALL_BOX).alias("small"),
        label.alias("label"), part(PENALTY, 2).cast("double").alias("z"),
    )
    last = marked.filter("label IS NOT NULL").groupBy(source, "session", "label").agg(F.max_by("z", "line_no").alias("z"))
    penalties = last.groupBy(source, "session").agg(
        F.count(F.lit(1)).alias("n_penalties"), F.max("z").alias("top_z"), F.map_from_entries(F.collect_list(F.struct("label", "z"))).alias("penalties")
    )  # as many entries as there are labels
    seen = marked.groupBy(source, "session").agg(
        F.max_by("extracted", F.when(F.col("extracted").isNotNull(), F.col("line_no"))).alias("extracted"),
        F.array_sort(F.collect_set("small")).alias("small_boxes"),
    )
    return seen.join(penalties, [source, "session"], "left").fillna({"n_penalties": 0})


def parse_second_checker(lines: DataFrame, source: str) -> DataFrame:
    """(source, verdict, named): PASS, FAIL or ?, and every attribute or presentation-state message it names, once."""
    named = F.when(F.col("line").rlike(AFFECTED), F.regexp_extract("line", AFFECTED, 1)).otherwise(
        F.when(F.col("line").rlike(STATE_WARNING), F.regexp_extract("line", STATE_WARNING, 1))
    )
    passed, failed = (F.bool_or(F.contains(F.col("line"), F.lit(x))) for x in ("Test passed", "Test failed"))
    return lines.groupBy(source).agg(
        F.when(passed, "PASS").when(failed, "FAIL").otherwise("?").alias("verdict"),
        F.array_sort(F.collect_set(named)).alias("named"),
    )


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two tables, or that one of them lacks."""
    left = a.select(*keys, F.col(value).alias("in_a"))
    both = left.join(b.select(*keys, F.col(value).alias("in_b")), keys, "full_outer")
    return both.filter(~F.col("in_a").eqNullSafe(F.col("in_b")))
