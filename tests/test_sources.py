"""Readers, manifests and the run-log stream on files written by the tests."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.rules import pack_channels
from tallyframe.sources import records as S
from tallyframe.streaming.progress import latest_by_case, latest_progress, run_progress_stream
from tallyframe.operators.profiling import run_progress


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-tallyframe-test-", dir="/tmp"))


def test_case_scan_counts_reasons(spark, folder):
    channels = {"6": {"mean": 0.5, "p95": 0.9, "n_gt_0p7": 3}}
    item = {"label": 1, "name": "L1", "n_voxels": 10, "centroid_world_ras_mm": [1.0, 2.0, 3.0], "channels": channels}
    cases = {
        "a": {"case": "a", "status": "ok", "vertebrae": [item, item]},
        "b": {"case": "b", "status": "step1_no_landmark"},
        "c": {"case": "c", "status": "ok_step1_only", "vertebrae": []},
        "d": {"case": "d", "status": "ok", "vertebrae": [item]},
        "e": {"case": "e", "status": "ok", "vertebrae": [item]},
    }
    for name, body in cases.items():
        (folder / f"{name}.json").write_text(json.dumps(body))
    (folder / "broken.json").write_text("{not json")
    truth = spark.createDataFrame([("a", 3), ("e", 0)], "case string, n_truth int")
    used, skipped = S.scan_cases(S.read_cases(spark, str(folder)), truth)
    assert [r.case for r in used.collect()] == ["a"]
    assert {r.reason: r.n for r in skipped.collect()} == {
        "unreadable": 1, "step1_no_landmark": 1, "no_vertebrae": 1, "no_gt_mask": 1, "empty_gt": 1,
    }
    rows = S.explode_items(used).collect()
    assert len(rows) == 2 and rows[0].z == 3.0 and rows[0].channels[0].channel == 6


def test_landmarks_skip_direction_and_nan(spark, folder):
    text = '[{"direction": ["P", "I", "R"]}, {"label": 1, "X": 1.0, "Y": 2.0, "Z": 3.0}, {"label": 2, "X": NaN, "Y": 1.0, "Z": 1.0}]'
    (folder / "a_ctd.json").write_text(text)
    rows = S.read_landmarks(spark, str(folder)).collect()
    assert [(r.label, r.x, r.z) for r in rows] == [(1, 1.0, 3.0)]


def test_complete_sets_and_manifest(spark, folder):
    for name in ("s1_msk.gz", "s1_ctd.json", "s2_msk.gz"):
        (folder / name).write_bytes(name.encode())
    names = S.list_files(spark, str(folder)).select("name")
    found = S.complete_sets(names, "name", {"mask": "_msk.gz", "ctd": "_ctd.json"}, ["mask", "ctd"]).collect()
    assert [r.stem for r in found] == ["s1"]
    expected = spark.createDataFrame([("s1_msk.gz",), ("gone",)], "name string")
    rows = {r.name: r for r in S.manifest(spark, str(folder), expected).collect()}
    assert rows["gone"].missing and rows["s1_msk.gz"].size == 9
    out = tempfile.mkdtemp(prefix="spark-tallyframe-test-", dir="/tmp")
    S.write_manifest(S.manifest(spark, str(folder)), out, "r1")
    with pytest.raises(Exception, match="exists"):
        S.write_manifest(S.manifest(spark, str(folder)), out, "r1")


def test_stream_equals_batch(spark, folder):
    events = [("a", "running", 1.0, "2026-01-01T00:00:00Z"), ("a", "ok", 5.0, "2026-01-01T00:01:00Z"), ("b", "failed", 3.0, "2026-01-01T00:00:30Z")]
    df = spark.createDataFrame(events, "case string, status string, wall_seconds double, utc string")
    logs = str(folder / "logs")
    df.repartition(2).write.json(logs)
    out = str(folder / "out")
    run_progress_stream(spark, logs, out, str(folder / "cp"), 10).awaitTermination(120)
    batch = run_progress(latest_by_case(df), "case", "status", "wall_seconds", F.lit(10))
    assert sorted(latest_progress(spark, out).collect()) == sorted(batch.collect())
    more = spark.createDataFrame([("b", "ok", 4.0, "2026-01-01T00:05:00Z"), ("c", "ok", 1.0, "2026-01-01T00:06:00Z")], df.schema)
    more.write.mode("append").json(logs)
    run_progress_stream(spark, logs, out, str(folder / "cp"), 10).awaitTermination(120)
    batch = run_progress(latest_by_case(df.unionByName(more)), "case", "status", "wall_seconds", F.lit(10))
    assert sorted(latest_progress(spark, out).collect()) == sorted(batch.collect())


def test_pack_channels(spark):
    df = spark.createDataFrame([(1, 7, 0.1, 0.2, 3), (1, 6, 0.3, 0.4, 5)], "item int, channel int, mean double, p95 double, n_gt int")
    row = pack_channels(df, ["item"]).first()
    assert [c.channel for c in row.channels] == [6, 7]
