"""Operators against small fixed tables, brute force and published arithmetic."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.ordered import Grouped
from tallyframe.functions.draws import drawn
from tallyframe.operators import ceilings as C
from tallyframe.operators import curves as K
from tallyframe.operators import detection as D
from tallyframe.operators import logs as L
from tallyframe.operators import matching as M
from tallyframe.operators import profiling as P
from tallyframe.operators import reductions as A
from tallyframe.operators import replicates as E
from tallyframe.operators import resampling as B
from tallyframe.operators import rules as R


def pairwise(score, wrong):
    pos, neg = score[wrong], score[~wrong]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] < neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame(
        {
            "cluster": [f"c{i}" for i in np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))],
            "score": np.round(rng.random(n), 1),
            "wrong": rng.random(n) < 0.3,
            "rule": np.where(rng.random(n) < 0.5, "a", "b"),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_auc_is_pairwise_with_ties_and_in_pieces(spark, scored, tiny_groups):
    pdf, df = scored
    got = {r.rule: r.auc for r in D.auc(df, ["rule"]).collect()}
    for rule, part in pdf.groupby("rule"):
        assert got[rule] == pytest.approx(pairwise(part.score.to_numpy(), part.wrong.to_numpy()))


def test_auc_drops_undefined_and_needs_both_classes(spark):
    rows = [("x", 0.1, True), ("x", None, True), ("x", 0.9, False), ("x", 0.4, False), ("x", float("nan"), False), ("y", 0.2, True)]
    df = spark.createDataFrame(rows, "rule string, score double, wrong boolean")
    got = {r.rule: r.auc for r in D.auc(df, ["rule"]).collect()}
    assert got == {"x": 1.0, "y": None}


def test_hanley_mcneil_published(spark):
    df = spark.createDataFrame([(0.5159628526, 373, 1472)], "auc double, n_wrong bigint, n_right bigint")
    row = D.hanley_mcneil(df).first()
    assert row.lo == pytest.approx(0.4829686561, abs=1e-8)
    assert row.hi == pytest.approx(0.5489570491, abs=1e-8)


def test_flag_rates_published(spark):
    df = spark.range(1845).select((F.col("id") < 373).alias("w"), ((F.col("id") < 33) | (F.col("id") >= 1770)).alias("f"))
    row = D.flag_metrics(df, [], F.col("f"), F.col("w"), F.lit(True)).first()
    assert (row.n_flag, row.n_hit, row.n_rest) == (108, 33, 1397)
    assert row.sensitivity == pytest.approx(33 / 373)
    assert row.ppv == pytest.approx(33 / 108)
    assert row.npv == pytest.approx(1397 / 1737)


def test_monte_carlo_never_zero(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") / 1e6).alias("v"))
    assert B.monte_carlo(df, ["k"], "v", F.lit(0.5)).first().monte_carlo_p == pytest.approx(1 / 1001)


def weighted_area(score, p, n):
    """AUC of weighted rows, ties half, by definition."""
    order = np.unique(score)
    wp, wn = (np.array([w[score == v].sum() for v in order]) for w in (p, n))
    before = np.cumsum(wp) - wp
    pairs = wp.sum() * wn.sum()
    return (wn * (before + 0.5 * wp)).sum() / pairs if pairs else None


@pytest.fixture
def tied():
    """Three scores only, so every score lies in many ranges."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"rule": np.where(rng.random(3000) < 0.9, "a", "b"), "cluster": rng.integers(0, 200, 3000), "score": rng.integers(0, 3, 3000) / 2})
    pdf["wrong"] = rng.random(3000) < 0.3 - 0.1 * pdf.score
    return pdf


@pytest.mark.parametrize("work", [2000, 8_000_000])
@pytest.mark.parametrize("kind", ["draws", "halves"])
def test_replicates_with_ties_across_ranges(spark, tied, monkeypatch, work, kind):
    monkeypatch.setattr(E, "WORK", work)
    clusters = np.unique(tied.cluster)
    weigher = E.Draws(len(clusters), 70, 5) if kind == "draws" else E.Halves(len(clusters), 6, 5)
    idx = np.searchsorted(clusters, tied.cluster)
    rows = tied.assign(idx=idx, p=tied.wrong.astype(int), n=(~tied.wrong).astype(int))
    df = spark.createDataFrame(rows[["rule", "score", "idx", "p", "n"]])
    got = {(r.rule, r.rep): r.auc for r in E.replicate_auc(df, ["rule"], weigher).collect()}
    assert len(got) == 2 * weigher.columns
    for (rule, rep), area in got.items():
        w, mine = weigher.column(rep)[idx], (tied.rule == rule).to_numpy()
        assert area == pytest.approx(weighted_area(tied.score[mine].to_numpy(), (w * rows.p)[mine].to_numpy(), (w * rows.n)[mine].to_numpy()), abs=1e-12)


def test_halves_are_halves():
    halves = E.Halves(11, 8, 2)
    for split in range(4):
        one, two = halves.column(2 * split), halves.column(2 * split + 1)
        assert one.sum() == 5 and (one + two == 1).all()


def test_drawn_numbers_never_tie():
    for seed, rep in ((1, 0), (7, 1999), (31, 5)):
        numbers = drawn(seed, rep, np.arange(200_000))
        assert len(np.unique(numbers)) == 200_000 and 0 <= numbers.min() and numbers.max() < 2147483647
        assert abs((numbers % 10).mean() - 4.5) < 0.05 and abs(np.corrcoef(numbers[1:], numbers[:-1])[0, 1]) < 0.02


def test_bootstrap_matches_resampled_rows(spark, scored):
    pdf, df = scored
    clusters = sorted(set(pdf.cluster))
    got = {(r.rule, r.rep): r.auc for r in B.bootstrap_auc(df, "cluster", ["rule"], 4, 9).collect()}
    for rep in range(4):
        picked = [clusters[i] for i in drawn(9, rep, np.arange(len(clusters))) % len(clusters)]
        rows = pd.concat([pdf[pdf.cluster == c] for c in picked])
        for rule, part in rows.groupby("rule"):
            assert got[rule, rep] == pytest.approx(pairwise(part.score.to_numpy(), part.wrong.to_numpy()))


def test_bootstrap_rate_by_hand(spark, scored):
    pdf, df = scored
    clusters = sorted(set(pdf.cluster))
    per = pdf.assign(hit=pdf.wrong & (pdf.score > 0.5)).groupby("cluster").agg(num=("hit", "sum"), den=("wrong", "sum")).loc[clusters]
    rates = []
    for rep in range(300):
        w = np.bincount(drawn(4, rep, np.arange(len(clusters))) % len(clusters), minlength=len(clusters))
        if (w * per.den).sum():
            rates.append((w * per.num).sum() / (w * per.den).sum())
    row = B.bootstrap_rate(df, "cluster", [], F.col("score") > 0.5, F.col("wrong"), 300, 4).first()
    assert (row.lo, row.hi, row.reps) == (pytest.approx(np.percentile(rates, 2.5)), pytest.approx(np.percentile(rates, 97.5)), len(rates))


def bits(mask, reps):
    return np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")[:reps].astype(bool)


@pytest.mark.parametrize("limit", ["7", "1000000"])
def test_masks_hold_the_smallest_draws(spark, limit):
    """Oversized groups (NULL among them) and small ones, one without errors and one with nothing else."""
    rng = np.random.default_rng(2)
    rows = [(i, [None, "x", "y", "z", "none", "all"][min(5, int(rng.integers(0, 9)))], bool(rng.random() < 0.3)) for i in range(150)]
    rows = [(1000 - i, g, {"none": False, "all": True}.get(g, w)) for i, g, w in rows] + [(5000, "x", None)]
    df = spark.createDataFrame(rows, "id bigint, g string, wrong boolean")
    spark.conf.set("spark.tallyframe.groupRows", limit)
    try:
        found = {r.id: (r.g, bits(r.mask, 70)) for r in B.permuted_masks(df, ["g"], "id", "wrong", 70, 6).collect()}
        free = {r.id: bits(r.mask, 5) for r in B.permuted_masks(df, [], "id", "wrong", 5, 6).collect()}
    finally:
        spark.conf.unset("spark.tallyframe.groupRows")
    known = sorted(r for r in rows if r[2] is not None)
    assert sorted(found) == sorted(free) == [r[0] for r in known]
    place = {r[0]: j for j, r in enumerate(known)}
    for name in {r[1] for r in known}:
        mine = [r for r in known if r[1] == name]
        errors = sum(r[2] for r in mine)
        for rep in (0, 1, 64, 69):
            numbers = drawn(6, rep, np.array([place[r[0]] for r in mine]))
            want = {mine[i][0] for i in np.argsort(numbers)[:errors]}
            assert {r[0] for r in mine if found[r[0]][1][rep]} == want and all(found[r[0]][0] == name for r in mine)
    for rep in range(5):
        assert sum(m[rep] for m in free.values()) == sum(r[2] for r in known)


@pytest.mark.parametrize("work", [3000, 8_000_000])
def test_permuted_labels_in_halves(spark, tied, monkeypatch, work):
    monkeypatch.setattr(E, "WORK", work)
    rows = tied.assign(id=np.arange(len(tied)))
    clusters = np.unique(rows.cluster)
    rows["idx"] = np.searchsorted(clusters, rows.cluster)
    masks = B.permuted_masks(spark.createDataFrame(rows[["id", "rule", "wrong"]]), ["rule"], "id", "wrong", 9, 3)
    held = {r.id: bits(r.mask, 9) for r in masks.collect()}
    wrong = np.stack([held[i] for i in rows.id])
    halves = E.Halves(len(clusters), 4, 1)
    df = spark.createDataFrame(rows[["id", "rule", "score", "idx"]]).join(masks.select("id", "mask"), "id")
    plain = {(r.rule, r.rep): r.auc for r in E.replicate_auc(df, ["rule"], E.Labels(9)).collect()}
    both = {(r.rule, r.rep): r.auc for r in E.replicate_auc(df, ["rule"], E.LabelsInHalves(9, halves)).collect()}
    for rule in ("a", "b"):
        mine = (rows.rule == rule).to_numpy()
        score = rows.score[mine].to_numpy()
        for rep in range(9):
            p = wrong[mine, rep].astype(float)
            assert plain[rule, rep] == pytest.approx(weighted_area(score, p, 1 - p), abs=1e-12)
            for fold in range(4):
                w = halves.column(fold)[rows.idx[mine]]
                assert both[rule, rep * 4 + fold] == pytest.approx(weighted_area(score, w * p, w * (1 - p)), abs=1e-12)


def test_permutation_keeps_group_totals(spark, scored, tiny_groups):
    pdf, df = scored
    df = df.withColumn("id", F.monotonically_increasing_id())
    out = B.permute_within(df, ["cluster"], "id", "wrong", 3, 4)
    totals = out.groupBy("rep", "cluster").agg(F.count_if("wrong").alias("w")).collect()
    want = pdf.groupby("cluster").wrong.sum()
    assert len(totals) == 3 * len(want)
    assert all(r.w == want[r.cluster] for r in totals)


@pytest.mark.parametrize("leaf", [64, 3])
def test_nearest_is_brute_force(spark, leaf, monkeypatch):
    monkeypatch.setattr(M, "LEAF", leaf)
    monkeypatch.setattr(M, "WHOLE", leaf)
    rng = np.random.default_rng(1)
    ref = pd.DataFrame(rng.random((120, 3)).round(2), columns=["x", "y", "z"])
    ref.loc[:40, ["x", "y", "z"]] = 0.5  # copies of one place
    ref["b"], ref["label"] = np.where(rng.random(120) < 0.8, 0, 1), np.arange(120) % 17
    pred = pd.DataFrame(rng.random((60, 3)).round(2) * 2 - 0.5, columns=["x", "y", "z"])
    pred.loc[:15, ["x", "y", "z"]] = 0.5
    pred["b"], pred["id"] = np.arange(60) % 2, np.arange(60)
    for within in (None, 0.3):
        out = M.nearest(spark.createDataFrame(pred), spark.createDataFrame(ref), ["b"], ["x", "y", "z"], "label", within)
        rows = out.collect()
        assert len(rows) == 60
        for r in rows:
            part = ref[ref.b == r.b]
            d = np.sqrt(((part[["x", "y", "z"]].to_numpy() - [r.x, r.y, r.z]) ** 2).sum(axis=1))
            best = min(zip(d, part.label))
            if within is not None and best[0] > within:
                assert r.nearest is None
            else:
                assert r.dist == pytest.approx(best[0])
                assert r.nearest == best[1]


def test_nearest_reads_predictions_once(spark):
    """Places that come out otherwise each time they are worked out, as averages may on executors, are still found."""

    def anew(batches):
        for pdf in batches:
            yield pdf.assign(x=np.random.default_rng().random(len(pdf)))

    pred = spark.range(0, 40, 1, 2).selectExpr("cast(id % 3 as int) as b", "id", "0D as x").mapInPandas(anew, "b int, id long, x double")
    ref = spark.createDataFrame([(b, i / 10, i) for b in range(3) for i in range(10)], "b int, x double, label int")
    rows = M.nearest(pred, ref, ["b"], ["x"], "label").collect()
    assert len(rows) == 40
    for r in rows:
        assert (r.dist, r.nearest) == min((abs(r.x - i / 10), i) for i in range(10))


def test_nearest_keeps_the_number_of_its_tasks(spark):
    """Few bytes and much work a row: what the walk starts from is dealt into a fixed number of partitions."""
    rows = [(0, float(i % 37), float(i % 101), i) for i in range(700)]
    points = spark.createDataFrame(rows, "b int, x double, y double, label int")
    out = M.nearest(points.drop("label"), points, ["b"], ["x", "y"], "label")
    assert all(r.dist == 0 for r in out.collect())
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


def test_nearest_looks_into_the_nearest_leaf_before_the_others(spark, monkeypatch):
    """Leaves that are farther than the best point of the first one are dropped before their points are met."""
    rng = np.random.default_rng(12)
    rows = [(0, *map(float, p), i) for i, p in enumerate(rng.random((3000, 2)))]
    points = spark.createDataFrame(rows, "b int, x double, y double, label int")
    asked = spark.createDataFrame([(0, *map(float, p)) for p in rng.random((200, 2))], "b int, x double, y double")
    left, cut = [], M.cut

    def seen(df):
        out = cut(df)
        if "__rest" in df.columns:
            left.extend(r.n for r in out.select(F.size("__rest").alias("n")).collect())
        return out

    monkeypatch.setattr(M, "cut", seen)
    places = np.array([r[1:3] for r in rows])
    for r in M.nearest(asked, points, ["b"], ["x", "y"], "label").collect():
        gaps = np.sqrt(((places - [r.x, r.y]) ** 2).sum(axis=1))
        assert r.nearest == gaps.argmin() and r.dist == pytest.approx(gaps.min(), abs=1e-15)
    assert len(left) == 200 and sum(left) < 3 * 200


def _brute_nearest(pred, ref, axes):
    out = {}
    for q in pred.itertuples():
        part = ref[(ref.b == q.b) & np.isfinite(ref[axes].to_numpy(float)).all(axis=1)]
        place = np.array([getattr(q, a) for a in axes], float)
        if len(part) and np.isfinite(place).all():
            out[q.id] = min(zip(np.sqrt(((part[axes].to_numpy(float) - place) ** 2).sum(axis=1)), part.label))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 50])
@pytest.mark.parametrize("axes", [["x", "y", "z"], ["x"]])
def test_nearest_with_far_outliers_and_missing_places(spark, axes, limit, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 4)
    monkeypatch.setattr(M, "WHOLE", 4)
    rng = np.random.default_rng(5)
    ref = pd.DataFrame(rng.normal(0, 1e-6, (500, 3)), columns=["x", "y", "z"])
    ref.loc[0, "x"], ref.loc[1, "y"] = 1e300, -1e12  # nearly all points lie in a speck beside these
    ref.loc[2, "x"], ref.loc[3, "x"], ref.loc[4, "x"] = np.nan, np.inf, -np.inf
    ref["b"], ref["label"] = np.where(np.arange(500) < 460, 0, 1 + np.arange(500) % 15), np.arange(500)
    pred = pd.DataFrame(rng.normal(0, 2e-6, (80, 3)), columns=["x", "y", "z"])
    pred.loc[0, "x"], pred.loc[1, "x"], pred.loc[2, "x"] = 1e12, np.nan, np.inf
    pred["b"], pred["id"] = np.arange(80) % 2 * np.arange(80) % 20, np.arange(80)
    spark.conf.set("spark.tallyframe.groupRows", str(limit))
    try:
        rows = M.nearest(spark.createDataFrame(pred), spark.createDataFrame(ref), ["b"], axes, "label").collect()
    finally:
        spark.conf.unset("spark.tallyframe.groupRows")
    want = _brute_nearest(pred, ref, axes)
    assert len(rows) == 80 and len(want) < 80
    for r in rows:
        assert (r.dist, r.nearest) == ((None, None) if r.id not in want else (pytest.approx(want[r.id][0], rel=1e-12), want[r.id][1]))


def test_leaves_are_never_overfull_and_height_follows_the_count(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 4)
    monkeypatch.setattr(M, "WHOLE", 4)
    rows = [(0, 10.0 ** (i % 300), float(i), i) for i in range(257)] + [(1, 0.0, float(i), i) for i in range(4)]
    points = spark.createDataFrame(rows, "b int, x double, y double, nearest int")
    leaves, levels, crowded = M._tree(points, ["b"], ["x", "y"])
    sizes = leaves.select("b", F.size("__points").alias("n")).collect()
    assert max(r.n for r in sizes) == 4 and sum(r.n for r in sizes) == 261
    assert len(sizes) == 65 + 1 and [r.b for r in crowded.collect()] == [0]
    assert [level.count() for level in levels] == [17, 5, 2, 1]


def test_identification_direction_and_tolerance(spark):
    schema = "cluster string, label int, x double, y double, z double"
    truth = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 10.0, 0.0, 0.0), ("a", 3, 100.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0), ("c", 1, 0.0, 0.0, 0.0)], schema)
    pred = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 0.5, 0.0, 0.0), ("a", 3, 100.0, 0.0, 0.0), ("b", 1, 20.0, 0.0, 0.0)], schema)
    hits = {(r.cluster, r.label): r.hit for r in M.identification_hits(truth, pred, ["cluster"], ["x", "y", "z"], "label").collect()}
    assert hits == {("a", 1): 1, ("a", 2): 0, ("a", 3): 1, ("b", 1): 1, ("c", 1): 0}


def test_match_boundary_is_inside(spark):
    schema = "cluster string, category string, x double, y double, z double"
    truth = spark.createDataFrame([("a", "L1", 0.0, 0.0, 0.0)], schema)
    pred = spark.createDataFrame([("a", "L2", 20.0, 0.0, 0.0), ("a", "L1", 20.5, 0.0, 0.0)], schema)
    rows = {r.category: r for r in M.match(pred, truth, ["cluster"], ["x", "y", "z"], "category", "category", 20.0).collect()}
    assert rows["L2"].matched and rows["L2"].wrong
    assert not rows["L1"].matched and rows["L1"].wrong is None and rows["L1"].dist == 20.5


def test_dice_known_answers(spark):
    schema = "c int, x int, label int"
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], schema)
    b = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1)], schema)
    fore, per = A.dice(a, b, ["c"], ["x"], "label")
    assert {r.c: r.dice_fg for r in fore.collect()} == {1: 1.0, 2: 0.0}
    assert {(r.c, r.label): r.dice for r in per.collect()} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0}


def test_dice_of_empty_masks_is_one(spark):
    a = spark.createDataFrame([(1, 1, None), (2, 1, 1)], "c int, x int, label int")
    fore, per = A.dice(a, a.filter("c = 2"), ["c"], ["x"], "label")
    assert {r.c: r.dice_fg for r in fore.collect()} == {1: 1.0, 2: 1.0}
    assert [(r.c, r.dice) for r in per.collect()] == [(2, 1.0)]


@pytest.mark.parametrize("limit", ["2", "1000"])
def test_pooling_over_cases(spark, limit):
    """Means and medians over cases beside the pooled figures; undefined values skipped, a case of masks alone counted."""
    nan = float("nan")
    hits = [("a", 1, 1, 2.0), ("a", 2, 0, None), ("a", 3, 1, 6.0), ("b", 1, 0, 9.0), ("b", 2, 0, nan), (None, 1, 1, 1.0), ("c", 3, 0, None)]
    fore = [("a", 0.5), ("b", 1.0), (None, 0.25), ("c", 0.75), ("d", 0.0)]
    per = [("a", 1, 0.5), ("a", 2, 0.0), ("b", 1, 1.0), (None, 1, 0.5), ("c", 3, 0.0)]
    spark.conf.set("spark.tallyframe.groupRows", limit)
    try:
        out = A.pooled_rates(
            spark.createDataFrame(hits, "case string, level int, hit int, dist double"),
            spark.createDataFrame(fore, "case string, dice_fg double"),
            spark.createDataFrame(per, "case string, level int, dice double"),
            "case",
            "level",
        ).collect()
    finally:
        spark.conf.unset("spark.tallyframe.groupRows")
    whole = next(r for r in out if r.grain == 3)
    rates, overlaps, labels = [2 / 3, 0.0, 1.0, 0.0], [0.5, 1.0, 0.25, 0.75, 0.0], [0.25, 1.0, 0.5, 0.0]
    want = {
        "n": 7, "hits": 3, "rate": 3 / 7, "mean_dist": 18 / 4, "n_cases": 5,
        "mean_rate": np.mean(rates), "median_rate": np.median(rates), "mean_case_dist": np.mean([4.0, 9.0, 1.0]),
        "dice_fg": np.mean(overlaps), "median_dice_fg": np.median(overlaps), "dice_label": np.mean(labels), "median_dice_label": np.median(labels),
    }
    assert {c: whole[c] for c in want} == pytest.approx(want)
    cases = {r.case: (r.n, r.hits, r.rate, r.mean_dist, r.dice_fg, r.dice_label) for r in out if r.grain == 1}
    assert cases == {
        "a": (3, 2, 2 / 3, 4.0, 0.5, 0.25), "b": (2, 0, 0.0, 9.0, 1.0, 1.0), None: (1, 1, 1.0, 1.0, 0.25, 0.5),
        "c": (1, 0, 0.0, None, 0.75, 0.0), "d": (0, 0, None, None, 0.0, None),
    }
    levels = {r.level: (r.n, r.hits, r.rate, r.mean_dist, r.n_cases) for r in out if r.grain == 2}
    assert levels == {1: (3, 2, 2 / 3, 4.0, None), 2: (2, 0, 0.0, None, None), 3: (2, 1, 0.5, 6.0, None)}


def test_rule_channels(spark):
    names = ["C1", "C7", "T1", "T12", "L1", "L5", "SACRUM", "T13", "L6", "COCCYX", "S2"]
    df = spark.createDataFrame([(n,) for n in names], "category string")
    name = F.col("category")
    rows = {
        r.category: tuple(r)[1:]
        for r in df.select("category", R.channel_by_region(name), R.channel_by_name(name), R.channel_by_number(name)).collect()
    }
    assert rows["C1"] == (6, 6, 6)
    assert rows["C7"] == (6, 6, 6)
    assert rows["T1"] == (7, 7, 6)
    assert rows["L1"][0] == 8 and rows["SACRUM"] == (9, 8, 8)
    assert rows["T13"] == (7, None, 6) and rows["L6"] == (8, None, 7)
    assert rows["COCCYX"] == (6, None, None)


def test_normalise(spark):
    raw = [" vertebrae_L1", "Vertebrae-t12 ", "sacrum", "S2", "vertebraeC3", "Sx"]
    df = spark.createDataFrame([(n,) for n in raw], "n string")
    assert [r[0] for r in df.select(R.normalise_category(F.col("n"))).collect()] == ["L1", "T12", "SACRUM", "S2", "C3", "SACRUM"]


def test_best_mapping_not_below_fixed(spark):
    rng = np.random.default_rng(0)
    rows = []
    for cluster in range(20):
        for cat in range(6):
            wrong = bool(rng.random() < 0.3)
            for channel in range(4):
                signal = (0.6 if channel == cat % 4 else 0.0) * (not wrong)
                rows.append((0, f"c{cat}", channel, float(np.round(signal + rng.random(), 3)), wrong))
    df = spark.createDataFrame(rows, "rep int, category string, channel int, score double, wrong boolean")
    fixed = C.best_fixed_channel(df, ["rep"]).first().auc
    found = C.best_mapping(df, ["rep"])
    exact = C.mapping_auc(df, found, ["rep"]).first().auc
    assert found.first().search_auc == pytest.approx(exact)
    assert exact >= fixed - 1e-12


def slow_climb(m, wrong, level, channels, sweeps=8):
    """The search evaluated from scratch at every step."""
    best = (-1.0, None)
    for start in range(channels):
        assign = {lv: start for lv in sorted(set(level))}

        def area():
            score = np.array([m[i, assign[lv]] for i, lv in enumerate(level)])
            return pairwise(score, wrong)

        now = area()
        for _ in range(sweeps):
            moved = False
            for lv in assign:
                keep = assign[lv]
                for j in range(channels):
                    if j == keep:
                        continue
                    assign[lv] = j
                    a = area()
                    if a > now + 1e-12:
                        now, keep, moved = a, j, True
                assign[lv] = keep
            if not moved:
                break
        if now > best[0]:
            best = (now, dict(assign))
    return best


def test_mapping_search_is_the_slow_search(spark):
    rng = np.random.default_rng(8)
    n, channels = 90, 3
    level = np.array([f"v{i}" for i in rng.integers(0, 5, n)])
    wrong = rng.random(n) < 0.35
    m = np.round(rng.random((n, channels)), 2)
    area, mapping = slow_climb(m, wrong, level, channels)
    rows = [(0, i, level[i], j, float(m[i, j]), bool(wrong[i])) for i in range(n) for j in range(channels)]
    df = spark.createDataFrame(rows, "rep int, id int, category string, channel int, score double, wrong boolean")
    found = C.best_mapping(df, ["rep"]).collect()
    assert found[0].search_auc == pytest.approx(area, abs=1e-12)
    assert {r.category: r.channel for r in found} == mapping
    # labels that permuting cannot change: one group per row
    masks = B.permuted_masks(df.select("id", F.col("id").alias("g"), "wrong").distinct(), ["g"], "id", "wrong", 3, 1)
    assert all(r.auc == pytest.approx(area, abs=1e-12) for r in C.mapping_null(df.drop("rep", "wrong"), masks.select("id", "mask"), "id", 3).collect())


def brute_residuals(points, degree):
    """Straight reading of the definition with NumPy, one cluster of (ord, region, x, y)."""

    def dist(fit, p):
        fit = np.asarray(fit)
        if len(fit) < 4:
            return math.nan
        t = np.r_[0, np.cumsum(np.hypot(*np.diff(fit, axis=0).T))]
        t, k = t / t[-1], min(degree, len(fit) - 1)
        g = np.linspace(0, 1, 1000)
        cx, cy = (np.polyval(np.polyfit(t, fit[:, i], k), g) for i in (0, 1))
        return float(np.min(np.hypot(cx - p[0], cy - p[1])))

    out = {}
    whole = [p[2:] for p in points]
    for o, region, x, y in points:
        if region is None:
            continue
        members = [p[2:] for p in points if p[1] == region]
        base = members if len(members) >= 4 else whole
        out[o] = (dist(base, (x, y)), dist([p for p in base if p != (x, y)], (x, y)))
    return out


@pytest.mark.parametrize("degree", [1, 3])
def test_curve_residuals(spark, degree):
    rng = np.random.default_rng(2)
    rows, clusters = [], {}
    for c in range(12):
        n = int(rng.integers(2, 14))
        pts = []
        for o in range(n):
            region = None if o == 9 else "A" if o < 5 else "B" if o < 8 else "C"
            pts.append((o, region, float(rng.normal(0, 3)), float(10 * o + rng.normal())))
        clusters[c] = pts
        rows += [(c, *p) for p in pts]
    df = spark.createDataFrame(rows, "c int, ord int, region string, x double, y double")
    got = {(r.c, r.ord): r for r in K.curve_residuals(df, ["c"], degree).collect()}
    want = {(c, o): v for c, pts in clusters.items() for o, v in brute_residuals(pts, degree).items()}
    assert got.keys() == want.keys()
    for key, (inside, loo) in want.items():
        for value, expected in ((got[key].residual, inside), (got[key].loo_residual, loo)):
            if math.isnan(expected):
                assert value is None
            else:
                assert value == pytest.approx(expected, abs=1e-6)


def test_pooled_z_bound_and_guard(spark):
    df = spark.createDataFrame([(1, i, float(i == 0) * 9) for i in range(5)], "c int, id int, v double")
    z = [r.z for r in K.pooled_z(df, ["c"], "v", 0.1, "z", ["id"]).collect()]
    assert max(abs(v) for v in z) <= math.sqrt(4) + 1e-9
    rows = spark.createDataFrame([(9.0, 0.4)], "tested double, tested_mm double")
    flags = K.with_rules(rows).select("rule", K.flag().alias("f")).collect()
    assert {r.rule: r.f for r in flags} == {"deployed": True, "guarded": False, "loo": False, "loo_raw": True}


def _places(seed, clusters):
    """Clusters of seven or fewer points in places of every kind: copies, straight rows, very large and undefined ones."""
    rng = np.random.default_rng(seed)
    cluster = np.repeat(np.arange(clusters), rng.integers(1, 8, clusters))
    xy = np.stack([rng.integers(1, 51, len(cluster)).astype(float), rng.uniform(1, 100, len(cluster))], axis=1)
    xy[rng.random(len(xy)) < 0.1] = 7.0
    xy[cluster % 7 == 0, 1] = 3.0
    xy[cluster % 11 == 0] *= 1e6
    xy[rng.random(len(xy)) < 0.01, 0] = np.nan
    return cluster, xy


@pytest.mark.parametrize("degree", [2, 3, 5])
def test_nearest_sample_is_that_of_all_samples(degree):
    cluster, xy = _places(3, 400)
    found = K._residual_arrays(cluster, np.zeros(len(cluster), dtype=int), xy, degree)
    grid, seen = np.linspace(0, 1, K.SAMPLES), 0
    for c in range(400):
        own = np.flatnonzero(cluster == c)
        points = xy[own]
        chord = np.r_[0, np.cumsum(np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)))]
        if len(own) < K.MIN_POINTS or not chord[-1] > 0:
            assert np.isnan(found["residual"][own]).all()
            continue
        t, size = chord / chord[-1], min(degree, len(own) - 1)
        if len(np.unique(t)) <= size:  # coincident points: no unique polynomial
            continue
        far = np.abs(points).max()
        curve = np.stack([np.polynomial.Chebyshev.fit(t, points[:, a], size, domain=[0, 1])(grid) for a in (0, 1)], axis=1)
        brute = np.sqrt(((points[:, None] - curve) ** 2).sum(axis=2).min(axis=1))
        assert found["residual"][own] == pytest.approx(brute, rel=1e-6, abs=1e-8 * far)
        seen += 1
    assert seen > 100


def test_search_for_the_nearest_sample_holds_no_table_of_samples():
    cluster, xy = _places(4, 1500)
    region = np.zeros(len(cluster), dtype=int)
    K._residual_arrays(cluster, region, xy, 3)
    tracemalloc.start()
    K._residual_arrays(cluster, region, xy, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e7  # a thousand samples for one batch of fits alone take more


def test_inject_shapes(spark):
    df = spark.createDataFrame([(1, o, "A", float(o), 0.0) for o in range(5)] + [(2, 0, "A", 0.0, 0.0)], "c int, ord int, region string, x double, y double")
    out = K.inject(df, ["c"])
    by = {}
    for r in out.orderBy("ord").collect():
        by.setdefault((r.variant, r.c), []).append((r.ord, r.x, r.perturbed, r.site))
    assert [x for _, x, *_ in by["level_shift", 1]] == [0, 1, 3, 4]
    assert [x for _, x, *_ in by["swap", 1]] == [0, 1, 3, 2, 4]
    assert [x for _, x, *_ in by["off_by_one", 1]] == [1, 2, 3, 4]
    assert [x for _, x, *_ in by["offset", 1]] == [0, 1, 12, 3, 4]
    assert ("swap", 2) not in by and ("level_shift", 2) not in by


LOG = """GrayscaleSoftcopyPresentationState
Error - Missing attribute Type 1 Required Element=<InstanceNumber> Module=<SOPCommon>
Error - Missing attribute Type 1 Required Element=<InstanceNumber> Module=<SOPCommon>
Error - Missing attribute Type 2 Required Element=<StudyID> Module=<GeneralStudy>
Warning - Attribute is not present in standard DICOM IOD - (0x0070,0x0241) US TextColorCIELabValue
Warning - something else
Unrelated line of text
Error - Something went wrong"""


def test_checker_log_counts_files(spark):
    files = {"dirty": LOG, "clean": "Segmentation\nWarning - harmless"}
    lines = spark.createDataFrame([(f, i, ln) for f, t in files.items() for i, ln in enumerate(t.split("\n"))], "file string, line_no int, line string")
    found = L.parse_checker(lines, "file")
    kinds = {(r.file, r.kind): r.n for r in found.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["dirty", "missing"] == 3 and kinds["dirty", "outside"] == 1 and kinds["dirty", "error"] == 1
    affected = L.files_affected(found.filter("kind = 'missing'"), "file", "element", F.lit(2))
    assert {r.element: r.files for r in affected.collect()} == {"InstanceNumber": 1, "StudyID": 1}
    census = L.type_census(spark.createDataFrame([("dirty",), ("clean",), ("gone",)], "file string"), found, "file")
    assert {r.type: (r.files, r.clean) for r in census.collect()} == {
        "GrayscaleSoftcopyPresentationState": (1, 0),
        "Segmentation": (1, 1),
        "(unrecognised)": (1, 1),
    }


def test_regression_gate(spark):
    want = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "rule string, auc double")
    P.regression_gate(want, want, ["rule"], "auc")
    with pytest.raises(ValueError):
        P.regression_gate(want.filter("rule = 'a'"), want, ["rule"], "auc")


def test_require_clean(spark):
    df = spark.createDataFrame([(1,), (300,)], "label int")
    assert P.require_clean(df.filter("label < 255"), {"label": ~F.col("label").between(0, 255)}).count() == 1
    with pytest.raises(Exception, match="out of range"):
        P.require_clean(df, {"label": ~F.col("label").between(0, 255)}).collect()


def test_strict_ordinal_raises(spark):
    df = spark.createDataFrame([("T13",)], "n string")
    assert df.select(R.ordinal(F.col("n"), R.CANONICAL)).first()[0] == 999
    with pytest.raises(Exception, match="no ordinal"):
        df.select(R.ordinal(F.col("n"), R.CANONICAL, strict=True)).collect()


def test_mapping_free_bounds(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (1, [0.0, 0.9, 0.1]), (2, [0.2, 0.2, 0.2])], "k int, p array<double>")
    rows = {r.k: r for r in A.mapping_free(df, ["k"], "p").collect()}
    assert rows[1].modal_channel == 1 and rows[1].agree == 1.0
    assert rows[2].modal_channel == 0 and abs(rows[2].entropy_inv) < 1e-9 and rows[2].margin == 0


def test_quantiles_are_linear(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    row = Grouped(df, ["k"]).quantiles("v", {"a": 0.95, "b": 0.5}).first()
    assert (row.a, row.b) == (pytest.approx(8.55), 4.5)


def mapping_rows(n=60, ties=20):
    rng = np.random.default_rng(4)
    rows = [(i, f"v{i % 4}", j, float(np.round(rng.random() * ties) / ties), i % 7) for i in range(n) for j in range(3)]
    wrong = [bool(rng.random() < 0.4) for _ in range(n)]
    return rows, wrong


@pytest.mark.parametrize("cell_rows", [150, 8_000_000])
def test_mapping_search_over_pieces(spark, monkeypatch, cell_rows):
    """Cubes of small ranges, tied scores in several of them, against the search from scratch."""
    monkeypatch.setattr(C, "CELL_ROWS", cell_rows)
    rows, wrong = mapping_rows()
    df = spark.createDataFrame([(*r[:4], wrong[r[0]]) for r in rows], "id int, category string, channel int, score double, wrong boolean").withColumn("rep", F.lit(0))
    m = np.array([r[3] for r in rows]).reshape(60, 3)
    level = [f"v{i % 4}" for i in range(60)]
    found = C.best_mapping(df, ["rep"]).collect()
    area, mapping = slow_climb(m, np.array(wrong), level, 3)
    assert found[0].search_auc == pytest.approx(area, abs=1e-12) and {r.category: r.channel for r in found} == mapping
    # permuted labels, 20 replicates in groups
    masks = B.permuted_masks(spark.createDataFrame(list(enumerate(wrong)), "id int, wrong boolean"), [], "id", "wrong", 20, 2)
    held = {r.id: bits(r.mask, 20) for r in masks.collect()}
    null = {r.rep: r.auc for r in C.mapping_null(df.drop("wrong", "rep"), masks, "id", 20).collect()}
    assert sorted(null) == list(range(20))
    for rep in (0, 7, 8, 19):
        labels = np.array([held[i][rep] for i in range(60)])
        assert null[rep] == pytest.approx(slow_climb(m, labels, level, 3)[0], abs=1e-12)


@pytest.mark.parametrize("cell_rows", [400, 8_000_000])
def test_held_out_mappings(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(C, "CELL_ROWS", cell_rows)
    rows, wrong = mapping_rows()
    df = spark.createDataFrame([(*r, wrong[r[0]]) for r in rows], "id int, category string, channel int, score double, idx int, wrong boolean")
    cells = C.cells_of(df)
    halves = E.Halves(7, 6, 1)
    counted = C.score_cells(df, [], ["idx"], cells)
    found = {r.column: r.auc for r in C.held_out_mappings(counted, halves, cells).collect()}
    masks = B.permuted_masks(df.select("id", "wrong").distinct(), [], "id", "wrong", 9, 2)
    held = {r.id: bits(r.mask, 9) for r in masks.collect()}
    masked = C.coded(df, cells).join(masks, "id").select("cell", "score", "idx", "mask")
    null = {r.column: r.auc for r in C.held_out_mappings(masked, E.LabelsInHalves(9, halves), cells, 4).collect()}
    m, level = np.array([r[3] for r in rows]).reshape(60, 3), [f"v{i % 4}" for i in range(60)]
    for column in range(6):
        inside = halves.column(column)[np.arange(60) % 7].astype(bool)
        for labels, got in [(np.array(wrong), found.get(column))] + [(np.array([held[i][r] for i in range(60)]), null.get(r * 6 + column)) for r in (0, 8)]:
            _, mapping = slow_climb(m[inside], labels[inside], [v for v, k in zip(level, inside) if k], 3)
            out = [i for i in range(60) if not inside[i]]
            score = np.array([m[i, mapping[level[i]]] for i in out])
            assert got == pytest.approx(pairwise(score, labels[out]), abs=1e-12)


@pytest.mark.parametrize("size, rows, ties", [(3, 1, 3), (3, 40, 5), (12, 300, 40), (70, 900, 300), (5, 300, 2), (40, 700, 10**6)])
def test_cubes_are_all_pairs_a_strip_of_columns_at_a_time(size, rows, ties):
    rng = np.random.default_rng(rows)
    cell, score = rng.integers(0, size, rows), np.sort(rng.integers(0, ties, rows) / ties)
    p, n = rng.integers(0, 3, (2, rows, 2 * E.STRIP + 3)).astype(float)

    class Weigher:
        columns, widest = p.shape[1], 0

        def weights(self, arrays, low, high):
            self.widest = max(self.widest, high - low)
            return p[:, low:high], n[:, low:high]

    weigher = Weigher()
    found = list(C.rows_cubes(cell, score, {}, weigher, size))
    assert weigher.widest == E.STRIP and len(found) == weigher.columns
    twice = 2 * (score[:, None] < score) + (score[:, None] == score)
    for column in (0, E.STRIP, 2 * E.STRIP + 2):
        want = np.zeros((size, size), np.int64)
        np.add.at(want, (cell[:, None], cell[None]), (twice * p[:, column][:, None] * n[:, column]).astype(int))
        assert (found[column].wins == want).all()
        for got, weight in ((found[column].p, p), (found[column].n, n)):
            assert (got == np.bincount(cell, weights=weight[:, column], minlength=size)).all()
        for border in (found[column].first, found[column].last):
            there = score == border.score
            assert (border.p == np.bincount(cell[there], weights=p[there, column], minlength=size)).all()


def test_mapping_null_over_pieces_of_many_chunks(spark, monkeypatch):
    """Replicates in groups, several ranges of scores each, and several chunks in a range."""
    rows, wrong = mapping_rows()
    df = spark.createDataFrame([r[:4] for r in rows], "id int, category string, channel int, score double")
    masks = B.permuted_masks(spark.createDataFrame(list(enumerate(wrong)), "id int, wrong boolean"), [], "id", "wrong", 20, 2)
    whole = {r.rep: r.auc for r in C.mapping_null(df, masks, "id", 20).collect()}
    monkeypatch.setattr(C, "CELL_ROWS", 2048)
    monkeypatch.setattr(C, "PIECE_CHUNKS", 0.4)
    assert {r.rep: r.auc for r in C.mapping_null(df, masks, "id", 20).collect()} == whole


def test_worker_functions_travel_by_value():
    from pyspark import cloudpickle

    assert {K.__name__, C.__name__, B.__name__} <= set(cloudpickle.list_registry_pickle_by_value())


def test_robust_preset_uses_median_and_deviation(spark):
    from tallyframe.operators.curves import score_items

    rows = [("a", float(v), float(v)) for v in (1, 2, 3, 4, 100)]
    df = spark.createDataFrame(rows, "cluster string, residual double, loo_residual double")
    out = score_items(df, ["cluster"], presets=[("r", "z_robust", 1.5, 0.1, 0.0), ("p", "z", 1.5, 0.1, 0.0)])
    got = {(r.rule, r.residual): r.tested for r in out.collect()}
    assert got["r", 100.0] == pytest.approx(97 / 1.4826, abs=1e-8) and got["p", 100.0] < 2.1
    with pytest.raises(ValueError, match="unknown"):
        score_items(df, ["cluster"], presets=[("x", "z_other", 1.5, 0.1, 0.0)])


def test_residuals_bring_the_statistics_of_their_cluster(spark):
    rng = np.random.default_rng(6)
    rows = [(c, o, "A" if o < 3 else "B" if o < 8 else None, *map(float, rng.random(2))) for c in range(30) for o in range(1 + c % 11)]
    centers = spark.createDataFrame(rows, "c int, ord int, region string, x double, y double")
    resid = K.curve_residuals(centers, ["c"], 1)
    mine, want = ({(r.c, r.ord, r.rule): r for r in K.score_items(resid, ["c"], whole=w).collect()} for w in (True, False))
    assert mine.keys() == want.keys() and any(r.tested is None for r in want.values())
    for at, r in want.items():
        assert mine[at].tested == (None if r.tested is None else pytest.approx(r.tested, abs=2e-9))
    parts = K.by_cluster(resid, ["c"], 40 * K.PART_ROWS)
    assert parts.rdd.getNumPartitions() == 40


def test_null_channel_mean_counts_as_zero(spark):
    from tallyframe.operators.rules import score_rules

    df = spark.createDataFrame(
        [(1, "T5", 0, 0, 10, [(6, None, None, 0), (7, 0.9, 0.95, 5)])],
        "item int, category string, seq int, phase int, n_cells int, channels array<struct<channel:int,mean:double,p95:double,n_gt:int>>",
    )
    got = {r.rule: r.score for r in score_rules(df).collect()}
    assert got["mapping_free_top1"] == 0.9 and got["mapping_free_margin"] == 0.9 and got["argmax_mean"] is not None


def test_diff_files_structures_under_removed_and_lists_every_lost_key(spark):
    from tallyframe.operators.diffs import dataset_diff, diff_report

    sent = [("o", "seq", "x", True), ("o", "same", "1", False), ("o", "kept", "y", True)] + [("o", f"kept/{i:02d}", "v", False) for i in range(30)]
    got = [("o", "same", "2", False), ("o", "kept", "z", True), ("o", "new", "n", False), ("o", "kept/00", "other", False)]
    kind = "item string, key string, value string, nested boolean"
    out = diff_report(dataset_diff(spark.createDataFrame(sent, kind), spark.createDataFrame(got, kind), "item", "key", "value"), "item", "key")
    found = {r.kind: (r.listed, r.n) for r in out.collect()}
    assert found["removed"] == ("seq", 1) and found["changed"] == ("same", 1) and found["added"] == ("new", 1)
    assert found["nested_lost"][1] == 29 and found["nested_lost"][0].count(",") == 28


def test_mapping_of_one_class_is_undefined_and_unseen_categories_keep_the_start(spark):
    from tallyframe.operators.ceilings import best_mapping, mapping_auc

    kind = "rep int, category string, channel int, score double, wrong boolean"
    one = spark.createDataFrame([(0, "a", c, 0.1 * i, True) for c in (1, 2) for i in range(3)], kind)
    assert {r.search_auc for r in best_mapping(one, ["rep"]).collect()} == {None}
    fit = [(0, "a", c, s if c == 1 else 0.5, w) for c in (1, 2) for s, w in ((0.1, True), (0.9, False), (0.2, True), (0.8, False))]
    found = best_mapping(spark.createDataFrame(fit, kind), ["rep"])
    held = fit + [(0, "b", c, 0.3, True) for c in (1, 2)]
    assert mapping_auc(spark.createDataFrame(held, kind), found, ["rep"]).first().n_wrong == 3


def test_mapping_null_keeps_replicates_without_errors(spark):
    from tallyframe.operators.ceilings import mapping_null

    scored = spark.createDataFrame([(i, "a", c, float(i * c % 7)) for i in range(12) for c in (1, 2)], "item int, category string, channel int, score double")
    masks = spark.createDataFrame([(i, bytearray([2 if i % 3 == 0 else 0])) for i in range(12)], "item int, mask binary")
    found = {r.rep: r.auc for r in mapping_null(scored, masks, "item", 2).collect()}
    assert found[0] is None and 0 <= found[1] <= 1


def test_census_of_nothing_has_no_bound(spark):
    from tallyframe.operators.logs import flag_census

    df = spark.createDataFrame([(0, 0, 1.0)], "n int, p int, z double")
    assert flag_census(df, "n", "p", "z").first().max_z_bound is None


def test_emitter_log(spark):
    lines = [
        "Penalty for L1: z-score=9.0", "Processing patient: pat_7", "Extracted confidence for 3 vertebrae", "Excluded small box: vertebrae_T4",
        "Penalty for L1: z-score=2.5", "Extracted confidence for 5 vertebrae", "Excluded small box: vertebrae_T4", "Penalty for L1: z-score=1.5",
        "Processing patient: pat_8", "Processing patient: pat_7", "Penalty for L2: z-score=4",
    ]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, line string")
    found = {r.session: r for r in L.emitter_sessions(df, "file").collect()}
    assert set(found) == {"7", "8"} and found["8"].extracted is None and found["8"].n_penalties == 0
    seven = found["7"]
    assert (seven.extracted, seven.small_boxes, seven.n_penalties, seven.top_z, seven.penalties) == (5, ["T4"], 2, 4.0, {"L1": 1.5, "L2": 4.0})


def test_second_checker(spark):
    rows = [("a", "W: meta notice"), ("a", "  Affected attribute: PatientName "), ("a", "W: bad presentation state x"), ("a", "Test failed"), ("b", "Test passed"), ("c", "nothing")]
    df = spark.createDataFrame(rows, "file string, line string")
    found = {r.file: (r.verdict, r.named) for r in L.parse_second_checker(df, "file").collect()}
    assert found == {"a": ("FAIL", ["PatientName", "bad presentation state x"]), "b": ("PASS", []), "c": ("?", [])}


def test_disagreements(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "case string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("w", 1)], "case string, n int")
    assert sorted(r["case"] for r in L.disagreements(a, b, ["case"], "n").collect()) == ["w", "y", "z"]
