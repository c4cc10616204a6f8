"""Weighted statistics against a plain version, whole and split by ranges of values."""

import math
import random

import pytest

from tidecube.operators import stats

NAMES = ["layer", "v", "w", "tie"]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    total = sum(w for _, w, _ in rows)
    mean = sum(v * w for v, w, _ in rows) / total
    out = {"mean": mean, "std": math.sqrt(sum(w * (v - mean) ** 2 for v, w, _ in rows) / total), "min": rows[0][0], "max": rows[-1][0]}
    for name, q in stats.PERCENTILES.items():
        cum, before, found = 0.0, None, None
        for v, w, _ in rows:
            cum += w
            p = (cum - w / 2) / total
            if p >= q:
                found = v if before is None else before[1] + (q - before[0]) / (p - before[0]) * (v - before[1])
                break
            before = (p, v)
        out[name] = rows[-1][0] if found is None else found
    return out


@pytest.mark.parametrize("large", [3, 10, stats.LARGE_GROUP])
def test_statistics_match_a_plain_version(spark, large):
    rng = random.Random(8)
    rows = []
    for layer, count in ((1, 700), (2, 3), (None, 60), (4, 1), (5, 400)):
        for n in range(count):
            value = 7.5 if layer in (1, 5) and rng.random() < 0.4 else rng.choice([rng.gauss(0, 5), rng.randrange(4), 1e6 * rng.random()])
            rows.append((layer, float(value), rng.choice([0.5, 1.0, 3.0, 40.0]), n))
    rows += [(1, None, 1.0, -1), (2, 3.0, None, -2)]
    df = spark.createDataFrame(rows, "layer long, v double, w double, tie long")
    got = {r["layer"]: r for r in stats.weighted_stats(df, ["layer"], "v", "w", tie=["tie"], large=large).collect()}
    for layer in (1, 2, None, 4, 5):
        want = plain([(v, w, t) for own, v, w, t in rows if own == layer and v is not None and w is not None])
        assert {k: got[layer][k] for k in want} == pytest.approx(want, rel=1e-9, abs=1e-9), layer


@pytest.mark.parametrize("large", [3, 20, stats.LARGE_GROUP])
def test_rows_without_a_value_count_with_their_weight(spark, large):
    """Group 1 has its values below the 40th percentile, 2 no value, 3 and the null group values throughout, 4 three of forty rows."""
    rng = random.Random(10)
    rows = [(layer, rng.choice([7.5, rng.gauss(0, 5)]) if n < valued else None, rng.choice([0.5, 1.0, 3.0]), n) for layer, count, valued in ((1, 300, 110), (2, 8, 0), (3, 60, 60), (4, 40, 3), (None, 9, 5)) for n in range(count)]
    df = spark.createDataFrame([*rows, (3, 1.0, None, -1)], "layer long, v double, w double, tie long")
    got = {r["layer"]: r for r in stats.weighted_stats(df, ["layer"], "v", "w", tie=["tie"], large=large, skip_nulls=False).collect()}
    assert len(got) == 5 and all(got[2][s] is None for s in stats.ALL_STATS)
    for layer in (1, 3, 4, None):
        own = [(v, w, t) for where, v, w, t in rows if where == layer]
        total, valued = sum(w for _, w, _ in own), [r for r in own if r[0] is not None]
        top = max(v for v, _, _ in valued)
        want = plain([*valued, (top, total - sum(w for _, w, _ in valued), math.inf)])  # what is missing, as one row of the largest value
        mean = sum(v * w for v, w, _ in valued) / total
        want |= {"mean": mean, "std": math.sqrt(sum(w * (v - mean) ** 2 for v, w, _ in valued) / total)}
        assert {k: got[layer][k] for k in want} == pytest.approx(want, rel=1e-9, abs=1e-9), layer


@pytest.mark.parametrize("small", [stats.SMALL_TABLE, 0])
def test_rows_of_a_large_group_never_meet(spark, monkeypatch, small):
    """Of 20 000 rows only those near a percentile are shuffled, unless the table that they meet is too large to be broadcast."""
    monkeypatch.setattr(stats, "SMALL_TABLE", small)
    rng = random.Random(9)
    rows = [(n % 2, round(rng.gauss(0, 5), 3), rng.choice([0.5, 1.0, 3.0]), n) for n in range(20_000)] + [(7, float(n), 1.0, n) for n in range(5)]
    df = spark.createDataFrame(rows, "layer long, v double, w double, tie long")
    context = spark.sparkContext
    context.setJobGroup(f"large-{small}", "")
    got = {r["layer"]: r for r in stats.weighted_stats(df, ["layer"], "v", "w", tuple(stats.PERCENTILES), tie=["tie"], large=1000).collect()}
    context.setJobGroup("", "")
    for layer in (0, 1, 7):
        want = plain([(v, w, t) for own, v, w, t in rows if own == layer])
        assert {k: got[layer][k] for k in stats.PERCENTILES} == pytest.approx({k: want[k] for k in stats.PERCENTILES}, rel=1e-9, abs=1e-9), layer
    jobs = context.statusTracker().getJobIdsForGroup(f"large-{small}")
    stages = {s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds}
    store = context._jsc.sc().statusStore()
    read = [store.lastStageAttempt(s).shuffleReadRecords() for s in stages]
    assert jobs and (small == 0 or max(read) < 10_000)


def test_percentiles_by_hand(spark):
    """v = 1, 2, 3 with weights 1, 1, 2: midpoints 0.125, 0.375, 0.75."""
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (0, 3.0, 2.0)], "layer long, v double, w double")
    for large in (1, 10):
        r = stats.weighted_stats(df, ["layer"], "v", "w", large=large).first()
        assert r["mean"] == 2.25 and r["std"] == pytest.approx(0.829156, abs=1e-6)
        assert [r[s] for s in stats.PERCENTILES] == pytest.approx([1, 1.5, 2.333333, 3, 3], abs=1e-6)


def test_steps_merge_by_the_last_one_kept(spark):
    """Noon of each day, then midnights from the third day: each is 12 h from a step that stays, so noons alone stay."""
    from tidecube.operators import temporal

    noon = temporal.generate_steps(spark, "2024-01-01 12:00:00", "2024-01-05 12:00:00", days=1)
    midnight = temporal.generate_steps(spark, "2024-01-03 00:00:00", "2024-01-08 00:00:00", days=1)
    got = sorted(r["t"].strftime("%d %H") for r in temporal.merge_steps(noon, midnight).collect())
    assert got == ["01 12", "02 12", "03 12", "04 12", "05 12", "07 00", "08 00"]
    every = temporal.merge_steps(noon, midnight, noon, within=0)
    assert every.count() == 11


def test_no_profile_gives_0_and_no_value_null(spark):
    """Level 0 has both statistics, one of them null; level 1 has the mean alone, level 2 nothing."""
    profile = spark.createDataFrame([(1, 0, 2, 0, "mean", 4.0), (1, 0, 2, 0, "max", None), (1, 0, 2, 1, "mean", None)], "t long, basin int, coast int, k long, stat string, value double")
    cells = spark.createDataFrame([(1, k, 1, 2) for k in (0, 1, 2)], "t long, k long, basins int, coast int")
    got = {r["k"]: (r["mean"], r["max"]) for r in stats.stats_from_profile(cells, profile, ("mean", "max")).collect()}
    assert got == {0: (4.0, None), 1: (None, 0.0), 2: (0.0, 0.0)}


def test_points_off_the_grid_have_a_row_at_each_instant(spark):
    from tidecube.operators import probe

    profile = spark.createDataFrame([(t, 0, 2, k, "mean", 10.0 * t + k) for t in (1, 2) for k in (0, 1)], "t long, basin int, coast int, k long, stat string, value double")
    points = spark.createDataFrame([(0, 5.0), (1, 15.0), (2, 99.0)], "pid long, depth double")
    axis = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 30.0)], "k long, lo double, hi double")
    got = sorted((r["pid"], r["t"], r["value"]) for r in probe.hovmoeller_from_profile(profile, points, axis, 0).collect())
    assert got == [(0, 1, 10.0), (0, 2, 20.0), (1, 1, 11.0), (1, 2, 21.0), (2, 1, 0.0), (2, 2, 0.0)]


def test_points_on_a_shell(spark):
    from tidecube.operators import probe

    far = [math.dist((r["x"], r["y"], r["z"]), (3.0, 4.0, -5.0)) for r in probe.point_source(spark, 3.0, 4.0, 5.0, 200, 2.0, shell=True).collect()]
    assert far == pytest.approx([2.0] * 200)


def test_decades_may_begin_in_year_one(spark):
    from tidecube.operators import temporal

    labels = [r["label"] for r in temporal.requests(spark, "decadal", "1995-01-01", "2003-01-01", decade_from=1).orderBy("start").collect()]
    assert labels == ["1991...2001", "2001...2011"]
