"""Axes in ranges: what is carried over their borders, against plain lists."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecube.operators import axis, probe, temporal

ORIGIN = datetime(2020, 1, 1)


@pytest.fixture()
def many_ranges(spark):
    """Small tables keep their ranges apart, so that carrying is met."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def stamps(spark, seconds):
    return spark.createDataFrame([(ORIGIN + timedelta(seconds=float(x)),) for x in seconds], "t timestamp")


def greedy(seconds, within):
    stay = []
    for x in sorted(set(seconds)):
        if not stay or x - stay[-1] >= within:
            stay.append(x)
    return [ORIGIN + timedelta(seconds=float(x)) for x in stay]


def test_values_and_numbers_are_carried_over_ranges(many_ranges):
    rows = [(k, k * 10 if k % 17 == 3 else None) for k in range(100)]
    pieces = axis.ranged(many_ranges.createDataFrame(rows, "k int, v int"), "k")
    assert pieces.select("piece").distinct().count() > 1
    value = F.col("v")
    got = axis.carry(axis.carry(axis.carry(pieces, "k", value, "upto"), "k", value, "before", own=False), "k", value, "from", back=True)
    for r in axis.numbered(got, "k", "n").collect():
        held = [v for k, v in rows if v is not None and k <= r["k"]]
        past = [v for k, v in rows if v is not None and k < r["k"]]
        ahead = [v for k, v in rows if v is not None and k >= r["k"]]
        assert (r["n"], r["upto"], r["before"], r["from"]) == (r["k"], held[-1] if held else None, past[-1] if past else None, ahead[0] if ahead else None)


@pytest.mark.parametrize("large", [1, 20, temporal.LARGE_RUN])
@pytest.mark.parametrize("within", [60, 1000])
def test_merged_steps_against_a_greedy_walk(many_ranges, large, within):
    """Runs that one task thins and runs followed by joins give the same steps, with ties and exact distances among them."""
    rng = np.random.default_rng(within)
    seconds = [*rng.integers(0, 4000, 150).tolist(), *range(20000, 23000, 50), *range(40000, 46000, 1000), 20000]
    first, second = stamps(many_ranges, seconds[:100]), stamps(many_ranges, seconds[100:])
    got = temporal.merge_steps(first, second, within=within, large=large).collect()
    assert sorted(r["t"] for r in got) == greedy(seconds, within)


def test_frequency_and_tail_over_ranges(many_ranges):
    days = stamps(many_ranges, [86400 * d for d in range(60) if d != 30])
    assert temporal.infer_frequency(days).first().asDict() == {"freq": "daily", "secs": 86400}
    tail = probe.tail_range(days.union(days), 29, 32).collect()
    assert sorted({(r["t"] - ORIGIN).days for r in tail}) == [29, 31, 32] and len(tail) == 6


def test_nearest_steps_over_ranges(many_ranges):
    rng = np.random.default_rng(5)
    steps, asked = sorted(set(rng.integers(0, 500_000, 40).tolist())), rng.integers(-1000, 501_000, 200).tolist()
    probes = many_ranges.createDataFrame([(n, ORIGIN + timedelta(seconds=x)) for n, x in enumerate(asked)] + [(-1, None)], "n int, probe_t timestamp")
    got = {r["n"]: r["t"] for r in temporal.nearest_step(stamps(many_ranges, steps), probes).collect()}
    assert got == {n: ORIGIN + timedelta(seconds=min(steps, key=lambda s: (abs(s - x), s))) for n, x in enumerate(asked)}


def test_nearest_steps_count_whole_seconds(many_ranges):
    """Half a second after the middle of two steps is as near to the earlier one."""
    probes = many_ranges.createDataFrame([(n, ORIGIN + timedelta(seconds=x)) for n, x in enumerate((50, 50.5, 51, 99.5))], "n int, probe_t timestamp")
    got = {r["n"]: r["t"] for r in temporal.nearest_step(stamps(many_ranges, [0, 100]), probes).collect()}
    assert got == {n: ORIGIN + timedelta(seconds=x) for n, x in enumerate((0, 0, 100, 100))}


def test_empty_axes(many_ranges):
    none = stamps(many_ranges, [0]).where("false")
    assert temporal.merge_steps(none, none).count() == 0
    assert temporal.infer_frequency(none).first()["freq"] == "None"
    assert probe.tail_range(none, 0, 5).count() == 0
    asked = many_ranges.createDataFrame([(1, ORIGIN)], "n int, probe_t timestamp")
    assert [r["t"] for r in temporal.nearest_step(none, asked).collect()] == [None]
