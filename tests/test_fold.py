"""A stream of steps folded into buckets equals the batch, also after a restart."""

import os
import random
from datetime import datetime, timedelta

import pytest

from tidecube.operators import temporal
from tidecube.streaming import fold

SCHEMA = "t timestamp, cell long, v double, w double"


def run(spark, stream, out, state):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def put(spark, rows, folder, number):
    """One file with a name of its own, so a later call adds to the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(folder, f"part={number}"))


def rounded(df, keys):
    return sorted((*[r[k] for k in keys], r["n"], round(r["weight"], 3), *[None if r[v] is None else round(r[v], 9) for v in "vw"]) for r in df.collect())


@pytest.mark.parametrize("kind,freq,step,late", [("daily", "hourly", timedelta(hours=5), "3 days"), ("monthly", "weekly", timedelta(days=7), "100 days"), ("interval", "daily", timedelta(days=1), "20 days")])
def test_stream_in_any_order_equals_batch_after_a_restart(spark, tmp_path, kind, freq, step, late):
    rng = random.Random(3)
    began = datetime(2001, 1, 3, 12)
    rows = [(began + n * step, c, rng.random() if rng.random() > 0.1 else None, float(n)) for n in range(60) for c in (1, 2)]
    files = [rows[n : n + 12] for n in range(0, len(rows), 12)]
    for n in range(0, len(files) - 1, 2):  # neighbouring files come in the wrong order: late, but within the wait
        files[n], files[n + 1] = files[n + 1], files[n]
    end = rows[-1][0] + timedelta(days=500)
    folder = str(tmp_path / "in")
    options = {"days": 10} if kind == "interval" else {}
    stream = lambda: fold.fold(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).select("t", "cell", "v", "w"), kind, "2000-12-01", "2002-12-31", ["v", "w"], ["cell"], freq, late=late, **options)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, file in enumerate(files[: len(files) // 2]):
        put(spark, file, folder, n)
    run(spark, stream(), out, state)
    before = spark.read.parquet(out).count()
    for n, file in enumerate([*files[len(files) // 2 :], [(end, 9, 0.0, 0.0)]]):
        put(spark, file, folder, 100 + n)
    run(spark, stream(), out, state)
    keys = ["label", "cell"]
    got = rounded(spark.read.parquet(out), keys)
    want = rounded(temporal.time_aggregate(spark.createDataFrame(rows, SCHEMA), kind, "2000-12-01", "2002-12-31", ["v", "w"], ["cell"], freq, **options), keys)
    assert got == want and 0 < before < len(got)


def test_rows_later_than_the_wait_are_dropped(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda n: datetime(2001, 1, n, 6)
    stream = lambda: fold.fold(spark.readStream.schema(SCHEMA).parquet(folder).select("t", "cell", "v", "w"), "daily", "2001-01-01", "2001-01-31", ["v", "w"], ["cell"], "hourly", late="1 hour")
    for n, rows in enumerate([[(day(1), 1, 1.0, 1.0)], [(day(5), 1, 2.0, 2.0)], [(day(1), 1, 50.0, 50.0), (day(9), 1, 3.0, 3.0)], [(day(20), 1, 0.0, None)]]):
        put(spark, rows, folder, n)
        run(spark, stream(), out, state)
    assert sorted((r["label"], r["v"]) for r in spark.read.parquet(out).collect()) == [("20010101", 1.0), ("20010105", 2.0), ("20010109", 3.0)]


def test_leads():
    assert [fold.lead_days(f) for f in ("daily", "hourly", "weekly", "days=10", "monthly")] == [0, 0, 4, 6, 31]
