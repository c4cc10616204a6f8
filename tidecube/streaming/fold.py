"""Time averages of a stream: sums are carried from batch to batch and a bucket is given out once, when it has closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import is_fine, requests, select_steps

#: How long after a bucket's end a step may come whose window still reaches into it, by frequency.
LEAD = {"weekly": 4, "monthly": 31, "yearly": 366}


def lead_days(freq: str) -> int:
    if is_fine(freq):
        return 0
    kind, _, number = freq.partition("=")
    return int(number) // 2 + 1 if kind == "days" else LEAD[freq]


def fold_steps(stream: DataFrame, wanted: DataFrame, values: list[str], cell=(), freq: str = "daily", closed: str = "both", late: str = "0 seconds") -> DataFrame:
    """(req_id, label, cell.., n, weight, values): temporal.bucket_mean() of a stream of steps, a row for each bucket and cell as it closes.

    wanted is a table of requests, which is small next to the stream. Fine steps weigh 1, coarse ones the seconds that their window shares with the bucket, so a step
    that lies over two buckets counts in both. A bucket closes when the watermark, `late` behind the latest step, has passed its end and what
    steps of that frequency may still reach back; rows that come later than that are dropped. State is a count and two sums a value for each cell of each
    open bucket; it lives in the state store, so a query that is started again from its checkpoint goes on with it.
    """
    ends = wanted.select("req_id", (F.col("end") + F.expr(f"interval {lead_days(freq)} days")).alias("closes"))
    chosen = select_steps(stream.withWatermark("t", late), wanted, freq, closed).join(ends, "req_id")
    chosen = chosen.select("t", "req_id", "label", "closes", *cell, F.col("weight").cast("double").alias("weight"), *[F.col(v).cast("double").alias(v) for v in values])
    kinds = dict(chosen.dtypes)
    state = "n long, weight double, " + ", ".join(f"w{n} double, s{n} double" for n in range(len(values)))
    out = ", ".join(["req_id long", "label string", *[f"`{c}` {kinds[c]}" for c in cell], "n long", "weight double", *[f"`{v}` double" for v in values]])

    def carry(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            n, weight, *sums = held.get
            held.remove()
            means = [s / w if w else None for w, s in zip(sums[0::2], sums[1::2])]
            row = [key[0], key[1], *key[3:], n, weight, *means]
            yield pd.DataFrame([row], columns=["req_id", "label", *cell, "n", "weight", *values])
            return
        n, weight, *sums = held.get if held.exists else (0, 0.0, *[0.0] * (2 * len(values)))
        for pdf in parts:
            n, weight = n + len(pdf), weight + float(pdf["weight"].sum())
            for m, v in enumerate(values):
                there = pdf[v].notna()
                sums[2 * m] += float(pdf["weight"][there].sum())
                sums[2 * m + 1] += float((pdf["weight"] * pdf[v])[there].sum())
        held.update((n, weight, *sums))
        # Not before the watermark: a bucket that has ended already is given out with the next batch.
        held.setTimeoutTimestamp(max(int(pd.Timestamp(key[2]).timestamp() * 1000), held.getCurrentWatermarkMs() + 1))

    grouped = chosen.groupBy("req_id", "label", "closes", *cell)
    return grouped.applyInPandasWithState(carry, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def fold(stream: DataFrame, kind: str, start: str, end: str, values: list[str], cell=(), freq: str = "daily", closed: str = "both", late: str = "0 seconds", **options) -> DataFrame:
    """temporal.time_aggregate() of a stream."""
    return fold_steps(stream, requests(stream.sparkSession, kind, start, end, **options), values, cell, freq, closed, late)
