"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with built-in functions only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, materialise

#: Virtual nodes of each shard on the ring; shards * VIRTUAL_NODES bounds what the driver plans with.
VIRTUAL_NODES = 128
#: At most this many ids can repeat so often that their rows are ordered in several tasks.
MAX_FULL = 1024
#: The ring has this many points.
RING = 1 << 32


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node in clockwise order; a shard's points do not depend on other shards."""
    points = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            point = int.from_bytes(hashlib.sha256(f"shard {shard} node {node}".encode()).digest()[:4], "big")
            while point in points:
                point = (point + 1) % RING
            points[point] = shard
    return sorted(points.items())


def bounded_plan(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for the rows of each arc, an arc being what ends at a node.

    Capacities add up to the rows and differ by one at most (the first shards take one more). Each shard first
    takes rows of its own arcs, in ring order; what is over goes clockwise from its arc to the next node
    whose shard still has room. Only counts are needed, so the plan has arcs + shards + overflows rows at most.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    plan, over = [], []
    for arc, (_, shard) in enumerate(nodes):
        rows = counts.get(arc, 0)
        here = min(rows, room[shard] - used[shard])
        if here:
            plan.append((arc, 0, here, shard, used[shard]))
            used[shard] += here
        if rows > here:
            over.append((arc, here, rows))
    for arc, rank, rows in over:
        at = arc
        while rank < rows:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            here = min(rows - rank, room[shard] - used[shard])
            if here:
                plan.append((arc, rank, rank + here, shard, used[shard]))
                used[shard] += here
                rank += here
    return plan


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    Keys are ids. The ring's arcs are found by binary search in the sorted node points; rows are
    counted by arc and rank, with partial sums; the driver plans with one number for each arc (at most
    shards * virtual_nodes), and the plan goes back as a literal of that bound. Law `rows`: shard sizes
    differ by one at most. The ids are hashed, so no text, source or copy makes an arc hot; rows that
    repeat an id are ordered among themselves by size and checksum of the text, or, where one id has more than 1 / MAX_FULL
    of all rows, in parts by row number, so that no task holds them all.

    Defined cases: null text has size 8 and the checksum of no bytes; a null id is a key like any other;
    a very long text only adds to its row's size, as law `rows` counts rows; fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual_nodes)
    points = F.array(*[F.lit(p) for p, _ in nodes])
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("__h"),
    ).withColumn("__point", F.pmod(F.col("__h"), F.lit(RING)))
    placed = base.withColumn("__arc", _first_at_or_after(points, F.col("__point"), len(nodes)))
    # An arc is cut into cells so that no window holds more than a small share of the rows; only an id that repeats can fill
    # more than 1 / MAX_FULL of all rows into one, and such cells, at most MAX_FULL, are cut further by the rows' numbers.
    placed = placed.withColumn("__cell", F.pmod(F.shiftright("__h", 33), F.lit(64))).withColumn("__row", F.monotonically_increasing_id())
    placed = materialise(placed, "placed")
    sizes = materialise(placed.groupBy("__arc", "__cell").agg(F.count("*").alias("n")), "cell-sizes")
    full = max(HOT_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // MAX_FULL)
    cut = F.broadcast(sizes.where(F.col("n") > full).select("__arc", "__cell", F.ceil(F.col("n") / full).alias("__ways")))
    placed = placed.join(cut, ["__arc", "__cell"], "left").withColumn("__sub", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__ways")), F.lit(0)))
    cells = materialise(placed.groupBy("__arc", "__cell", "__sub").agg(F.count("*").alias("n")), "cells")
    counts = {r["__arc"]: r["n"] for r in cells.groupBy("__arc").agg(F.sum("n").alias("n")).collect()}
    plan = bounded_plan(nodes, counts, shards)
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("__arc").orderBy("__cell", "__sub")) - F.col("n")).select("__arc", "__cell", "__sub", "before")
    order = Window.partitionBy("__arc", "__cell", "__sub").orderBy("__h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = placed.withColumn("__rank", F.row_number().over(order) - 1).join(before, ["__arc", "__cell", "__sub"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("before"))
    kind = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    text = json.dumps([dict(zip(("arc", "lo", "hi", "shard", "slot"), row)) for row in plan])
    steps = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    home = F.array(*[F.lit(s) for _, s in nodes])
    met = ranked.join(F.broadcast(steps), (F.col("__arc") == F.col("arc")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    return met.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("__rank") - F.col("lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.get(home, F.col("__arc")).alias("home_shard"),
    )


def _first_at_or_after(points, value, size: int):
    """Index of the first of the sorted points that is >= value, 0 past the last: a fixed number of halvings."""
    steps = max(1, size.bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(state, _):
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        done = state["lo"] >= state["hi"]
        right = F.get(points, mid) < value
        return F.struct(
            F.when(~done & right, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(~done & ~right, mid).otherwise(state["hi"]).alias("hi")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.pmod(s["lo"], F.lit(size)))
