"""Long axes in order: cut into ranges, with what a row takes from rows before or after it carried from range to range.

A table here has one row for each value of its key. No task orders more than one range; beside that, one row a range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: Most steps of a run that one task thins; longer runs are followed by joins.
LARGE_RUN = 1_000_000


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """rows with `piece`, the number of their range of key; kept by a checkpoint, as ranges are found by a sample and other tables refer to them."""
    return kept(rows.repartitionByRange(F.col(key)).withColumn("piece", F.spark_partition_id()))


def carry(pieces: DataFrame, key: str, value: Column, name: str, back: bool = False, own: bool = True) -> DataFrame:
    """pieces with column `name`: the last value that is not null in rows up to this one (own=False: before it); back=True goes down from the end."""
    order = (lambda c: F.col(c).desc()) if back else F.col
    start, stop = Window.unboundedPreceding, 0 if own else -1
    end = (F.min_by if back else F.max_by)(value, F.when(value.isNotNull(), F.col(key)))
    ends = pieces.groupBy("piece").agg(end.alias("__end"))
    passed = F.last("__end", ignorenulls=True).over(Window.orderBy(order("piece")).rowsBetween(start, -1))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("piece").orderBy(order(key)).rowsBetween(start, stop))
    ends = F.broadcast(ends.select("piece", passed.alias("__passed")))  # one row a range
    return pieces.join(ends, "piece").withColumn(name, F.coalesce(inside, "__passed")).drop("__passed")


def numbered(pieces: DataFrame, key: str, name: str) -> DataFrame:
    """pieces with column `name`: the row's number in the order of key, from 0."""
    sizes = pieces.groupBy("piece").agg(F.count("*").alias("__size"))
    passed = F.sum("__size").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = F.broadcast(sizes.select("piece", F.coalesce(passed, F.lit(0)).alias("__passed")))  # one row a range
    inside = F.row_number().over(Window.partitionBy("piece").orderBy(key)) - 1
    return pieces.join(sizes, "piece").withColumn(name, inside + F.col("__passed")).drop("__passed")


def reached(steps: DataFrame, starts: DataFrame, ahead: int) -> DataFrame:
    """(at): the steps(at) met by going from each of starts(at) to the first step at least `ahead` further, again and again.

    Each step points at its next one; pointers double, so a chain of n steps takes log2(n) rounds of equi-joins.
    """
    asked = steps.select((F.col("at") + ahead).alias("at"), F.lit(None).cast("long").alias("step"))
    points = steps.select("at", F.col("at").alias("step")).union(asked).groupBy("at").agg(F.max("step").alias("step"))
    found = carry(ranged(points, "at"), "at", F.col("step"), "next", back=True).where("next IS NOT NULL")
    jumps = kept(steps.select("at").join(found.select((F.col("at") - ahead).alias("at"), "next"), "at"))
    met = starts.select("at")
    while jumps.limit(1).count():
        met = kept(met.union(met.join(jumps, "at").select(F.col("next").alias("at"))).distinct())
        jumps = kept(jumps.join(jumps.select(F.col("at").alias("next"), F.col("next").alias("further")), "next").select("at", F.col("further").alias("next")))
    return met
