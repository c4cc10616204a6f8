"""The grid that the engine's queries run on: a view of the embeddings table as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along each axis of one time step; a vector of 64 components gives its cells of 64 // NX steps.
NX, NY, NZ = 16, 10, 10
STEPS = 64 // NX
SHAPE = {"x": NX, "y": NY, "z": NZ}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, k, j, i, u, v, w, temp, sal, metrics, masks): four steps of 16 x 10 x 10 cells for each 500 vectors."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    x = F.col("x").cast("double")
    c = F.floor(F.col("vec_id") / 100) % 5
    pick = lambda n: F.max(F.when(F.col("c") == n, F.col("x")))
    base = raw.select(
        (F.floor(F.col("vec_id") / 500) * STEPS + F.floor(F.col("at") / NX)).cast("long").alias("t"), c.alias("c"), (F.floor(F.col("vec_id") / 10) % 10).cast("long").alias("k"),
        (F.col("vec_id") % 10).cast("long").alias("j"), (F.col("at") % NX).cast("long").alias("i"), x.alias("x"),
    )
    k, j, i = F.col("k"), F.col("j"), F.col("i")
    grid = base.groupBy("t", "k", "j", "i").agg(
        pick(0).alias("u"), pick(1).alias("v"), pick(2).alias("w"), (14 + 10 * pick(3) - 0.4 * k).alias("temp"), (38 + pick(4)).alias("sal")
    )
    coast = F.when((i + j) % 7 == 0, 0).when(k < 3, 1).otherwise(2)
    return grid.withColumns({
        "e1t": 1 + 0.01 * j, "e1u": 1 + 0.01 * j, "e1v": 1 + 0.01 * j + 0.005, "e2t": 1 + 0.02 * j, "e2u": 1 + 0.02 * j, "e2v": 1 + 0.02 * j + 0.01,
        "e3t": 1 + 0.1 * k, "e3u": 1 + 0.1 * k, "e3v": 1 + 0.1 * k, "e3w": 1 + 0.1 * k + 0.05,
        "depth": 5.0 + 10 * k, "x": i.cast("double"), "y": j.cast("double"), "z": -(5.0 + 10 * k), "lat": 30.0 + j,
        "basin": i.cast("int"), "basins": F.expr("shiftleft(1, CAST(i AS INT))"), "coast": coast, "land": (coast == 0).cast("int"),
    })


SQL = """
lanes AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS lane, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
raw AS (
  SELECT vec_id // 500 * 4 + lane // 16 AS t, (vec_id // 100) % 5 AS c, (vec_id // 10) % 10 AS k, vec_id % 10 AS j, lane % 16 AS i, x FROM lanes
), cells AS (
  SELECT t, k, j, i, max(x) FILTER (c = 0) AS u, max(x) FILTER (c = 1) AS v, max(x) FILTER (c = 2) AS w,
         14 + 10 * max(x) FILTER (c = 3) - 0.4::DOUBLE * k AS temp, 38 + max(x) FILTER (c = 4) AS sal,
         1 + 0.01::DOUBLE * j AS e1t, 1 + 0.01::DOUBLE * j AS e1u, 1 + 0.01::DOUBLE * j + 0.005::DOUBLE AS e1v,
         1 + 0.02::DOUBLE * j AS e2t, 1 + 0.02::DOUBLE * j AS e2u, 1 + 0.02::DOUBLE * j + 0.01::DOUBLE AS e2v,
         1 + 0.1::DOUBLE * k AS e3t, 1 + 0.1::DOUBLE * k AS e3u, 1 + 0.1::DOUBLE * k AS e3v, 1 + 0.1::DOUBLE * k + 0.05::DOUBLE AS e3w,
         5 + 10::DOUBLE * k AS depth, i::DOUBLE AS x, j::DOUBLE AS y, -(5 + 10::DOUBLE * k) AS z, 30 + j::DOUBLE AS lat,
         CAST(i AS INTEGER) AS basin, CASE WHEN (i + j) % 7 = 0 THEN 0 WHEN k < 3 THEN 1 ELSE 2 END AS coast,
         CASE WHEN (i + j) % 7 = 0 THEN 1 ELSE 0 END AS land
  FROM raw GROUP BY t, k, j, i
)"""
