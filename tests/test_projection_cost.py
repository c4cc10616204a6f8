"""The inverse of the equal-area map searches for its angle once a column, not at each step of the second search."""

import numpy as np
from pyspark.sql import functions as F

from tidecube.functions import projection


def searches(expression) -> int:
    """How often the first search stands inside the lambdas of the second one."""
    text = expression._jc.toString() if hasattr(expression, "_jc") else str(expression)
    return text.count("aggregate(")


def test_equal_earth_binds_its_angle(spark):
    lon, lat = projection.unproject("equal earth", F.col("x"), F.col("y"))
    assert searches(lon) == 1 and searches(lat) == 2
    rows = spark.createDataFrame([(float(a), float(b)) for a in (-170, -3, 0, 99) for b in (-89, -40, 0, 15, 88)], "lon double, lat double")
    x, y = projection.project("equal earth", F.col("lon"), F.col("lat"))
    back = rows.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).toPandas()
    assert np.allclose(back["lon"], back["a"], atol=1e-8) and np.allclose(back["lat"], back["b"], atol=1e-8)
