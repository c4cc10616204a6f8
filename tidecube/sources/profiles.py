"""Kept layer statistics (STAT_PROFILES files) as a table."""

from __future__ import annotations

import glob
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .netcdf import File, encode

#: Order of the statistics along the files' last axis.
STATS = ("mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max")


def _decoded(variable: str, path: str, data: bytes):
    import pyarrow as pa

    values = File(data).values(variable)
    values = values if values.ndim == 5 else values[None]
    idx = [a.ravel() for a in np.meshgrid(*(np.arange(n) for n in values.shape), indexing="ij")]
    stat = np.array(STATS)[idx[4]]
    columns = [pa.array([path] * len(stat)), *(pa.array(a.astype(np.int64)) for a in idx[:4]), pa.array(stat), pa.array(values.ravel(), from_pandas=True)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "step", "basin", "coast", "k", "stat", "value"])


def _opened(variable: str):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open(path, "rb") as data:
                    yield _decoded(variable, path, data.read())

    return run


def _loaded(variable: str):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield _decoded(variable, path, data)

    return run


SCHEMA = "path string, step long, basin long, coast long, k long, stat string, value double"


def read_profiles(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(path, step, basin, coast, k, stat, value) of files var(sub, coast, z, stat) or var(time, sub, coast, z, stat).

    A path with a scheme goes through Spark's own binary reader. One without is a folder that all executors
    see, whose files are opened by name: their usual names hold colons, which that reader does not take.
    """
    if "://" in path:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_loaded(variable), SCHEMA)
    found = sorted(glob.glob(os.path.join(path, "*.nc"))) if os.path.isdir(path) else sorted(glob.glob(path))
    files = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, min(len(found), 4096)))
    return files.mapInArrow(_opened(variable), SCHEMA)


def with_time(profiles: DataFrame) -> DataFrame:
    """t from the second dot field of the file's name."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return profiles.withColumn("t", F.to_timestamp(F.split_part(F.regexp_replace(name, "%3A", ":"), F.lit("."), F.lit(2)), "yyyyMMdd-HH:mm:ss"))


def profile_bytes(variable: str, values: np.ndarray) -> bytes:
    """A file of one instant: var(sub, coast, z, stat)."""
    dims = dict(zip(("sub", "coast", "z", "stat"), values.shape))
    return encode(dims, {variable: (tuple(dims), np.asarray(values, np.float64))})
