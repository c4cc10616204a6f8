"""Shared pieces: scratch tables in the shared folder, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the five ASCII controls.
SPACE = r"[\x20\x09-\x0D]"

#: Keys that more rows share than this, and than rows / MAX_HOT, are dealt over several tasks.
HOT_ROWS, MAX_HOT = 512, 1 << 16

#: Types of ids that are used as they are.
WHOLE = ("bigint", "int", "smallint", "tinyint")

_local_dirs: dict[str, str] = {}
_owner: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: tables between steps are written there")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidecube-")
    return _local_dirs[context.applicationId]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """The tables that materialise() writes inside `with scratch:`, and no others; release() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)

    def release(self) -> None:
        """Call it once the results that read the tables are stored."""
        while self.paths:
            delete_path(self.spark, self.paths.pop())


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each table written are deleted with its end; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    A table without a path of its own belongs to the Scratch around the call; without one, it is deleted when the
    application ends. A given path is the caller's to delete; what an earlier attempt left there is overwritten.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/tidecube-{uuid.uuid4().hex}-{name}"
        owner = _owner.get()
        if owner is not None:
            owner.paths.append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        df.write.parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(docs: DataFrame, id_col: str, name: str = "rows") -> DataFrame:
    """(row, doc): every row of docs under a number of its own, doc being a struct of all its columns.

    No column of docs can clash with those that an operator adds, and rows that repeat an identifier, or are equal in
    every column, are told apart. Where whole-number ids tell all rows apart, which is counted, they are the numbers; else rows are
    numbered and the table is written, so that numbers stay.
    """
    if dict(docs.dtypes)[id_col] in WHOLE:
        row = F.col(f"`{id_col}`").cast("long")
        seen = docs.agg(F.count("*").alias("rows"), F.count_distinct(row).alias("ids")).first()
        if seen["rows"] == seen["ids"]:
            return docs.select(row.alias("row"), F.struct("*").alias("doc"))
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), name)


def long_ids(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows(row, doc_id, text) with ids as longs, the table of what they stand for).

    Whole numbers stand for themselves, without a table. Ids of any other type are numbered in their order, equal ids alike,
    by a sort of the distinct ones over all tasks; named() puts them back. A null id stays null.
    """
    own = field(id_col)
    if rows.select(own.alias("id")).dtypes[0][1] in WHOLE:
        return rows.select("row", own.cast("long").alias("doc_id"), field(text_col).alias("text")), None
    ids = rows.select(own.alias("id")).where("id IS NOT NULL").distinct().orderBy("id")
    names = materialise(ids.select("id", F.monotonically_increasing_id().alias("number")), "id-numbers")
    numbered = rows.select("row", own.alias("id"), field(text_col).alias("text")).join(names, "id", "left")
    return materialise(numbered.select("row", F.col("number").alias("doc_id"), "text"), "numbered-rows"), names


def named(found: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """found with the ids that the numbers in columns stand for."""
    if names is None:
        return found
    for column in columns:
        own = names.select(F.col("number").alias("__number"), F.col("id").alias("__id"))
        met = found.join(own, F.col(column) == F.col("__number"), "left")
        found = met.select(*[F.col("__id").alias(c) if c == column else F.col(c) for c in found.columns])
    return found


def field(column: str) -> Column:
    """The column of docs in numbered_rows()."""
    return F.col("doc").getField(column)


def only_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The columns of docs for the numbered rows that kept(row) lists."""
    return rows.join(kept.select("row"), "row", "left_semi").select("doc.*")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], deal: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row a key and n, about how many of rows have that key.

    Keys with n over HOT_ROWS and over 1 / MAX_HOT of all are dealt over several tasks by the column `deal` of rows;
    there are at most MAX_HOT of them, so what is broadcast is bounded. table is read several times: it should be written.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // MAX_HOT)
    ways = F.ceil(F.col("n") / limit).cast("int")
    hot = table.where(F.col("n") > limit).select(*keys, ways.alias("__ways"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(deal), F.col("__ways")), F.lit(0)).cast("int")).drop("__ways")
    dealt = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, ways).otherwise(F.lit(1)) - 1)))
    return salted.join(dealt, [*keys, "__salt"], how).drop("__salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_part(column: str, parts: int) -> Column:
    """crc32 of an identifier's decimal text, modulo parts; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


# ---------------------------------------------------------------- word hashing

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEGMENT = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _SEGMENT + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_buffer(blob: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of blob and the byte offset of each word's start.

    With prefixes, a row for each word: its hash, then those of its first so many bytes (0 if it is not longer).
    """
    raw = np.frombuffer(blob, np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), start
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    whole = mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not prefixes:
        return whole, start
    columns = [whole]
    for size in prefixes:
        longer = np.flatnonzero(end - start > size)
        column = np.zeros(len(start), np.uint64)
        column[longer] = mix64((total[start[longer] + size] - total[start[longer]]) * down[start[longer]] + np.uint64(size))
        columns.append(column)
    return np.stack(columns, axis=1), start


def word_hashes(texts: Iterable[bytes], prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of texts, (index of the first, one array of word hashes per text).

    Texts go through in buffers of about 1 MB; a longer one is cut at white space, so memory does not
    follow the longest text's length eightfold more than once per segment.
    """
    first, held, size = 0, [], 0
    for index, text in enumerate(texts):
        if len(text) > _SEGMENT:
            if held:
                yield first, _split(held, prefixes)
            parts, at = [], 0
            while at < len(text):
                stop = min(len(text), at + _SEGMENT)
                while stop < len(text) and not _IS_SPACE[text[stop]]:
                    stop += 1
                parts.append(_hash_buffer(text[at:stop], prefixes)[0])
                at = stop
            yield index, [np.concatenate(parts)]
            first, held, size = index + 1, [], 0
            continue
        held.append(text)
        size += len(text)
        if size > _SEGMENT:
            yield first, _split(held, prefixes)
            first, held, size = index + 1, [], 0
    if held:
        yield first, _split(held, prefixes)


def _split(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    hashes, start = _hash_buffer(b" ".join(texts), prefixes)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(start, ends[:-1]))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of the given width; a shorter text is one sequence."""
    if not len(words):
        return np.empty(0, np.uint64)
    count = len(words)
    span = min(width, count)
    total = np.zeros(count - span + 1, np.uint64)
    for k in range(span):
        total = total * np.uint64(0xA0761D6478BD642F) + words[k : k + len(total)]
    return np.unique(mix64(total + np.uint64(span)))


def text_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty; lower turns A-Z alone into lower case."""
    values = column.cast(pa.binary()).to_pylist()
    return [(v.lower() if lower else v) if v else b"" for v in values]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


# ------------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node it reaches.

    Distributed union-find by contraction: each node points at its smallest neighbour, pointers are followed
    to their roots by doubling, and links between roots, without those that have become one, are what
    the next round works on; at most half of the nodes remain each time. Tables live in the shared folder; only one
    count per step comes to the driver. Rows are pre-aggregated before they are shuffled, and a node with many
    links is a join key that adaptive execution can split. Self links, repeated links and null ends are
    harmless; no links give no rows.
    """
    pairs = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    pairs = materialise(pairs.where("a < b").distinct(), f"{name}-edges")
    labels = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        while True:
            after = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
            roots = roots.join(after, "to").select("node", F.col("root").alias("to"), (F.col("root") < F.col("to")).alias("moved"))
            roots = materialise(roots, f"{name}-roots")
            done = not roots.where("moved").limit(1).count()
            roots = roots.select("node", "to")
            if done:
                break
        if labels is None:
            labels = roots.select("node", F.col("to").alias("component"))
        else:
            further = roots.select(F.col("node").alias("component"), "to")
            labels = materialise(labels.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{name}-labels")
        left, right = (roots.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        pairs = pairs.join(left, "a").join(right, "b").where("a_to <> b_to")
        pairs = materialise(pairs.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{name}-contracted")
        if not pairs.limit(1).count():
            return labels
