"""Exact deduplication by content sort, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, field, materialise, numbered_rows, only_rows

#: At most this many texts can be common enough to be dealt over several sort partitions.
MAX_HOT = 2048
#: Rows of a sort range, about: more of them make more ranges than the session's shuffle partitions.
RANGE_ROWS = 50_000


def _runs(base: DataFrame, max_hot: int) -> DataFrame:
    """base(row, doc_id, norm) with keep_id, group_size, kept and text_sha256 in place of norm."""
    base = base.withColumn("h", F.xxhash64("norm"))
    total = base.count()
    hot = materialise(
        base.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") * max_hot > total + max_hot)
        .select("h", (F.col("n") * max_hot / total).cast("int").alias("ways")),
        "hot-texts",
    )
    dealt = (
        base.join(F.broadcast(hot), "h", "left")
        .withColumn("salt", F.when(F.col("ways").isNotNull(), F.pmod(F.xxhash64("row"), F.col("ways") + 1)).otherwise(F.lit(0)))
        .select("row", "doc_id", "norm", "h", "salt", F.col("ways").isNotNull().alias("hot"), F.substring("norm", 1, 32).alias("head"))
    )
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS), 1)
    ranged = dealt.repartitionByRange(parts, "head", "h", "salt")
    run = Window.partitionBy("head", "h", "salt", "norm")
    first = run.orderBy(F.col("doc_id").asc_nulls_last(), "row")
    runs = ranged.select(
        "row", "doc_id", "hot", "norm",
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("sub_keep"),
        F.first("row").over(first).alias("sub_row"),
        F.count(F.lit(1)).over(run).alias("sub_size"),
    ).select("row", "doc_id", "hot", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "place", "sub_keep", "sub_row", "sub_size")
    runs = materialise(runs, "runs")
    heads = runs.where("hot AND place = 1").groupBy("text_sha256").agg(
        F.min(F.struct(F.col("sub_keep").isNull().alias("none"), "sub_keep", "sub_row")).alias("all"), F.sum("sub_size").alias("all_size")
    )
    heads = heads.select("text_sha256", F.col("all.sub_keep").alias("all_keep"), F.col("all.sub_row").alias("all_row"), "all_size")
    return (
        runs.join(F.broadcast(heads), "text_sha256", "left")
        .select(
            "row",
            "doc_id",
            F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("sub_keep")).alias("keep_id"),
            F.coalesce("all_size", "sub_size").cast("long").alias("group_size"),
            (F.col("row") == F.coalesce("all_row", "sub_row")).alias("kept"),
            "text_sha256",
        )
    )


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ").alias("norm")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hot: int = MAX_HOT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Method: normalised texts (each run of white space as one space, null as empty) are range-partitioned
    by sampled splitters into at least a range for RANGE_ROWS rows, sorted with spilling, and each text is compared in full with its neighbours; the
    smallest id of a run of equals stays. A splitter holds the first 32 characters and a 64-bit hash, so
    what the driver samples is bounded however long the texts are; texts with equal heads are ordered by the hash
    before they are by content. A text that more than rows / max_hot rows share is salted over several ranges, each of which
    is sorted the same way; the ranges' smallest ids and sizes then meet by SHA-256, at most
    2 * max_hot rows, and go back as a broadcast of that bound.

    Defined cases: null or empty texts are equal to each other; a null id sorts after all others; rows that
    repeat an id count as separate members, of which exactly one stays; an empty table gives no rows; other
    columns of docs are ignored, whatever their names.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _normal(F.col(text_col)))
    return _runs(base, max_hot).drop("row")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hot: int = MAX_HOT) -> DataFrame:
    """One row of docs for each different text, with all its columns, by exact_duplicates().

    Rows are told apart by numbers of their own: of rows that repeat an id and a text one stays; of those that
    repeat an id with other texts each is judged by its text. Null ids give way to others; of several null ids any one stays.
    Columns of any names pass through unchanged; an empty table gives no rows.
    """
    rows = numbered_rows(docs, id_col)
    return only_rows(rows, _runs(rows.select("row", field(id_col).alias("doc_id"), _normal(field(text_col))), max_hot).where("kept"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
