"""Vector code compression: product codes of integer vectors, nearest entries by segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances to all entries are held at a time.
BLOCK = 2048
#: Slack of a lower bound, some ten times the rounding of doubles and more, so that no bound passes the true distance.
NEAR, FAR, LEAST = 1e-6, 1e-12, 1e-6


def largest_component(width: int) -> int:
    """Integers are held within this, so that the squared distance of two vectors of that width fits a long."""
    return 1 << ((62 - max(width - 1, 1).bit_length()) // 2 - 1)


def levels(width: int) -> list[int]:
    """Numbers of blocks from coarse to fine: 1, 2, 4 and so on, as long as they divide the width and are fewer."""
    out, blocks = [1], 2
    while width % blocks == 0 and blocks < width:
        out.append(blocks)
        blocks *= 2
    return out


class Outline:
    """Block sums and residual norms of integer vectors (n, width) at each level.

    Over blocks of b components, the squared distance of x and c is the sum of b * (mean_x - mean_c)^2 and of what the
    residuals x - mean add; the latter is at least the square of the difference of their norms.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        whole = vectors.astype(np.float64)
        self.square, self.sums, self.norms = (whole * whole).sum(axis=1), [], []
        for blocks in levels(vectors.shape[1]):
            size = vectors.shape[1] // blocks
            sums = whole.reshape(len(vectors), blocks, size).sum(axis=2)
            self.sums.append(sums / np.sqrt(size))
            self.norms.append(np.sqrt(np.maximum(self.square - (sums * sums).sum(axis=1) / size, 0)))


def _bound(x: Outline, book: Outline, level: int, rows, entries) -> np.ndarray:
    """Lower bounds of the squared distances of rows and entries, which broadcast."""
    gap = x.norms[level][rows] - book.norms[level][entries]
    total = gap * gap
    for block in range(x.sums[level].shape[1]):
        gap = x.sums[level][rows, block] - book.sums[level][entries, block]
        total = total + gap * gap
    size = np.maximum(x.square[rows], book.square[entries])  # what rounding follows, most of all in the norms, a difference of squares
    return total - NEAR * np.sqrt(total * size) - FAR * size - LEAST


def _exact(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    gap = x - book
    return (gap * gap).sum(axis=1)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry (n_entries, width) for each of vectors (n, width); ties to the lower index.

    From coarse to fine, an entry stays if its lower bound is not over the exact distance of the best one so far; survivors
    of the finest level get exact integer distances.
    """
    book, best, least = Outline(entries), np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for first in range(0, len(vectors), BLOCK):
        part = vectors[first : first + BLOCK]
        x, every = Outline(part), np.arange(len(part))
        rows, held, upper = every, None, None
        for level in range(len(x.sums)):
            if held is None:
                low = _bound(x, book, level, every[:, None], np.arange(len(entries))[None, :])
                upper = _exact(part, entries[low.argmin(axis=1)])
                rows, held = np.nonzero(low <= upper[:, None])
            else:
                low = _bound(x, book, level, rows, held)
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                lowest = np.repeat(np.minimum.reduceat(low, starts), np.diff(np.append(starts, len(rows))))
                found = np.flatnonzero(low == lowest)
                upper = upper.copy()
                np.minimum.at(upper, rows[found], _exact(part[rows[found]], entries[held[found]]))
                stay = low <= upper[rows]
                rows, held = rows[stay], held[stay]
        exact = _exact(part[rows], entries[held])
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        lowest = np.minimum.reduceat(exact, starts)
        at = np.flatnonzero(exact == np.repeat(lowest, np.diff(np.append(starts, len(rows)))))
        firsts = at[np.concatenate(([True], rows[at][1:] != rows[at][:-1]))]  # entries ascend within a row
        best[first : first + len(part)], least[first : first + len(part)] = held[firsts], lowest
    return best, least


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (n, parts), of vectors (n, dimensions) under books (parts, entries, width)."""
    width = books.shape[2]
    found = [nearest(np.ascontiguousarray(vectors[:, p * width : (p + 1) * width]), book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(books: np.ndarray):
    """A task's sums of its vectors' parts by entry: one row for each entry that it uses."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0))
                codes, _ = assign(vectors, books)
                at = (codes + np.arange(parts) * entries).ravel()
                np.add.at(total, at, vectors.reshape(-1, width))
                n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *[pa.array(np.ascontiguousarray(total[used, k])) for k in range(width)]], names=["entry", "n", *[f"s{k}" for k in range(width)]])

    return run


def _refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """books with each used entry replaced by the floor of its parts' mean; what comes to the driver is the size of books."""
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]
    sums = vectors.select("vector").mapInArrow(_sums(books), "entry long, n long, " + ", ".join(f"{s} long" for s in names))
    total = sums.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names])
    after = books.copy().reshape(parts * entries, width)
    for row in total.collect():
        after[row["entry"]] = [int(row[s]) // row["n"] for s in names]  # // goes down for negative sums too
    return after.reshape(books.shape)


def _coder(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, far = assign(_matrix(batch.column(2)), books)
                shown = codes.astype(np.uint8) if books.shape[1] <= 256 else codes.astype(">u2")
                text = [row.tobytes().hex() for row in shown]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def clean_vectors(vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS) -> Column:
    """Whether a vector is there, has components, all finite, and as many that parts are equal."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & fine & (F.size(v) > 0) & (F.size(v) % parts == 0), F.lit(False))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vector) of the clean rows, written; vector holds floor(SCALE * x) of each component.

    Rows of another length than the first one's (by id) are left out, as they have no codebook in common.
    """
    whole = vectors.where(clean_vectors(vectors, vector_col, parts)).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), F.size("vector")).select(F.size("vector")).first()
    width = first[0] if first else parts
    top = float(largest_component(width))
    held = F.transform("vector", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(top)), F.lit(-top)) * SCALE), F.lit(int(top))), F.lit(-int(top))).cast("long"))
    return materialise(whole.where(F.size("vector") == width).select("vec_id", "label", held.alias("vector")), "integer-vectors")


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integer_vectors(): the parts of the first vectors by id, refined over all vectors.

    Entries start as those of the smallest ids, null after all others, repeated ids in order of their components; fewer rows give fewer entries. Each
    round reads every vector; a task returns its sums and counts by entry, so the driver meets as many numbers as the codebooks hold.
    """
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not start:
        return np.zeros((parts, 0, 1), np.int64)
    seeds = np.array([r["vector"] for r in start], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): each of integer_vectors() by its nearest entries; code has two hex digits a part (four beyond 256 entries)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name in ("vec_id", "label")) + ", code string, error long"
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select("vec_id", "label", "vector").mapInArrow(_coder(books), schema)


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with a column vector: the integer vector that the code stands for."""
    width = 2 if books.shape[1] <= 256 else 4
    table = F.lit([[[int(v) for v in entry] for entry in book] for book in books])
    place = F.sequence(F.lit(0), F.lit(len(books) - 1))
    part = F.transform(place, lambda p: F.get(F.get(table, p), F.conv(F.substring(F.col("code"), p * width + 1, F.lit(width)), 16, 10).cast("int")))
    return codes.withColumn("vector", F.flatten(part))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per clean row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Defined cases: null vectors, those with null or non-finite components, empty ones and those whose length is no multiple of
    PARTS are dropped, as are rows of another length than the first one's by id; integers are held within largest_component(), which
    matters to components over 2^19 in 64 dimensions; null ids come after all others, repeated ids and equal rows are
    coded each; under ENTRIES rows give as many entries; null labels count together, and label_error is null where a sum does not fit a long; an empty
    table gives no rows; other columns are ignored. Very long vectors only make blocks larger: BLOCK rows of them are held at a time.
    """
    whole = integer_vectors(vectors, id_col, vector_col, label_col)
    books = train_codebooks(whole)
    codes = materialise(vector_codes(whole, books).select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")), "vector-codes")
    sums = materialise(codes.groupBy("none", "key").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return spread_join(codes, sums, ["none", "key"], "code").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


#: DuckDB: all distances of parts to entries, round by round.
ORACLE = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS (
  SELECT vec_id, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, range(16) AS r(p)
),
book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cells QUALIFY e < 64
),
near0 AS (
  SELECT vec_id, p, x, arg_min(e, d * 64 + e) AS e
  FROM (SELECT vec_id, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cells JOIN book0 USING (p))
  GROUP BY vec_id, p, x
),
mean0 AS (
  SELECT p, e, list(m ORDER BY k) AS c FROM (
    SELECT p, e, k, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS m
    FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM near0) GROUP BY p, e, k) GROUP BY p, e
),
book1 AS (SELECT p, e, coalesce(mean0.c, book0.c) AS c FROM book0 LEFT JOIN mean0 USING (p, e)),
near1 AS (
  SELECT vec_id, p, x, arg_min(e, d * 64 + e) AS e
  FROM (SELECT vec_id, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cells JOIN book1 USING (p))
  GROUP BY vec_id, p, x
),
mean1 AS (
  SELECT p, e, list(m ORDER BY k) AS c FROM (
    SELECT p, e, k, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS m
    FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM near1) GROUP BY p, e, k) GROUP BY p, e
),
book2 AS (SELECT p, e, coalesce(mean1.c, book1.c) AS c FROM book1 LEFT JOIN mean1 USING (p, e)),
near2 AS (
  SELECT vec_id, p, min(d * 64 + e) AS best
  FROM (SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cells JOIN book2 USING (p))
  GROUP BY vec_id, p
),
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best % 64 AS INT))), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near2 GROUP BY vec_id
),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""
