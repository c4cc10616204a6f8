"""Fuzzy deduplication of lines by MinHash over character shingles."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, long_ids, materialise, mix64, named, numbered_rows, signed, spread_join, text_bytes
from .near_dedup import BITS, MARGIN, coefficients, exact_components, loose_clusters, nonzero_groups

#: Bytes of a character shingle, at most; a shorter line is one shingle.
SHINGLE = 8
#: One-permutation MinHash: each shingle falls into one of BINS bins, whose minimum is kept.
BINS, BANDS, ROWS = 96, 24, 4
WORDS = BINS * BITS // 64
#: Two lines of at most FEW distinct shingles meet by exact keys, of SHARED shingles that both must hold.
FEW, SHARED = 32, 3
#: Up to SHORT distinct shingles many bins are empty, and a band holds fewer than ROWS different shingles: a word in common
#: would do. Bands of such lines are of as many minima of all shingles, each under a hash of its own.
SHORT = 128
#: Distinct shingles of a line are counted from below by the places that they fill out of SLOTS.
SLOTS = 1024
#: Keys are shuffled in so many passes, one after another: they are more bytes than the lines.
PASSES = 2


def normal_line(line: bytes) -> bytes:
    """Lower-cased (A-Z), outer white space off, inner runs of white space as one space."""
    return b" ".join(line.lower().split())


def line_number(line: bytes) -> int:
    """64-bit number of a normalised line."""
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _windows(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, shingle, whether one starts here) for each byte of the lines; the bytes themselves are the shingle."""
    lengths = np.array([len(x) for x in lines])
    raw = np.frombuffer(b"".join(lines) + b"\0" * SHINGLE, np.uint8)
    value = np.ndarray(len(raw) - SHINGLE, "<u8", raw, strides=(1,)).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), lengths)
    end = np.cumsum(lengths)
    # The last SHINGLE - 1 places of a line start no shingle, but a short line's first place is its only one.
    starts = np.ones(len(value), bool)
    for back in range(1, SHINGLE):
        starts[(end - back)[lengths >= back]] = False
    short = np.flatnonzero(lengths < SHINGLE)
    if len(short):
        begin = (end - lengths)[short]
        masks = np.array([(1 << (8 * k)) - 1 for k in range(SHINGLE)], np.uint64)[lengths[short]]
        value[begin] &= masks
        starts[begin] = True
    return owner, value, starts


def line_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingles of each line, normalised here."""
    if not texts:
        return []
    lines = [normal_line(t) for t in texts]
    owner, value, starts = _windows(lines)
    value = value[starts]
    ends = np.cumsum(np.bincount(owner[starts], minlength=len(lines)))
    out = []
    for part in np.split(value, ends[:-1]):
        part.sort()
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part)
    return out


def signatures(lines: list[bytes]) -> np.ndarray:
    """(lines, BINS) minima; an empty bin has the largest value."""
    owner, value, starts = _windows(lines)
    hashed = value * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    bins = ((hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    owner *= BINS
    bins += owner
    bins[~starts] = len(lines) * BINS  # a place after the last line's bins takes what is no shingle
    low = np.full(len(lines) * BINS + 1, 0xFFFFFFFF, np.uint32)
    np.minimum.at(low, bins, ((hashed ^ (hashed >> np.uint64(29))) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return low[:-1].reshape(len(lines), BINS)


def filled_bins(low: np.ndarray) -> np.ndarray:
    """signatures() where an empty bin takes the next filled one, marked by its distance."""
    place = np.where(low != 0xFFFFFFFF, np.arange(BINS), 4 * BINS)
    twice = np.concatenate([place, place + BINS], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    gap = (following - np.arange(BINS)).astype(np.uint64)
    filled = np.take_along_axis(low, following % BINS, axis=1).astype(np.uint64)
    return np.where(gap > 0, mix64(filled + gap * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(0xFFFFFFFF), filled).astype(np.uint32)


def minima(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS * ROWS) minima of all shingles, each under a hash of its own."""
    owner, value, starts = _windows(lines)
    x, owner = (mix64(value[starts]) >> np.uint64(32)).astype(np.uint32), owner[starts]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    scale, shift = coefficients()
    return np.stack([np.minimum.reduceat(x * scale[k] + shift[k], begin) for k in range(BANDS * ROWS)], axis=1)


def least_sizes(lines: list[bytes]) -> np.ndarray:
    """So many distinct shingles each line has at least, up to SLOTS; nearly as many as it has where they are few beside SLOTS."""
    owner, value, starts = _windows(lines)
    places = owner * SLOTS
    places += (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % SLOTS
    places[~starts] = len(lines) * SLOTS  # as in signatures()
    filled = np.zeros(len(lines) * SLOTS + 1, bool)
    filled[places] = True
    return filled[:-1].reshape(len(lines), SLOTS).sum(axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys of filled_bins() or minima()."""
    cube = low[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), cube.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0xA0761D6478BD642F) + cube[:, :, k])
    return key


def exact_keys(sets: np.ndarray, percent: int) -> np.ndarray:
    """(lines, keys) of sets (lines, n) of n shingles each: any two sets at the threshold have a key in common.

    Such sets share at least need = percent / 100 of either's size. Sorted by hash, the first SHARED shingles
    that they share have need - SHARED others of both after them, so both have them among the first
    n - need + SHARED; the key is those SHARED. Sets that may share fewer have keys of fewer, from all shingles.
    """
    n = sets.shape[1]
    order = np.sort(mix64(sets), axis=1)
    need = max(1, -(-percent * n // 100))
    out = []
    for shared in range(min(need, SHARED), SHARED + 1):
        width = n - max(need, shared) + shared
        if shared > n:
            break
        chosen = np.array(list(itertools.combinations(range(width), shared)))
        key = np.full((len(order), len(chosen)), shared, np.uint64)
        for k in range(shared):
            key = mix64(key * np.uint64(0xE7037ED1A0B428DB) + order[:, chosen[:, k]])
        out.append(key)
    return np.concatenate(out, axis=1)


def _keys(lines: list[bytes], low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys by which candidates meet, line after line; how many each line has).

    Lines of up to FEW distinct shingles have exact keys, those of up to SHORT bands of minima, others bands of bins.
    A line that may be linked to one of fewer shingles has the keys of its kind, too; so lines are
    ruled out by bounds of their size alone: no more shingles than places to start one, no fewer than least_sizes().
    """
    size = (low != 0xFFFFFFFF).sum(axis=1)  # as many distinct shingles, at least
    maybe = np.flatnonzero(size <= FEW)
    sets = line_sets([lines[k] for k in maybe])
    size[maybe] = [len(x) for x in sets]
    most = np.array([max(len(x) - SHINGLE + 1, 1) for x in lines], np.int64)
    most[maybe] = size[maybe]
    wide = np.flatnonzero(most > SHORT)
    if len(wide):  # what a line has at its beginning is enough to tell that it has more than a line linked to a short one
        size[wide] = np.maximum(size[wide], least_sizes([lines[k][: SHORT * 150 // percent + SHINGLE] for k in wide]))
    short = np.flatnonzero((size * 100 > FEW * percent) & (size * percent <= SHORT * 100))
    keys, owner = [band_keys(filled_bins(low[wide])).ravel()], [np.repeat(wide, BANDS)]
    if len(short):
        keys.append(mix64(band_keys(minima([lines[k] for k in short])) + np.uint64(1)).ravel())
        owner.append(np.repeat(short, BANDS))
    for n in np.unique(size[size <= FEW]):
        at = [k for k, x in enumerate(sets) if len(x) == n]
        key = exact_keys(np.stack([sets[k] for k in at]), percent)
        keys.append(key.ravel())
        owner.append(np.repeat(maybe[at], key.shape[1]))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lines))


def _linkable(left: str, right: str, percent: int, words: int):
    """Column: the bins that differ are no more than shingles may, nor MARGIN standard errors over their mean at the threshold.

    A shingle of one line only changes its own bin and no other, so the first test drops no link. The second
    counts the bins filled in either line; it is the stricter one from about 150 shingles on, where most bins are filled.
    """
    each = range(words)
    differ = sum((nonzero_groups(F.col(f"{left}s{k}").bitwiseXOR(F.col(f"{right}s{k}"))) for k in each), F.lit(0))
    filled = sum((nonzero_groups(F.col(f"{left}s{k}").bitwiseOR(F.col(f"{right}s{k}"))) for k in each), F.lit(0))
    size = sum(F.greatest(F.col(f"{side}n_shingles").cast("long") - (SHINGLE - 1), F.lit(1)) for side in (left, right))  # lengths in bytes here
    odd = (1 - percent / 100) * (1 - 1 / ((1 << BITS) - 1))
    return (differ * (100 + percent) <= size * (100 - percent)) & (differ <= filled * odd + MARGIN * F.sqrt(filled * (odd * (1 - odd))))


def _signed_lines(batches: Iterator[pa.RecordBatch], percent: int = 80) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word; keys and packed bits (0 for an empty bin) for the first of equal lines in a run."""

    def flush(rows: list, fresh: list[bytes]) -> pa.RecordBatch:
        low = signatures(fresh) if fresh else np.empty((0, BINS), np.uint32)
        key, counts = _keys(fresh, low, percent)
        per = 64 // BITS
        bits = np.where(low != 0xFFFFFFFF, 1 + low % np.uint32((1 << BITS) - 1), 0).astype(np.uint64).reshape(len(low), WORDS, per)
        packed = signed((bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64))
        first = np.array([r[5] for r in rows], np.int64)
        has = first >= 0
        lengths = np.zeros(len(rows), np.int64)
        lengths[has] = counts
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        bands = pa.ListArray.from_arrays(offsets, pa.array(signed(key)), mask=pa.array(~has))
        take = pa.array(np.where(has, first, 0), mask=~has)
        words = [pa.array(np.ascontiguousarray(packed[:, k])).take(take) for k in range(WORDS)]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, bands, *words], names=["row", "doc_id", "line", "h", "n_shingles", "bands", *[f"s{k}" for k in range(WORDS)]])

    for batch in batches:
        rows, fresh, seen, size = [], [], {}, 0
        for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
            for number, line in enumerate(text.split(b"\n")):
                plain = normal_line(line)
                if not plain:
                    continue
                h = line_number(plain)
                if h in seen:
                    rows.append((row, doc, number, h, len(plain), -1))
                    continue
                seen[h] = True
                rows.append((row, doc, number, h, len(plain), len(fresh)))
                fresh.append(plain)
                size += len(plain)
                if size > 1 << 20:
                    yield flush(rows, fresh)
                    rows, fresh, size = [], [], 0
        if rows:
            yield flush(rows, fresh)


def _components(base: DataFrame, percent: int) -> DataFrame:
    """base(row, doc_id, text), written, as row, doc_id, line, h, component, kept: a row for each line with a word."""
    words = [f"s{k}" for k in range(WORDS)]
    schema = "row long, doc_id long, line int, h long, n_shingles int, bands array<long>, " + ", ".join(f"{w} long" for w in words)
    wide = materialise(base.mapInArrow(lambda batches: _signed_lines(batches, percent), schema), "line-signatures")
    lines = wide.select("row", "doc_id", "line", "h")
    reps = wide.where("bands IS NOT NULL").select(F.col("h").alias("node"), "n_shingles", "bands", *words)
    clusters, stars = loose_clusters(reps, percent, WORDS, repeated=True, linkable=_linkable, passes=PASSES)
    order, key, key_of, line_of = _place(base, lines)
    firsts = materialise(lines.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first-lines")
    wanted = clusters.join(firsts, F.col("node") == F.col("h")).select("node", key_of.alias(key), line_of.alias("line"))
    wanted = wanted.groupBy(key).agg(F.collect_list(F.struct("node", "line")).alias("wanted"))  # at most a document's lines
    pick = lambda held: F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.get(held, w["line"]).alias("text")))
    texts = wanted.join(base.select(key, "text"), key).select(F.inline(_of_lines(F.col("text"), pick)))
    component = exact_components(materialise(texts, "line-texts"), clusters, stars, line_sets, percent, "lines")
    # Only lines that repeat or have a link can have a keeper that is not themselves.
    linked = materialise(component.join(firsts, F.col("node") == F.col("h")).select("h", "component", "first", "n"), "linked-lines")
    keepers = materialise(linked.groupBy("component").agg(F.min("first").alias("keeper"), F.count("*").alias("n")), "line-keepers")
    linked = spread_join(linked.select("h", "component", F.col("n").alias("rows")), keepers, ["component"], "h").select("h", "component", "keeper", F.col("rows").alias("n"))
    alone = firsts.where("n > 1").join(linked.select("h"), "h", "left_anti").select("h", F.col("h").alias("component"), F.col("first").alias("keeper"), "n")
    homes = materialise(linked.union(alone), "line-homes")
    found = spread_join(lines, homes, ["h"], "row", "left")
    return found.select("row", "doc_id", "line", "h", F.coalesce("component", "h").alias("component"), F.coalesce(order == F.col("keeper"), F.lit(True)).alias("kept"))


def _of_lines(text, body):
    """body of the array of a text's lines, which is split once; a lambda in body would split it for each of its elements."""
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), body), 1)


def _place(base: DataFrame, lines: DataFrame):
    """(a column that orders lines by document and number, a column that tells documents apart, both of them from a column named first).

    Where ids tell all documents apart and both numbers fit into one long, they are packed, which aggregates by hash; else they are a struct.
    """
    ids = base.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    ends = lines.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("line").alias("line")).first()
    if ids["rows"] == ids["ids"] and (ends["low"] is None or (ends["low"] >= 0 and ends["high"] < 1 << 42 and ends["line"] < 1 << 21)):
        packed = F.col("doc_id") * F.lit(1 << 21) + F.col("line")
        return packed, "doc_id", F.shiftright("first", 21), F.col("first").bitwiseAND(F.lit((1 << 21) - 1)).cast("int")
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line"), "row", F.col("first.row"), F.col("first.line")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return numbered_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "texts")


def line_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, h, component, kept): a row for each line with a word; one line of each component is kept.

    Lines (split at line feeds, numbered from 0) are equal if they are after normal_line(); two different lines
    are linked if the Jaccard similarity of their sets of SHINGLE-byte shingles is at least percent / 100.
    The kept line of a component is the first of the document with the smallest id, null after all others; documents
    that repeat an id are told apart. Exact keys find
    candidates among lines of up to FEW distinct shingles, band keys the others (a pair at 0.8 shares none with probability
    4e-6; bands are of minima over all shingles up to SHORT of them, of bins beyond), full sets confirm them in blocks of
    bounded size, and union-find joins the links.
    """
    base, names = long_ids(_narrow(docs, id_col, text_col), "id", "text")
    return named(_components(base, percent).drop("row"), names, "doc_id")


def line_report(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with a word), n_kept, removed (numbers of dropped lines).

    Defined cases: null or empty texts have no lines; lines of white space are not counted and never dropped; a
    null id comes after all others, and ids may be of any type with an order; rows that repeat an id are each reported with their own lines; an
    empty table gives no rows; other columns are ignored. A very long text is split once for its line keys and once more for the lines that have
    candidates, so the work follows its length; a very long line goes through in one piece.
    """
    rows = _narrow(docs, id_col, text_col)
    base, names = long_ids(rows, "id", "text")
    found = _components(base, percent)
    by_doc = found.groupBy("row").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("kept").cast("long")).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line")))).alias("removed"),
    )
    ids = rows.select("row", (field("id").cast("long") if names is None else field("id")).alias("doc_id"))
    return ids.join(by_doc, "row", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"),
        F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that are not kept taken out of the text; all other columns pass through, whatever their names.

    Rows that repeat an id are told apart: of a line that all of them hold, one stays in one of them. Null and empty
    texts stay as they are; an empty table gives no rows.
    """
    rows = numbered_rows(docs, id_col)
    gone = _components(long_ids(rows, id_col, text_col)[0], percent).where("NOT kept").groupBy("row").agg(F.collect_set("line").alias("gone"))
    joined = rows.join(gone, "row", "left")
    stay = lambda held: F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), "gone"), lambda i: F.get(held, i))
    text = F.array_join(_of_lines(field(text_col), stay), "\n")
    return joined.select(*[F.when(F.col("gone").isNull(), field(c)).otherwise(text).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns])
