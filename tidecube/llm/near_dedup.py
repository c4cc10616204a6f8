"""Near-duplicate documents by b-bit MinHash over word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_HOT, connected_components, long_ids, materialise, mix64, named, numbered_rows, only_rows, shingles, signed, spread_join, text_bytes, tidy_shuffles, word_hashes

#: 40 bands of 6 minima: a pair at similarity 0.8 shares no band with probability 5e-6.
BANDS, ROWS = 40, 6
#: Low bits kept of each minimum; 16 of them fill a 64-bit word.
BITS = 4
WORDS = BANDS * ROWS * BITS // 64
#: Standard errors by which an estimate may fall short of the threshold and still be confirmed on full sets.
MARGIN = 5
#: One key row in SAMPLE is counted to find buckets so full that their rows are dealt over tasks: those with COMMON in the sample.
SAMPLE, COMMON = 64, 8
#: Shingles and members that a block of one candidate cluster holds, about.
BLOCK_SHINGLES, BLOCK_MEMBERS = 400_000, 128


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    half = (seeds >> np.uint64(32)).astype(np.uint32)
    return half[: BANDS * ROWS] | np.uint32(1), half[BANDS * ROWS :]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BANDS * ROWS) minima of the hashed sets; an empty set has the largest value throughout."""
    scale, shift = coefficients()
    out = np.full((len(sets), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for row, values in enumerate(sets):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(out[row], (scale[:, None] * x[None, at : at + 1024] + shift[:, None]).min(axis=1), out=out[row])
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit keys; the band's number goes into its key."""
    cube = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (len(low), BANDS)).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0xA0761D6478BD642F) + cube[:, :, k])
    return key


def packed(low: np.ndarray) -> np.ndarray:
    """(documents, WORDS) 64-bit words of the lowest BITS bits of each minimum."""
    per = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), WORDS, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _signature_schema() -> str:
    return "row long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"s{k} long" for k in range(WORDS))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in word_hashes(text_bytes(batch.column(2), lower=True)):
                sets = [shingles(w, width) for w in words]
                low = minima(sets)
                digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                keys = signed(band_keys(low))
                sig = signed(packed(low))
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                columns = [batch.column(k).slice(first, len(sets)) for k in (0, 1)]
                columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands]
                columns += [pa.array(np.ascontiguousarray(sig[:, k])) for k in range(WORDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"] + [f"s{k}" for k in range(WORDS)])

    return run


def nonzero_groups(x):
    """Column: how many groups of BITS bits of a word are not zero."""
    mask = sum(1 << (BITS * k) for k in range(64 // BITS))
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    shift = 1
    while shift < BITS:
        x = x.bitwiseOR(F.shiftright(x, shift))
        shift *= 2
    return F.bit_count(x.bitwiseAND(F.lit(mask)))


def similarity_estimate(left: str, right: str, words: int = WORDS):
    """Column: collision-corrected similarity of two packed signatures, by counting unequal groups of BITS bits."""
    unequal = sum((nonzero_groups(F.col(f"{left}s{k}").bitwiseXOR(F.col(f"{right}s{k}"))) for k in range(words)), F.lit(0))
    agree = 1 - unequal / F.lit(float(words * 64 // BITS))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def estimate_floor(threshold: float, words: int = WORDS) -> float:
    """The least estimate that goes on to the exact check: MARGIN standard errors under the threshold."""
    chance = 2.0**-BITS
    hit = threshold + (1 - threshold) * chance
    return threshold - MARGIN * (hit * (1 - hit) / (words * 64 // BITS)) ** 0.5 / (1 - chance)


def _with(prefix: str, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in keep])


def _sig(words: int) -> tuple[str, ...]:
    return ("n_shingles", *(f"s{k}" for k in range(words)))


def _linkable(left: str, right: str, percent: int, words: int):
    """Set sizes can still reach the threshold, and the estimate is not far under it."""
    small, large = F.least(f"{left}n_shingles", f"{right}n_shingles"), F.greatest(f"{left}n_shingles", f"{right}n_shingles")
    near = similarity_estimate(left, right, words) >= estimate_floor(percent / 100, words)
    return (small * 100 >= large * percent) & near


def _links_in(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int, cross: bool) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among the members (cross: only between the two blocks)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        shared = int((both[1:] == both[:-1]).sum())
        near = 100 * shared >= percent * (int(sizes.sum()) - shared)
        return [(int(ids[0]), int(ids[1]))] if near else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    index = np.cumsum(new) - 1
    often = np.bincount(index) > 1
    keep = often[index]
    column = (np.cumsum(often) - 1)[index[keep]]
    owner = owner[keep]
    rows = np.flatnonzero(blocks == blocks.min()) if cross else np.arange(len(sets))
    cols = np.flatnonzero(blocks != blocks.min()) if cross else rows
    if not len(rows) or not len(cols):
        return []
    shared = np.zeros((len(rows), len(cols)), np.float64)
    row_at = np.full(len(sets), -1)
    row_at[rows] = np.arange(len(rows))
    col_at = np.full(len(sets), -1)
    col_at[cols] = np.arange(len(cols))
    width = 8192
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        o, c = owner[lo:hi], column[lo:hi] - at
        mine = row_at[o] >= 0
        left[row_at[o[mine]], c[mine]] = 1
        mine = col_at[o] >= 0
        right[col_at[o[mine]], c[mine]] = 1
        shared += left @ right.T
    union = sizes[rows][:, None] + sizes[cols][None, :] - shared
    hit_r, hit_c = np.nonzero(100 * shared >= percent * union)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in zip(rows[hit_r].tolist(), cols[hit_c].tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            links.append((int(ids[a]), int(ids[b])))
    return links


def word_sets(width: int):
    """Texts -> sorted distinct hashes of their word shingles."""

    def make(texts: list[bytes]) -> list[np.ndarray]:
        return [shingles(w, width) for _, words in word_hashes([t.lower() for t in texts]) for w in words]

    return make


def _confirm(make, percent: int):
    """Rows (cluster, i, j, node, block, text) sorted by (cluster, i, j): exact links of each block pair."""

    def flush(groups: list[list], out: list) -> None:
        """Sets of many groups are made together, then each group is compared on its own."""
        sets, at = make([row[2] for rows in groups for row in rows]), 0
        for rows in groups:
            own, at = sets[at : at + len(rows)], at + len(rows)
            ids, blocks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
            out += _links_in(ids, blocks, own, percent, len(rows) > 2 and len(set(blocks.tolist())) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, groups, size, out = None, [], [], 0, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            ids, blocks, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist(), text_bytes(batch.column(5))
            for now, *row in zip(keys, ids, blocks, texts):
                if now != key:
                    if len(rows) > 1:
                        groups.append(rows)
                        size += sum(len(r[2]) for r in rows)
                    key, rows = now, []
                    if size > 1 << 20:
                        flush(groups, out)
                        groups, size = [], 0
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        if len(rows) > 1:
            groups.append(rows)
        flush(groups, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _in_passes(keys: DataFrame, rows, name: str, passes: int) -> DataFrame:
    """rows(keys), written; in passes over the keys by their remainder, so that the shuffle of one pass is there at a time."""
    if passes == 1:
        return materialise(rows(keys), name)
    with tidy_shuffles(keys.sparkSession):
        parts = [materialise(rows(keys.where(F.pmod("key", F.lit(passes)) == k)), name) for k in range(passes)]
    return reduce(DataFrame.union, parts)


def _crowded(reps: DataFrame, passes: int = 1) -> DataFrame:
    """(key, node, pivot) for the rows of reps(node, bands) whose key two nodes have; pivot is the bucket's smallest node.

    One shuffle and sort finds it beside the members. A sample tells which keys are so common, at most MAX_HOT, that
    their buckets are dealt over several tasks, under keys of their own: then each part has a pivot, and a further row for it
    names the smallest of all. What the sample says changes the way, not which nodes meet.
    """
    seen = reps.sample(False, 1 / SAMPLE, 7).select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    seen = materialise(seen, "common-keys")
    total = seen.agg(F.sum("n")).first()[0] or 0
    keys = reps.select("node", F.explode("bands").alias("key"))
    part = Window.partitionBy("key")
    ends = (F.min("node").over(part).alias("pivot"), F.max("node").over(part).alias("last"))
    if not total:
        return _in_passes(keys, lambda own: own.select("key", "node", *ends).where("pivot < last").drop("last"), "crowded", passes)
    limit = max(COMMON, total // MAX_HOT)
    common = seen.where(F.col("n") >= limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("ways"))
    salted = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("ways")))
    names = common.select(F.col("key").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways").cast("long") - 1)).alias("salt"))
    names = names.select(F.xxhash64("whole", "salt").alias("key"), "whole")  # at most 2 * MAX_HOT rows

    def rows(own: DataFrame) -> DataFrame:
        dealt = own.join(F.broadcast(common), "key", "left").select("node", F.when(F.col("ways").isNull(), F.col("key")).otherwise(salted).alias("key"))
        found = dealt.select("key", "node", *ends).join(F.broadcast(names), "key", "left").where("pivot < last OR whole IS NOT NULL")
        return found.select(F.coalesce("whole", "key").alias("key"), "node", "pivot", F.col("whole").isNotNull().alias("hot"))

    found = _in_passes(keys, rows, "crowded", passes)
    tops = found.where("hot AND node = pivot").select("key", "node").distinct()
    first = F.broadcast(tops.groupBy("key").agg(F.min("node").alias("pivot")))
    return found.drop("hot").union(tops.join(first, "key").select("key", "node", "pivot"))


def loose_clusters(reps: DataFrame, percent: int, words: int = WORDS, repeated: bool = False, linkable=_linkable, passes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(clusters, stars) over reps(node, n_shingles, bands, s0..): no exact link leaves a cluster.

    clusters(node, component, n_shingles): classes that share a bucket and whose estimate is not clearly under the threshold end in
    one cluster. stars(a, b): the likely links of nodes to the smallest node of a bucket. repeated: reps may hold a
    class several times, with equal columns. linkable: the column that tells likely pairs. passes: over the keys of buckets.
    """
    crowded = _crowded(reps, passes)
    signature = reps.select("node", *_sig(words))
    if repeated:
        signature = materialise(signature.join(crowded.select("node"), "node", "left_semi").distinct(), "crowded-classes")
    pairs = materialise(crowded.where("node <> pivot").select("node", "pivot").distinct(), "pairs")
    pivots = pairs.groupBy("pivot").agg(F.count("*").alias("n")).join(_with("r_", signature, ("node", *_sig(words))), F.col("pivot") == F.col("r_node"))
    left = pairs.join(_with("l_", signature, ("node", *_sig(words))), F.col("node") == F.col("l_node"))
    tried = spread_join(left, materialise(pivots, "pivots"), ["pivot"], "node").select("node", "pivot", linkable("l_", "r_", percent, words).alias("likely"))
    tried = materialise(tried, "tried")
    star = tried.where("likely").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    loose = connected_components(star, "loose")

    # Buckets whose members are all in their pivot's cluster are done; the others have a pair that is not likely, of two clusters.
    label = lambda c: F.coalesce(f"{c}_label", c)
    apart = tried.where("NOT likely").select("node", "pivot")
    for c in ("node", "pivot"):
        apart = apart.join(loose.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label")), c, "left")
    apart = materialise(apart.where(label("node") != label("pivot")).select("node", "pivot"), "apart")
    open_keys = materialise(crowded.join(apart, ["node", "pivot"], "left_semi").select("key").distinct(), "open-keys")
    members = crowded.select("key", "node").join(open_keys, "key", "left_semi").distinct()
    members = members.join(loose, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    members = materialise(members, "members")
    parts = members.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("labels"))
    mixed = materialise(mixed.where("labels > 1").drop("labels"), "mixed")
    ways = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    spread = spread_join(members, mixed, ["key"], "node").withColumn("ways", ways)
    spread = materialise(spread.join(signature, "node"), "spread")
    odd = _with("l_", spread.where("label <> main"), ("key", "node", "label", "ways", *_sig(words)))
    odd = odd.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.col("l_ways") - 1)))
    rest = _with("r_", spread.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")), ("key", "node", "label", "main", "salt", *_sig(words)))
    other = (F.col("l_label") != F.col("r_label")) & ((F.col("r_label") == F.col("r_main")) | (F.col("l_node") < F.col("r_node")))
    met = (F.col("l_key") == F.col("r_key")) & (F.col("l_salt") == F.col("r_salt"))
    across = odd.join(rest, met & other & linkable("l_", "r_", percent, words))
    across = materialise(across.select(F.col("l_label").alias("a"), F.col("r_label").alias("b")).distinct(), "across")
    if across.limit(1).count():
        # A label is the smallest node of its cluster, or a node on its own: clusters join by their labels.
        merged = connected_components(across, "closed").select(F.col("node").alias("component"), F.col("component").alias("to"))
        alone = across.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        loose = loose.union(alone.select("node", F.col("node").alias("component"))).distinct()
        loose = loose.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(loose.join(signature.select("node", "n_shingles"), "node"), "clusters"), star


def _blocks(shingles, members):
    """Column: blocks for so many shingles and members; none for no member."""
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(members / BLOCK_MEMBERS)).cast("int")


def exact_components(texts: DataFrame, clusters: DataFrame, stars: DataFrame, make, percent: int, name: str) -> DataFrame:
    """(node, component) by exact links inside clusters(node, component, n_shingles); texts(node, text) are compared as make's sets.

    First each node meets the smallest node that its stars name, which joins most of a group of near copies in
    one comparison a node. What is left of a cluster are its parts by those links: nodes outside the largest
    part then meet all nodes of the cluster, in blocks of bounded size, so no pair of parts goes unseen and a
    text is copied once for each block it meets. Nodes without a link are not in the result.
    """
    size = clusters.select("node", "n_shingles")
    hubs = stars.groupBy("a").agg(F.min("b").alias("hub"))
    hubs = materialise(hubs.join(size, F.col("a") == F.col("node")).select("a", "hub", "n_shingles"), f"{name}-hubs")
    counts = hubs.groupBy("hub").agg(F.count("*").alias("n"), _blocks(F.sum("n_shingles"), F.count("*")).alias("ways"))
    counts = materialise(counts, f"{name}-hub-counts")
    dealt = spread_join(hubs, counts, ["hub"], "a").select(F.col("hub"), F.pmod(F.xxhash64("a"), F.col("ways")).cast("int").alias("i"), F.col("a").alias("node"), F.lit(1).alias("block"))
    own = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("i"), F.col("hub").alias("node"), F.lit(0).alias("block"))
    met = dealt.union(own).join(texts, "node").select("hub", "i", F.lit(0).alias("j"), "node", "block", "text")
    dealt = met.repartition("hub", "i").sortWithinPartitions("hub", "i")
    first = materialise(dealt.mapInArrow(_confirm(make, percent), "a long, b long"), f"{name}-star-links")
    joined = connected_components(first, f"{name}-stars")

    placed = clusters.join(joined.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = materialise(placed, f"{name}-placed")
    parts = placed.groupBy("component", "part").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    parts = parts.groupBy("component").agg(
        F.max_by(F.struct("part", "m", "s"), F.struct("m", "part")).alias("main"), F.sum("m").alias("n"), F.sum("s").alias("all"), F.count("*").alias("parts")
    ).where("parts > 1")
    parts = parts.select(
        "component", "n", F.col("main.part").alias("main"),
        _blocks(F.col("all") - F.col("main.s"), F.col("n") - F.col("main.m")).alias("odd"), _blocks(F.col("main.s"), F.col("main.m")).alias("even"),
    )
    open_ = spread_join(placed, materialise(parts, f"{name}-parts"), ["component"], "node")
    in_main, h = F.col("part") == F.col("main"), F.xxhash64("node")
    open_ = open_.select(
        "node", "component", "odd", F.when(in_main, F.col("odd") - 1).otherwise(F.col("odd") + F.col("even") - 1).alias("last"),
        F.when(in_main, F.col("odd") + F.pmod(h, F.col("even"))).otherwise(F.pmod(h, F.col("odd"))).cast("int").alias("block"),
    )
    met = open_.join(texts, "node").select("component", "node", "block", "text", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "text")
    dealt = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    second = materialise(dealt.mapInArrow(_confirm(make, percent), "a long, b long"), f"{name}-part-links")
    if not second.limit(1).count():
        return joined
    return connected_components(first.union(second), f"{name}-exact")


def _components(base: DataFrame, width: int, percent: int) -> DataFrame:
    """base(row, doc_id, text), written, as row, doc_id, n_shingles, component (null without a set), component_id."""
    sigs = materialise(base.mapInArrow(_signatures(width), _signature_schema()), "signatures")
    sets = sigs.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    sets = materialise(sets, "sets")
    reps = sigs.withColumnRenamed("row", "node").select("node", "bands", *_sig(WORDS)).join(sets.select("node"), "node", "left_semi")
    reps = materialise(reps, "classes")
    clusters, stars = loose_clusters(reps, percent)
    component = exact_components(base.select(F.col("row").alias("node"), "text"), clusters, stars, word_sets(width), percent, "docs")
    linked = materialise(sets.join(component, "node").select("node", "component", "least"), "linked")
    smallest = materialise(linked.groupBy("component").agg(F.min("least").alias("smallest"), F.count("*").alias("n")), "smallest")
    linked = spread_join(linked.drop("least"), smallest, ["component"], "node").drop("n")
    named = materialise(
        sets.join(linked, "node", "left")
        .select("set_a", "set_b", "n", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")),
        "named",
    )
    found = spread_join(sigs.select("row", "doc_id", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b"], "row", "left")
    return found.select("row", "doc_id", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id is component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct
    shingles of `width` lower-cased (A-Z) words; a component is what links reach, and its smallest id stays.

    Method: (1) one pass makes MinHash signatures, band keys and packed low bits. (2) Documents with the
    same set are one class from here on, so copies cost nothing. (3) In each bucket of a band all members
    are compared, by the collision-corrected estimate from bit counts, with the bucket's first class;
    pairs not clearly under the threshold join loose clusters. (4) Buckets that still hold several
    clusters compare across clusters the same way, without a cap. (5) Inside each loose cluster, full
    shingle sets are compared exactly, in blocks of bounded size, and only exact links are kept.
    (6) Union-find over those links.

    Memory follows the block size and the longest text; groups of any size are split into block pairs, and rows of a
    common key are dealt over several tasks. Defined cases: null, empty or white-space texts have no set, are linked
    with nothing and stay; a text shorter than `width` words is one shingle; a null id is linked like any other and
    comes after all numbers, so component_id is null only where all ids are; rows that repeat an id are compared
    by their own texts and all get the least id that any of them reaches; ids may be of any type with an order; an empty table gives no rows; other columns are ignored.
    """
    rows = numbered_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "texts")
    base, names = long_ids(rows, "id", "text")
    found = named(_components(base, width, percent).drop("row", "component"), names, "doc_id", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component of near_duplicates(), with all its columns, and all rows without a set.

    The row with the smallest id stays; of rows that repeat it, the first one by a number given here. Rows that repeat an id are
    told apart, and columns of any names pass through unchanged. An empty table gives no rows.
    """
    rows = numbered_rows(docs, id_col)
    found = _components(long_ids(rows, id_col, text_col)[0], width, percent)
    first = found.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("row"))
    return only_rows(rows, first.select("row").union(found.where("component IS NULL").select("row")))
