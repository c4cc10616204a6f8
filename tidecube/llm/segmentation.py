"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bytes of text whose lattices are built together.
RUN = 2 << 20
#: Pieces have probability in proportion to (rank + RANK_SHIFT) ** -SHARPNESS; the model's scores are merge ranks.
RANK_SHIFT, SHARPNESS = 10.0, 1.0
_MARK = "▁"
#: No piece reaches over the start of such a unit: spaces stand only at a piece's start, line feeds in none.
_UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: hashes of all prefixes of pieces, pieces' ids and log-probabilities, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.decoded: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        prefixes: dict[int, int] = {}
        self.logp = np.full(size, -np.inf)
        ranks = np.array([-model.get_score(i) for i in range(size)])
        self.longest = 1
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_id[value], self.decoded[i] = i, bytes([value])
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            self.decoded[i] = text.replace(_MARK, " ").encode()
            self.longest = max(self.longest, len(text))
            value = 0
            for k, ch in enumerate(text):
                value = (value * int(_STEP) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.setdefault(value, -1)
                if k + 1 == len(text):
                    prefixes[value] = i
            self.logp[i] = -SHARPNESS * np.log(max(ranks[i], 0.0) + RANK_SHIFT)
        keys = np.array(list(prefixes), np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(prefixes.values()), np.int32)[order]
        self.logp -= np.log(np.exp(self.logp[np.isfinite(self.logp)]).sum() + 256 / (size + RANK_SHIFT))
        #: A character outside the vocabulary is spelt in bytes, each as likely as the last rank.
        self.byte_logp = -SHARPNESS * np.log(size + RANK_SHIFT)

    def lattice(self, units: list[str]):
        """Edges of all units' lattices: (end node, start node, piece or -1 - character, log-probability).

        Units' characters are numbered one after another; node n of a unit is the place before its
        character n, so a unit of k characters has k + 1 nodes.
        """
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(u) for u in units])
        unit = np.repeat(np.arange(len(units)), lengths)
        char_at = np.arange(len(points))
        node_at = char_at + unit
        left = (np.cumsum(lengths))[unit] - char_at
        # A literal mark is not a space: it has no piece and is spelt in bytes; spaces take the mark's place.
        seen = np.where(points == 0x20, ord(_MARK), np.where(points == ord(_MARK), 0x10FFFF + 2, points)).astype(np.uint64)
        active, value = char_at, np.zeros(len(points), np.uint64)
        ends, starts, pieces = [], [], []
        single = np.zeros(len(points), bool)
        for size in range(1, self.longest + 1):
            fits = left[active] >= size
            active, value = active[fits], value[fits]
            if not len(active):
                break
            value = value * _STEP + seen[active + size - 1] + np.uint64(1)
            at = np.searchsorted(self.keys, value)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == value
            active, value, at = active[hit], value[hit], at[hit]
            whole = self.ids[at] >= 0
            ends.append(node_at[active[whole]] + size)
            starts.append(node_at[active[whole]])
            pieces.append(self.ids[at][whole].astype(np.int64))
            if size == 1:
                single[active[whole]] = True
        spelt = np.flatnonzero(~single)
        spelt_bytes = np.where(points[spelt] < 0x80, 1, np.where(points[spelt] < 0x800, 2, np.where(points[spelt] < 0x10000, 3, 4)))
        end = np.concatenate([*ends, node_at[spelt] + 1])
        start = np.concatenate([*starts, node_at[spelt]])
        piece = np.concatenate([*pieces, -1 - spelt])
        logp = np.concatenate([self.logp[np.concatenate(pieces)] if pieces else np.empty(0), spelt_bytes * self.byte_logp])
        first_node = np.cumsum(lengths + 1) - (lengths + 1)
        return points, lengths, first_node, end, start, piece, logp


def _filter_forward(first_node, lengths, end, start, logp):
    """CSR of edges by end node, with each node's cumulative choice probabilities."""
    count = int(first_node[-1] + lengths[-1] + 1) if len(first_node) else 0
    origin = np.repeat(first_node, lengths + 1)
    depth = end - origin[end]
    order = np.lexsort((end, depth))
    end_o, start_o, logp_o, depth_o = end[order], start[order], logp[order], depth[order]
    alpha = np.full(count, -np.inf)
    alpha[first_node] = 0.0
    weight = np.empty(len(end))
    bounds = np.searchsorted(depth_o, np.arange(1, int(depth_o[-1]) + 2)) if len(depth_o) else []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if lo == hi:
            continue
        value = alpha[start_o[lo:hi]] + logp_o[lo:hi]
        node = end_o[lo:hi]
        heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        top = np.maximum.reduceat(value, heads)
        sizes = np.diff(np.append(heads, len(node)))
        share = np.exp(value - np.repeat(top, sizes))
        total = np.add.reduceat(share, heads)
        alpha[node[heads]] = top + np.log(total)
        weight[lo:hi] = share / np.repeat(total, sizes)
    by_end = np.argsort(end_o, kind="stable")
    node, source, edge = end_o[by_end], start_o[by_end], order[by_end]
    running = np.cumsum(weight[by_end])
    heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, int)
    sizes = np.diff(np.append(heads, len(node)))
    before = np.repeat(running[heads] - weight[by_end][heads], sizes) if len(node) else running
    chance = np.clip(running - before, 0.0, 1.0)
    if len(node):
        chance[np.append(heads[1:], len(node)) - 1] = 1.0
    return node, source, edge, chance


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, seed: int) -> list[np.ndarray]:
    """One sampled id array per text; the draws depend on the seed, the text's key and the place in it alone."""
    units, index, counts, uses = [], {}, [], []
    for text in texts:
        found = _UNIT.findall(" " + text) if text else []
        counts.append(len(found))
        for u in found:
            at = index.get(u)
            if at is None:
                at = index[u] = len(units)
                units.append(u)
            uses.append(at)
    if not units:
        return [np.empty(0, np.int32) for _ in texts]
    points, lengths, first_node, end, start, piece, logp = pieces.lattice(units)
    node, source, edge, chance = _filter_forward(first_node, lengths, end, start, logp)
    uses, counts = np.array(uses), np.array(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(uses)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        stream = mix64(keys.astype(np.int64).view(np.uint64)[owner] * np.uint64(0xC2B2AE3D27D4EB4F) + number.astype(np.uint64) * _STEP + np.uint64(seed))
    at = first_node[uses] + lengths[uses]
    origin, alive = first_node[uses], np.arange(len(uses))
    head = np.zeros(int(first_node[-1] + lengths[-1] + 1), np.int64)
    head[node[::-1]] = np.arange(len(node) - 1, -1, -1)
    drawn, places, step = [], [], 0
    while len(alive):
        draw = (mix64(stream[alive] + np.uint64(step * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        pick = head[at]
        late = np.flatnonzero(chance[pick] <= draw)
        while len(late):
            pick[late] += 1
            late = late[chance[pick[late]] <= draw[late]]
        drawn.append(edge[pick])
        places.append(alive)
        at = source[pick]
        going = at > origin[alive]
        alive, at = alive[going], at[going]
        step += 1
    chosen, owner_use = np.concatenate(drawn), np.concatenate(places)
    nth = np.repeat(np.arange(len(drawn)), [len(d) for d in drawn])
    total = np.bincount(owner_use, minlength=len(uses))
    slot = (np.cumsum(total) - total)[owner_use] + total[owner_use] - 1 - nth
    ordered = np.empty(len(chosen), np.int64)
    ordered[slot] = piece[chosen]
    # Spelt characters become the pieces of their UTF-8 bytes.
    spelt = np.flatnonzero(ordered < 0)
    per_doc = np.add.reduceat(np.append(total, 0), np.minimum(np.cumsum(counts) - counts, len(total))) * (counts > 0)
    if len(spelt):
        width = np.ones(len(ordered), np.int64)
        names = [chr(points[-1 - c]).encode() for c in ordered[spelt].tolist()]
        width[spelt] = [len(b) for b in names]
        out = np.repeat(ordered, width)
        begin = np.cumsum(width) - width
        where = np.concatenate([np.arange(b, b + len(n)) for b, n in zip(begin[spelt].tolist(), names)])
        out[where] = pieces.byte_id[np.frombuffer(b"".join(names), np.uint8)]
        doc_of = np.repeat(np.arange(len(texts)), per_doc)
        per_doc = np.bincount(doc_of, weights=width, minlength=len(texts)).astype(np.int64)
        ordered = out
    return np.split(ordered.astype(np.int32), np.cumsum(per_doc)[:-1])


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of any segmentation: pieces' bytes one after another, without the leading space."""
    return b"".join(map(pieces.decoded.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _runs(batches: Iterator[pa.RecordBatch], path: str, seed: int):
    model = _pieces(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        keys = batch.column(1).to_numpy()
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= RUN or i + 1 == len(texts):
                run = texts[first : i + 1]
                yield batch.column(0).slice(first, len(run)), run, sample_texts(run, keys[first : i + 1], model, seed), model
                first, size = i + 1, 0


def _sampled(path: str, seed: int):
    def run(batches):
        for ids, _, found, _ in _runs(batches, path, seed):
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _digest(path: str, seed: int):
    def run(batches):
        for ids, texts, found, model in _runs(batches, path, seed):
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([decode(x, model) == t for x, t in zip(found, texts)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
            )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): a segmentation of each whole text, sampled from the lattice of all segmentations.

    A text with a leading space is cut into units that no piece reaches across, so the lattice is the product
    of the units' lattices. Forward filtering sums the probabilities of all ways to each place; backward
    sampling draws the pieces from a unit's end to its start. Draws come from a counter hash of the
    seed, the row's key and the place in the text, so any partitioning gives the same segmentation.
    Defined cases: null and empty texts have no ids; characters outside the vocabulary, and a
    literal mark of the vocabulary, are spelt in byte pieces; a null id has a key of its own; equal rows get equal segmentations; a very
    long text is sampled whole, unit by unit, and one without spaces is one unit, which is drawn piece by piece (some 60 microseconds each); an
    empty table gives no rows; other columns are ignored.
    """
    base = _keyed(docs, id_col, text_col)
    return base.mapInArrow(_sampled(path, seed), f"doc_id {dict(base.dtypes)['doc_id']}, ids array<int>")


def decode_ids(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts that encode() was given; null ids decode to the empty text."""

    def run(batches):
        model = _pieces(path)
        for batch in batches:
            texts = [decode(np.array(x or [], np.int64), model) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, text string")


def encode_digest(docs: DataFrame, path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless of encode(): lossless says that decoding gave the text back.

    Defined cases are encode()'s: null and empty texts have no pieces, the checksum of no bytes, and are lossless; null ids, repeated rows, very long
    texts, other columns and an empty table are as there.
    """
    base = _keyed(docs, id_col, text_col)
    return base.mapInArrow(_digest(path, seed), f"doc_id {dict(base.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, lossless boolean")
