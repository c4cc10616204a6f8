"""Best-fit packing of documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE

#: Pieces that are packed together in one task; blocks are dealt by hash, so their number follows the input.
BLOCK_PIECES = 16_384
#: Local search stops after this many passes without an emptied sequence.
IDLE_PASSES = 3

#: Texts of these characters alone are split alike by both libraries, whatever Unicode tables they carry: ASCII
#: without the separators 1C to 1F, and Latin letters and signs without other white space.
_OTHER = "[^\x00-\x1b !-~\xa1-ɏ]"
#: Fixed pattern of the byte-level vocabulary: how a text is split before pairs are merged.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _coder(path: str, ranks: str | None):
    """Text -> ids as little-endian 32-bit integers.

    path is the vocabulary for the tokenizers library, whose encode() without added special tokens defines the ids. ranks,
    if given, is the same vocabulary as a rank file: the faster library that reads it gives the same ids, and takes all texts
    but those with rarer characters or with the content of an added token, which is one id wherever it stands in a text.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    fast = None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    added = [re.escape(token.content) for token in whole.get_added_tokens_decoder().values() if token.content]
    other = re.compile("|".join([_OTHER, *added]))

    def encode(text: str) -> bytes:
        if fast is None or other.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def encode(text: str, path: str, ranks: str | None = None) -> bytes:
    """Ids of a whole text, as little-endian 32-bit integers; an added token's content in the text is that token."""
    return _coder(path, ranks)(text)


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, ranks: str | None, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder(text or "") + end
                total = len(ids) // 4
                first = total % capacity or min(total, capacity)
                starts = [0, *range(first, total, capacity)]
                for piece, start in enumerate(starts):
                    stop = starts[piece + 1] if piece + 1 < len(starts) else total
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, piece, start, stop - start, zlib.crc32(part), part))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(
    docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are those of its whole text, then end_id. Only a document longer than capacity is
    cut: all its pieces are full but the first, which takes the remainder. Null text counts as empty and
    gives one piece with the end alone. Ids may be of any type, whole numbers become longs; a null id stays null.
    """
    own = F.col(f"`{id_col}`")
    base = docs.select((own.cast("long") if dict(docs.dtypes)[id_col] in WHOLE else own).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {PIECE_SCHEMA}" + (", ids array<int>" if with_ids else "")
    return base.mapInArrow(_pieces(path, ranks, capacity, end_id, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers by best fit, longest first; open bins are kept by free room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        if room > size:
            bisect.insort(rooms, (room - size, number))
    return bins


class _Bins:
    """Open bins by what they can take in: for each item of a bin, its size and the largest size that may replace it.

    A bin with `room` may take an item of up to size + room for one of `size` that it gives back, and for size 0, nothing given back,
    one of up to `room`. The tables are keyed by that reach, which is at most the capacity, and hold (size, bin) in order, so a
    search takes steps in proportion to the capacity and the logarithm of the bins, not to the bins.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.reach: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        for number in range(len(bins)):
            self._enter(number)

    def _entries(self, number: int) -> list[tuple[int, int]]:
        room = self.capacity - self.fill[number]
        if not room or not self.bins[number]:
            return []
        return [(s, s + room) for s in {0, *(self.size[i] for i in self.bins[number])}]

    def _enter(self, number: int) -> None:
        for s, reach in self._entries(number):
            bisect.insort(self.reach[reach], (s, number))

    def _leave(self, number: int) -> None:
        for s, reach in self._entries(number):
            table = self.reach[reach]
            del table[bisect.bisect_left(table, (s, number))]

    def find(self, total: int, room: int) -> tuple[int, int, int] | None:
        """(room left, size given back, bin) for items of `total` out of a bin with `room`: the bin that they fill best.

        The bin found is no emptier than the items' own one. An exchange must take at least half of its room, so that a bin
        is improved a number of times that follows the logarithm of its room; a move need not.
        """
        for reach in range(total, self.capacity + 1):
            table = self.reach[reach]
            left = reach - total
            at = bisect.bisect_left(table, (max(reach - room, 0), -1))
            if at < len(table):
                back, number = table[at]
                if back < total and (not back or 2 * left <= reach - back):
                    return left, back, number
        return None

    def exchange(self, source: int) -> bool:
        """The best single step out of the bin: a move, one for one, or two for one; False if there is none."""
        mine = self.bins[source]
        by_size = {self.size[i]: i for i in mine}
        room = self.capacity - self.fill[source]
        sizes = sorted(by_size, reverse=True)
        twice = {s for s in sizes if sum(self.size[i] == s for i in mine) > 1}
        offers: dict[int, tuple[int, ...]] = {s: (s,) for s in sizes}
        for at, s in enumerate(sizes):
            for t in sizes[at if s in twice else at + 1 :]:
                if s + t <= self.capacity:
                    offers.setdefault(s + t, (s, t))
        self._leave(source)
        best = None
        for total, out in offers.items():
            found = self.find(total, room)
            if found and (best is None or (found[0], found[1]) < best[0][:2]):
                best = (found, out)
                if found[:2] == (0, 0):
                    break
        if best:
            (_, back, target), out = best
            self._leave(target)
            theirs = self.bins[target]
            given = [next(i for i in theirs if self.size[i] == back)] if back else []
            for s in out:
                item = next(i for i in mine if self.size[i] == s)
                mine.remove(item)
                theirs.append(item)
            for item in given:
                theirs.remove(item)
                mine.append(item)
            gain = sum(out) - back
            self.fill[source] -= gain
            self.fill[target] += gain
            self._enter(target)
        self._enter(source)
        return best is not None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, idle: int = IDLE_PASSES) -> list[list[int]]:
    """Exchange documents between underfull bins while the sum of squared fills grows, until bins empty.

    The emptiest bins come first, each against all that are no emptier: move one document into the fuller bin,
    exchange one of ours for a shorter one of theirs, or two of ours for one of theirs. Each step raises the
    fuller bin's fill, so squared fill rises and the search ends. It stops at the lower bound
    ceil(sum / capacity), or when IDLE_PASSES passes have emptied no bin.
    """
    size = lengths.tolist()
    least = -(-sum(size) // capacity)
    state = _Bins(bins, size, capacity)
    calm, count = 0, sum(map(bool, bins))
    while calm < idle and count > least:
        moved = False
        for source in sorted((b for b in range(len(bins)) if bins[b] and state.fill[b] < capacity), key=lambda b: state.fill[b]):
            while bins[source] and state.fill[source] < capacity and state.exchange(source):
                moved = True
        before, count = count, sum(map(bool, bins))
        calm = calm + 1 if moved and count == before else 0 if moved else idle
    return [b for b in bins if b]


def _pack(capacity: int, block_bits: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("number").to_numpy(), lengths))
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(bins):
            at = 0
            for item in sorted(items):
                sequence[item], offset[item] = number, at
                at += int(lengths[item])
        block = int(table.column("block")[0].as_py()) if len(lengths) else 0
        kept = table.drop_columns(["block", "length", "number"])
        return kept.append_column("sequence_id", pa.array(sequence + (block << block_bits))).append_column("offset", pa.array(offset))

    return run


def pack(pieces: DataFrame, capacity: int = 1024, block_pieces: int = BLOCK_PIECES, rows: int | None = None) -> DataFrame:
    """pieces(length, ...) plus sequence_id and offset: as few sequences of at most `capacity` tokens as found.

    Pieces are dealt into blocks of about block_pieces (rows: how many pieces to plan for, counted
    if not given) by the hash of a running number, so that no id, null or repeated, fills one. A block is packed by best fit,
    longest first, and then by local search; it loses
    at most part of one sequence against packing everything at once. A task holds one block's lengths.
    Defined cases: columns of any names pass through, but those named sequence_id and offset are replaced; an empty table gives no rows.
    """
    total = pieces.count() if rows is None else rows
    blocks = max(1, -(-total // block_pieces))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    given = pieces.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)], F.col("length"), F.monotonically_increasing_id().alias("number"))
    dealt = given.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    schema = ", ".join(f"{c} {t}" for c, t in given.dtypes if c not in ("length", "number")) + ", sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInArrow(_pack(capacity, 24), schema)
    return packed.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(columns)], "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """token_pieces() and pack() in one; the rows of docs, of which there are no more than pieces, plan the blocks."""
    return pack(token_pieces(docs, path, ranks, id_col, text_col, capacity, end_id), capacity, rows=docs.count())
