"""NetCDF-4 files: what the format keeps in HDF5, read a range at a time with numpy. Only the root group's variables are read.

Groups may be of either form (symbol tables, or links in headers and heaps); data contiguous, compact or in chunks with a tree of
the first kind, with the deflate, shuffle and checksum filters. Anything else is refused by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from .ranges import Ranges

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Fixed message and filter numbers of the format.
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 1, 2, 3, 5, 6, 8, 11, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1


class _Reader:
    """A moving place in bytes, little-endian; o and l are the sizes of offsets and lengths."""

    def __init__(self, data: bytes, at: int = 0, offset: int = 8, length: int = 8):
        self.data, self.at, self.o, self.l = data, at, offset, length

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def take(self, size: int) -> bytes:
        found = self.data[self.at : self.at + size]
        if len(found) < size:
            raise ValueError("an HDF5 structure ends early")
        self.at += size
        return found

    def offset(self) -> int:
        value = self.number(self.o)
        return NOWHERE if value == (1 << (8 * self.o)) - 1 else value

    def length(self) -> int:
        return self.number(self.l)


class Variable:
    """Shape, type, filters and place of a dataset."""

    def __init__(self):
        self.shape, self.dtype, self.fill, self.filters = (), None, None, []
        self.layout, self.place, self.size, self.chunk, self.inline = None, NOWHERE, 0, (), b""


class File:
    """Variables of an HDF5 file by name; slab() reads the levels asked for and no other chunks."""

    def __init__(self, source: bytes | Ranges):
        self.ranges = source if isinstance(source, Ranges) else Ranges(source)
        head = self.ranges.read(0, min(96, self.ranges.size))
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        self.o = self.l = 8
        if head[8] in (0, 1):
            self.o, self.l = head[13], head[14]
            at = 24 + 4 * (head[8] == 1) + 4 * self.o  # past the four addresses stands the root's entry
            root = int.from_bytes(head[at + self.o : at + 2 * self.o], "little")
        elif head[8] in (2, 3):
            self.o, self.l = head[9], head[10]
            root = int.from_bytes(head[12 + 3 * self.o : 12 + 4 * self.o], "little")
        else:
            raise ValueError(f"HDF5 superblock version {head[8]} is not read")
        self.links = dict(self._members(root))
        self._known: dict[str, Variable | None] = {}

    # ------------------------------------------------------------------ objects

    def _reader(self, at: int, size: int) -> _Reader:
        return _Reader(self.ranges.read(at, min(size, self.ranges.size - at)), 0, self.o, self.l)

    def _messages(self, at: int) -> Iterator[tuple[int, _Reader]]:
        """(type, body) of an object's messages, its continuation blocks too."""
        head = self.ranges.read(at, min(32, self.ranges.size - at))
        if head[:4] == b"OHDR":
            flags, start = head[5], 6 + 16 * bool(head[5] & 0x20) + 4 * bool(head[5] & 0x10)
            width = 1 << (flags & 3)
            first = self._reader(at, start + width)
            first.at = start
            blocks, order, ends = [(at + start + width, first.number(width))], 2 * bool(flags & 4), True
        elif head[0] == 1:
            blocks, order, ends = [(at + 16, int.from_bytes(head[8:12], "little"))], 0, False
        else:
            raise ValueError(f"no HDF5 object at {at}")
        while blocks:
            start, size = blocks.pop(0)
            block = self._reader(start, size)
            least = (4 + order) if ends else 8
            while block.at + least <= len(block.data):
                kind = block.number(1 if ends else 2)
                length, flags = block.number(2), block.number(1)
                block.at += order if ends else 3
                if block.at + length > len(block.data):
                    break  # a gap at the end of a block
                body = _Reader(block.take(length), 0, self.o, self.l)
                if kind == CONTINUED:
                    place, span = body.offset(), body.length()
                    blocks.append((place + 4, span - 8) if ends else (place, span))  # of the newer form, between signature and checksum
                elif flags & 2 and kind in (DATATYPE, DATASPACE, LAYOUT, FILTERS):
                    raise ValueError("shared HDF5 messages are not read")
                else:
                    yield kind, body

    def _members(self, at: int) -> Iterator[tuple[str, int]]:
        for kind, m in self._messages(at):
            if kind == SYMBOLS:
                tree, heap = m.offset(), m.offset()
                top = self._reader(heap, 8 + 2 * self.l + self.o)
                top.at = 8
                size, _, place = top.length(), top.length(), top.offset()
                yield from self._symbols(tree, self.ranges.read(place, size))
            elif kind == LINK:
                yield from self._link(m)
            elif kind == LINK_INFO:
                flags = m.data[1]
                m.at = 2 + 8 * (flags & 1)
                heap, tree = m.offset(), m.offset()
                if heap != NOWHERE:
                    found = _Heap(self, heap)
                    for record in self._records(tree):
                        yield from self._link(_Reader(found.object(record[4:]), 0, self.o, self.l))

    def _link(self, m: _Reader) -> Iterator[tuple[str, int]]:
        m.number(1)
        flags = m.number(1)
        kind = m.number(1) if flags & 8 else 0
        m.at += 8 * bool(flags & 4) + bool(flags & 16)
        name = m.take(m.number(1 << (flags & 3))).decode()
        if kind == 0:
            yield name, m.offset()

    def _symbols(self, at: int, names: bytes) -> Iterator[tuple[str, int]]:
        node = self._reader(at, 8 + 2 * self.o)
        if node.data[:4] == b"SNOD":
            count = int.from_bytes(node.data[6:8], "little")
            node = self._reader(at + 8, count * (2 * self.o + 24))
            for _ in range(count):
                name, place = node.offset(), node.offset()
                node.at += 24
                yield names[name : names.index(b"\0", name)].decode(), place
            return
        count = int.from_bytes(node.data[6:8], "little")
        node = self._reader(at + 8 + 2 * self.o, count * (self.l + self.o) + self.l)
        for _ in range(count):
            node.length()
            yield from self._symbols(node.offset(), names)

    def _records(self, at: int) -> Iterator[bytes]:
        """Records of a tree of the second kind, of at most two levels, as names of one group have."""
        head = self._reader(at, 16 + self.o + 2 + self.l)
        if head.data[:4] != b"BTHD":
            raise ValueError("no tree where a group's names should be")
        head.at = 6
        size, width, depth = head.number(4), head.number(2), head.number(2)
        head.at += 2
        root, count = head.offset(), head.number(2)
        if depth > 1:
            raise ValueError("groups of so many names are not read")
        if root == NOWHERE:
            return
        if depth == 0:
            leaf = self.ranges.read(root + 6, count * width)
            yield from (leaf[n * width : (n + 1) * width] for n in range(count))
            return
        # A child's number of records has as many bytes as the most that a leaf can hold needs.
        most = (size - 10) // width
        node = self._reader(root, size)
        node.at = 6
        own = [node.take(width) for _ in range(count)]
        for n in range(count + 1):
            child, held = node.offset(), node.number((most.bit_length() + 7) // 8)
            leaf = self.ranges.read(child + 6, held * width)
            yield from (leaf[r * width : (r + 1) * width] for r in range(held))
            yield from own[n : n + 1]

    # ---------------------------------------------------------------- variables

    def variable(self, name: str) -> Variable:
        if name not in self._known:
            self._known[name] = self._describe(self.links[name])
        if self._known[name] is None:
            raise KeyError(f"{name} is a group, not a variable")
        return self._known[name]

    @property
    def variables(self) -> list[str]:
        return list(self.links)

    def _describe(self, at: int) -> Variable | None:
        v = Variable()
        for kind, m in self._messages(at):
            if kind == DATASPACE:
                version, rank = m.number(1), m.number(1)
                m.at = 8 if version == 1 else 4
                v.shape = tuple(m.length() for _ in range(rank))
            elif kind == DATATYPE:
                v.dtype = self._type(m)
            elif kind == FILL:
                version = m.number(1)
                flags = m.number(1) if version == 3 else 0
                m.at = 2 if version == 3 else 4
                if flags & 32 if version == 3 else version == 1 or m.data[3]:
                    v.fill = m.take(m.number(4))
            elif kind == FILTERS:
                v.filters = self._filters(m)
            elif kind == LAYOUT:
                version, v.layout = m.number(1), m.number(1)
                if version != 3 or v.layout > 2:
                    raise ValueError(f"HDF5 layout version {version} is not read")
                if v.layout == 0:
                    v.inline = m.take(m.number(2))
                elif v.layout == 1:
                    v.place, v.size = m.offset(), m.length()
                else:
                    rank = m.number(1)
                    v.place = m.offset()
                    v.chunk = tuple(m.number(4) for _ in range(rank))[:-1]
        return v if v.layout is not None else None

    @staticmethod
    def _type(m: _Reader) -> np.dtype | None:
        kind = m.number(1) & 15
        bits, size = m.number(3), m.number(4)
        order = ">" if bits & 1 else "<"
        if kind == 1 and size in (4, 8):
            return np.dtype(f"{order}f{size}")
        if kind == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        return None  # text, references and the like: known by name, refused when read

    @staticmethod
    def _filters(m: _Reader) -> list[tuple[int, int]]:
        """(number, first parameter) of each filter, in the order of writing."""
        version, count = m.number(1), m.number(1)
        m.at += 6 * (version == 1)
        out = []
        for _ in range(count):
            kind = m.number(2)
            name = m.number(2) if version == 1 or kind >= 256 else 0
            m.number(2)
            parameters = m.number(2)
            m.at += -(-name // 8) * 8 if version == 1 else name
            values = [m.number(4) for _ in range(parameters)]
            m.at += 4 * (version == 1 and parameters % 2)
            out.append((kind, values[0] if values else 0))
        return out

    def _plain(self, raw: bytes, v: Variable, skipped: int) -> bytes:
        """A chunk without its filters, which are undone from the last to the first."""
        for n in range(len(v.filters) - 1, -1, -1):
            kind, width = v.filters[n]
            if skipped >> n & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                width = width or v.dtype.itemsize
                whole = len(raw) // width * width
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(width, -1).T.tobytes() + raw[whole:]
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"HDF5 filter {kind} is not read")
        return raw

    def _chunks(self, at: int, rank: int, low: tuple, high: tuple) -> Iterator[tuple[tuple, int, int, int]]:
        """(first place, bytes, skipped filters, address) of the chunks between two places in row order."""
        head = self._reader(at, 8 + 2 * self.o)
        if head.data[:4] != b"TREE":
            raise ValueError("no tree of chunks")
        level, count = head.data[5], int.from_bytes(head.data[6:8], "little")
        key = 8 + 8 * (rank + 1)
        body = self._reader(at + 8 + 2 * self.o, count * (key + self.o) + key)
        entries = []
        for n in range(count + 1):
            size, skipped = body.number(4), body.number(4)
            place = tuple(body.number(8) for _ in range(rank + 1))[:rank]
            entries.append((place, size, skipped, body.offset() if n < count else NOWHERE))
        for n, (place, size, skipped, child) in enumerate(entries[:count]):
            if place > high or (level and entries[n + 1][0] < low):
                continue
            if level:
                yield from self._chunks(child, rank, low, high)
            elif place >= low:
                yield place, size, skipped, child

    def read(self, name: str, window: list[tuple[int, int]]) -> np.ndarray:
        """The part of a variable within (first, end) of each dimension."""
        v = self.variable(name)
        if v.dtype is None:
            raise ValueError(f"{name} is not of a number type that is read")
        out = np.zeros([b - a for a, b in window], v.dtype)
        if v.fill and len(v.fill) == v.dtype.itemsize:
            out[...] = np.frombuffer(v.fill, v.dtype)[0]
        if v.layout == 0:
            return np.frombuffer(v.inline, v.dtype).reshape(v.shape)[tuple(slice(*w) for w in window)].copy()
        if v.place == NOWHERE or not out.size:
            return out
        if v.layout == 1:
            return read_rows(self.ranges, v.place, v.dtype, v.shape, window)
        low = tuple(a // c * c for (a, _), c in zip(window, v.chunk))
        high = tuple((b - 1) // c * c for (_, b), c in zip(window, v.chunk))
        for place, size, skipped, at in self._chunks(v.place, len(v.shape), low, high):
            ends = [min(p + c, n) for p, c, n in zip(place, v.chunk, v.shape)]
            if any(e <= a or p >= b for p, e, (a, b) in zip(place, ends, window)):
                continue
            block = np.frombuffer(self._plain(self.ranges.read(at, size), v, skipped), v.dtype).reshape(v.chunk)
            here = tuple(slice(max(p, a) - p, min(e, b) - p) for p, e, (a, b) in zip(place, ends, window))
            there = tuple(slice(max(p, a) - a, min(e, b) - a) for p, e, (a, b) in zip(place, ends, window))
            out[there] = block[here]
        return out

    def shape(self, name: str) -> tuple[int, ...]:
        return self.variable(name).shape

    def __getitem__(self, name: str) -> np.ndarray:
        return self.read(name, [(0, n) for n in self.shape(name)])


class _Heap:
    """Objects of a fractal heap whose root is a block, or a row of blocks."""

    def __init__(self, file: File, at: int):
        head = file._reader(at, 150)
        if head.data[:4] != b"FRHP":
            raise ValueError("no heap where a group's links should be")
        head.at = 5
        head.number(2)
        filtered, self.flags, self.most = head.number(2), head.number(1), head.number(4)
        if filtered:
            raise ValueError("filtered heaps are not read")
        head.at += 2 * file.o + 10 * file.l
        self.width, self.start, self.largest, self.bits = head.number(2), head.length(), head.length(), head.number(2)
        head.number(2)
        root, rows = head.offset(), head.number(2)
        self.file, self.skip = file, (self.bits + 7) // 8
        self.blocks = [(0, root)]
        if rows:
            block = file._reader(root, 5 + file.o + self.skip + rows * self.width * file.o)
            block.at = 5 + file.o + self.skip
            self.blocks, place = [], 0
            for row in range(rows):
                size = self.start << max(0, row - 1)
                if size > self.largest:
                    raise ValueError("heaps of so many links are not read")
                for _ in range(self.width):
                    self.blocks.append((place, block.offset()))
                    place += size

    def object(self, number: bytes) -> bytes:
        if number[0] >> 4 & 3:
            raise ValueError("only managed objects of a heap are read")
        sizes = (min(self.largest, self.most).bit_length() + 7) // 8
        at = int.from_bytes(number[1 : 1 + self.skip], "little")
        size = int.from_bytes(number[1 + self.skip : 1 + self.skip + sizes], "little")
        first, block = max(b for b in self.blocks if b[0] <= at)
        return self.file.ranges.read(block + at - first, size)


def read_rows(ranges: Ranges, begin: int, dtype: np.dtype, shape: tuple[int, ...], window: list[tuple[int, int]]) -> np.ndarray:
    """The window of an array that lies row by row at begin: one range for each run of neighbouring places, whole inner dimensions in one."""
    inner = len(shape)
    while inner and window[inner - 1] == (0, shape[inner - 1]):
        inner -= 1
    cell = int(np.prod(shape[inner:], dtype=np.int64)) * dtype.itemsize
    out = np.empty([b - a for a, b in window], dtype)
    if not out.size:
        return out
    if inner == 0:
        return np.frombuffer(ranges.read(begin, cell), dtype).reshape(shape)
    first, end = window[inner - 1]
    for place in np.ndindex(*[b - a for a, b in window[: inner - 1]]):
        at = 0
        for p, (a, _), n in zip(place, window[: inner - 1], shape[: inner - 1]):
            at = at * n + p + a
        at = (at * shape[inner - 1] + first) * cell
        out[place] = np.frombuffer(ranges.read(begin + at, (end - first) * cell), dtype).reshape(out[place].shape)
    return out
