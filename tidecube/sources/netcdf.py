"""NetCDF files in numpy: classic ones (CDF-1, CDF-2, CDF-5) are read and written, those kept in HDF5 are read by `hdf5`."""

from __future__ import annotations

import struct

import numpy as np

from . import hdf5
from .ranges import Ranges

DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Fixed type numbers of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}
MISSING = 1e20
#: Bytes of a file's beginning that are read to find its variables, at first.
HEADER = 1 << 14


class _Short(Exception):
    """The header goes on after the bytes at hand."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.version = data[3]

    def take(self, size: int) -> bytes:
        found = self.data[self.at : self.at + size]
        if len(found) < size:
            raise _Short
        self.at += size
        return found

    def number(self, wide: bool) -> int:
        return struct.unpack(">q" if wide else ">i", self.take(8 if wide else 4))[0]

    def count(self) -> int:
        return self.number(self.version == 5)

    def padded(self, size: int) -> bytes:
        return self.take(-(-size // 4) * 4)[:size]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self):
        self.number(False)
        return range(self.count())

    def attributes(self) -> dict:
        out = {}
        for _ in self.items():
            name, kind, size = self.name(), self.number(False), self.count()
            dtype = np.dtype(TYPES[kind])
            raw = self.padded(size * dtype.itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype)
        return out


class File:
    """Dimensions, attributes and variables of a file; the header is read first, of the arrays only what is asked for."""

    def __init__(self, source: bytes | Ranges):
        self.ranges = source if isinstance(source, Ranges) else Ranges(source)
        at_hand = HEADER
        while True:
            try:
                self._parse(_Cursor(self.ranges.read(0, min(at_hand, self.ranges.size))))
                return
            except _Short:
                if at_hand >= self.ranges.size:
                    raise ValueError("a NetCDF header that ends early") from None
                at_hand *= 8

    def _parse(self, c: _Cursor) -> None:
        self.records = max(c.count(), 0)
        self.dimensions = {}
        names = []
        for _ in c.items():
            name = c.name()
            names.append(name)
            self.dimensions[name] = c.count()
        self.attributes = c.attributes()
        self.variables = {}
        for _ in c.items():
            name = c.name()
            dims = [names[c.count()] for _ in range(c.count())]
            attributes, kind, size, begin = c.attributes(), c.number(False), c.count(), c.number(c.version > 1)
            self.variables[name] = (dims, kind, size, begin, attributes)
        growing = [d for d, n in self.dimensions.items() if n == 0]
        self.growing = growing[0] if growing else None
        own = [v for v in self.variables.values() if v[0][:1] == [self.growing] and self.growing]
        self.stride = sum(v[2] for v in own) if len(own) != 1 else self._record(own[0])
        if self.growing:
            self.dimensions[self.growing] = self.records

    def _record(self, variable) -> int:
        dims, kind, *_ = variable
        return int(np.prod([self.dimensions[d] for d in dims[1:]], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dimensions[d] for d in self.variables[name][0])

    def read(self, name: str, window: list[tuple[int, int]]) -> np.ndarray:
        """The part of a variable within (first, end) of each dimension."""
        dims, kind, _, begin, _ = self.variables[name]
        dtype, shape = np.dtype(TYPES[kind]), self.shape(name)
        if not dims or dims[0] != self.growing:
            return hdf5.read_rows(self.ranges, begin, dtype, shape, window)
        parts = [hdf5.read_rows(self.ranges, begin + r * self.stride, dtype, shape[1:], window[1:]) for r in range(*window[0])]
        return np.stack(parts) if parts else np.empty([b - a for a, b in window], dtype)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.read(name, [(0, n) for n in self.shape(name)])

    def values(self, name: str, missing: str = "null") -> np.ndarray:
        """Doubles; values of MISSING or more are NaN, or 0 with missing="zero"."""
        return doubles(self[name], missing)


def doubles(found: np.ndarray, missing: str) -> np.ndarray:
    found = found.astype(np.float64)
    return np.where(found >= MISSING, 0.0 if missing == "zero" else np.nan, found)


def opened(source: bytes | str | Ranges) -> File | hdf5.File:
    """A NetCDF file of either kind, told apart by its first bytes."""
    ranges = source if isinstance(source, Ranges) else Ranges(source)
    first = ranges.read(0, min(8, ranges.size))
    return hdf5.File(ranges) if first == hdf5.SIGNATURE else File(ranges)


def levels_of(file: File | hdf5.File, name: str) -> tuple[int, int, int]:
    """Cells along depth, y and x of a variable: its last three dimensions, of which those that it lacks are 1."""
    return (1, 1, 1, *file.shape(name))[-3:]


def slab(file: File | hdf5.File, name: str, first: int, end: int, missing: str = "null") -> np.ndarray:
    """The levels from first to end of a variable's first time, as (level, y, x) doubles; nothing else of it is read."""
    shape = file.shape(name)
    window = [(0, 1)] * max(len(shape) - 3, 0) + ([(first, end)] if len(shape) >= 3 else []) + [(0, n) for n in shape[-2:]]
    nz, ny, nx = levels_of(file, name)
    return doubles(file.read(name, window), missing).reshape(min(end, nz) - first, ny, nx)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(items: dict) -> bytes:
    if not items:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(items))
    for key, value in items.items():
        if isinstance(value, str):
            raw, kind, size = value.encode(), 2, len(value.encode())
        else:
            array = np.atleast_1d(np.asarray(value))
            kind, size = CODES[array.dtype.str[1:]], array.size
            raw = array.astype(TYPES[kind]).tobytes()
        out += _name(key) + struct.pack(">ii", kind, size) + raw + b"\0" * (-len(raw) % 4)
    return out


def header(dimensions: dict[str, int], variables: dict, attributes: dict | None = None) -> tuple[bytes, dict[str, int], int]:
    """(the first bytes of a CDF-2 file, where each variable begins, the whole file's size); variables: name -> (dimension names, dtype[, attributes])."""
    names = list(dimensions)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", DIMENSION, len(names)) + b"".join(_name(d) + struct.pack(">i", dimensions[d]) for d in names)
    head += _attributes(attributes or {})
    entries, sizes = [], []
    for name, (dims, dtype, *rest) in variables.items():
        kind = CODES[np.dtype(dtype).str[1:]]
        size = int(np.prod([dimensions[d] for d in dims], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize
        sizes.append(-(-size // 4) * 4)
        entry = _name(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", names.index(d)) for d in dims)
        entries.append(entry + _attributes(rest[0] if rest else {}) + struct.pack(">ii", kind, min(sizes[-1], 2**31 - 4)))
    begin = len(head) + 8 + sum(len(e) + 8 for e in entries)
    body, begins = struct.pack(">ii", VARIABLE, len(entries)), {}
    for name, entry, size in zip(variables, entries, sizes):
        body += entry + struct.pack(">q", begin)
        begins[name] = begin
        begin += size
    return head + body, begins, begin


def encode(dimensions: dict[str, int], variables: dict, attributes: dict | None = None) -> bytes:
    """Bytes of a CDF-2 file; variables: name -> (dimension names, array[, attributes])."""
    arrays = {name: np.asarray(array) for name, (_, array, *_) in variables.items()}
    sized = {name: (dims, arrays[name].dtype, *rest) for name, (dims, _, *rest) in variables.items()}
    head, _, _ = header(dimensions, sized, attributes)
    out = [head]
    for array in arrays.values():
        raw = array.astype(TYPES[CODES[array.dtype.str[1:]]]).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 4))
    return b"".join(out)
