"""HDF5 bytes for tests, of the older and of the newer form, written from the published format."""

import itertools
import struct
import zlib

import numpy as np

NONE = b"\xff" * 8


class Bytes:
    """A growing file; add() returns where a piece lies."""

    def __init__(self, size):
        self.data = bytearray(size)

    def add(self, piece: bytes) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += piece
        return at


def datatype(dtype) -> bytes:
    dtype = np.dtype(dtype)
    big = dtype.byteorder == ">"
    kind, bits = (1, int(big)) if dtype.kind == "f" else (0, int(big) | 8 * (dtype.kind == "i"))
    more = b"\0\0\x20\0" + b"\x17\x08\0\x17\x7f\0\0\0" if dtype.kind == "f" else struct.pack("<HH", 0, 8 * dtype.itemsize)
    return bytes([0x10 | kind]) + bits.to_bytes(3, "little") + struct.pack("<I", dtype.itemsize) + more


def chunk_tree(out: Bytes, array, chunk, filters, fanout) -> int:
    """Chunks, edge ones filled up, below a tree of one or two levels; the second filter is skipped in every third chunk."""
    entries = []
    for n, place in enumerate(itertools.product(*[range(0, s, c) for s, c in zip(array.shape, chunk)])):
        block = np.zeros(chunk, array.dtype)
        part = array[tuple(slice(p, p + c) for p, c in zip(place, chunk))]
        block[tuple(slice(0, s) for s in part.shape)] = part
        raw, skipped = block.tobytes(), 0
        for m, (kind, _) in enumerate(filters):
            if m == 1 and n % 3 == 2:
                skipped = 2
            elif kind == 2:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes()
            elif kind == 1:
                raw = zlib.compress(raw)
            elif kind == 3:
                raw += b"sum!"
        entries.append((place, len(raw), skipped, out.add(raw)))
    key = lambda e: struct.pack("<II", e[1], e[2]) + b"".join(struct.pack("<Q", p) for p in (*e[0], 0))
    last = (array.shape, 0, 0, 0)

    def node(level, children, end):
        body = b"".join(key(e) + struct.pack("<Q", at) for e, at in children) + key(end)
        return out.add(b"TREE" + bytes([1, level]) + struct.pack("<H", len(children)) + NONE * 2 + body)

    if len(entries) <= fanout:
        return node(0, [(e, e[3]) for e in entries], last)
    groups = [entries[n : n + fanout] for n in range(0, len(entries), fanout)]
    ends = [g[0] for g in groups[1:]] + [last]
    return node(1, [(g[0], node(0, [(e, e[3]) for e in g], end)) for g, end in zip(groups, ends)], last)


def header(out: Bytes, messages, new: bool, split: bool = False) -> int:
    """An object header; with split its last messages stand in a continuation block."""
    pack = lambda kind, body: bytes([kind]) + struct.pack("<HB", len(body), 0) + body
    if not new:
        def pack(kind, body):
            body += b"\0" * (-len(body) % 8)
            return struct.pack("<HHB3x", kind, len(body), 0) + body
    own, more = (messages[:-1], messages[-1:]) if split else (messages, [])
    text = b"".join(pack(*m) for m in own)
    if more:
        rest = b"".join(pack(*m) for m in more)
        rest = b"OCHK" + rest + b"sum!" if new else rest
        text += pack(16, struct.pack("<QQ", out.add(rest), len(rest)))
    if new:
        return out.add(b"OHDR" + bytes([2, 2 | 0x20]) + b"\0" * 16 + struct.pack("<I", len(text)) + text + b"sum!")
    return out.add(struct.pack("<BBHII4x", 1, 0, len(messages) + bool(more), 1, len(text)) + text)


def variable(out: Bytes, array, new: bool, chunk=None, filters=(), layout="contiguous", fill=None, fanout=4, split=False) -> int:
    rank = array.ndim
    dims = b"".join(struct.pack("<Q", n) for n in array.shape)
    messages = [(1, bytes([2, rank, 0, 1]) + dims if new else bytes([1, rank, 0, 0, 0, 0, 0, 0]) + dims), (3, datatype(array.dtype))]
    if fill is not None:
        raw = np.array(fill, array.dtype).tobytes()
        messages.append((5, bytes([3, 0x20 | 9]) + struct.pack("<I", len(raw)) + raw if new else bytes([2, 2, 2, 1]) + struct.pack("<I", len(raw)) + raw))
    if chunk:
        at = chunk_tree(out, array, chunk, filters, fanout)
        if filters:
            body = bytes([2, len(filters)]) if new else bytes([1, len(filters)]) + b"\0" * 6
            for kind, value in filters:
                body += struct.pack("<H", kind) + b"\0\0" * (kind >= 256) + struct.pack("<HHI", 0, 1, value) if new else struct.pack("<HHHH", kind, 8, 0, 1) + b"filter\0\0" + struct.pack("<II", value, 0)
            messages.append((11, body))
        messages.append((8, bytes([3, 2, rank + 1]) + struct.pack("<Q", at) + b"".join(struct.pack("<I", c) for c in (*chunk, array.dtype.itemsize))))
    elif layout == "compact":
        messages.append((8, bytes([3, 0]) + struct.pack("<H", array.nbytes) + array.tobytes()))
    elif layout == "empty":
        messages.append((8, bytes([3, 1]) + NONE + struct.pack("<Q", 0)))
    else:
        messages.append((8, bytes([3, 1]) + struct.pack("<QQ", out.add(array.tobytes()), array.nbytes)))
    return header(out, messages, new, split)


def link(name: str, at: int) -> bytes:
    return bytes([1, 0x14]) + b"\0" * 8 + b"\1" + bytes([len(name)]) + name.encode() + struct.pack("<Q", at)


def newer(variables: dict, dense: bool = False, indirect: bool = False) -> bytes:
    """Superblock 2; variables: name -> keywords of variable(); dense puts links into a heap, indirect below a row of blocks."""
    out = Bytes(48)
    places = {n: variable(out, new=True, **v) for n, v in variables.items()}
    group = out.add(b"OHDR" + bytes([2, 0, 3]) + bytes([10, 1, 0, 0, 0]) + b"\0\0" + b"sum!")  # a group beside the variables
    if dense:
        links = {n: link(n, at) for n, at in (places | {"group": group}).items()}
        start, ids, blocks, fill = 512, {}, [b""], 0
        for n, raw in links.items():
            if indirect and len(blocks[-1]) + len(raw) > start - 21 - 64:
                blocks.append(b"")
            ids[n] = (len(blocks) - 1) * start + 21 + len(blocks[-1])
            blocks[-1] += raw
        at = [out.add(b"FHDB" + b"\0" + b"\0" * 8 + struct.pack("<Q", n * start)[:4] + b"sum!" + b.ljust(start - 21 if indirect else 2048, b"\0")) for n, b in enumerate(blocks)]
        root, rows = at[0], 0
        if indirect:
            rows = -(-len(at) // 4)
            root = out.add(b"FHIB" + b"\0" + b"\0" * 8 + b"\0" * 4 + b"".join(struct.pack("<Q", a) for a in at) + NONE * (rows * 4 - len(at)) + b"sum!")
        heap = out.add(b"FRHP\0" + struct.pack("<HHBI", 7, 0, 2, 4096) + b"\0" * 8 + NONE + b"\0" * 8 + NONE + b"\0" * 64 + struct.pack("<HQQHHQH", 4, start, 65536, 32, 1, root, rows) + b"sum!")
        records = [b"hash" + b"\0" + struct.pack("<IH", ids[n], len(raw)) for n, raw in links.items()]
        if indirect:  # two leaves and the record between them
            half = len(records) // 2
            leaves = [records[:half], records[half + 1 :]]
            ends = [out.add(b"BTLF\0\x05" + b"".join(x) + b"sum!") for x in leaves]
            node = b"BTIN\0\x05" + records[half] + b"".join(struct.pack("<QB", a, len(x)) for a, x in zip(ends, leaves)) + b"sum!"
            top, count, depth = out.add(node.ljust(512, b"\0")), 1, 1
        else:
            top, count, depth = out.add(b"BTLF\0\x05" + b"".join(records) + b"sum!"), len(records), 0
        tree = out.add(b"BTHD\0\x05" + struct.pack("<IHHBBQHQ", 512, 11, depth, 100, 40, top, count, len(records)) + b"sum!")
        messages = [(2, bytes([0, 1]) + b"\0" * 8 + struct.pack("<QQ", heap, tree))]
    else:
        messages = [(2, bytes([0, 0]) + NONE * 2)] + [(6, link(n, at)) for n, at in places.items()]
    root = header(out, messages, True, split=len(messages) > 2)
    out.data[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<Q", 0) + NONE + struct.pack("<QQ", len(out.data), root) + b"sum!"
    return bytes(out.data)


def older(variables: dict) -> bytes:
    """Superblock 0: names in a local heap, a tree of symbol nodes, headers of the first version."""
    out = Bytes(96)
    places = {n: variable(out, new=False, **v) for n, v in variables.items()}
    names, at = b"\0" * 8, {}
    for n in sorted(places):
        at[n] = len(names)
        names += n.encode() + b"\0" * (8 - len(n) % 8)
    heap = out.add(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(names), 1, out.add(names)))
    nodes, order = [], sorted(places)
    for n in range(0, len(order), 2):
        part = order[n : n + 2]
        nodes.append((at[part[-1]], out.add(b"SNOD\1\0" + struct.pack("<H", len(part)) + b"".join(struct.pack("<QQ24x", at[p], places[p]) for p in part))))
    tree = out.add(b"TREE\0\0" + struct.pack("<H", len(nodes)) + NONE * 2 + b"".join(struct.pack("<QQ", 0, a) for _, a in nodes) + struct.pack("<Q", nodes[-1][0]))
    root = header(out, [(17, struct.pack("<QQ", tree, heap))], False)
    head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<Q", 0) + NONE + struct.pack("<Q", len(out.data)) + NONE
    out.data[:96] = head + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out.data)
