"""The part of the HDF5 file format that binned contact matrices use, after its published description.

Reading: superblocks 0 to 3, old and new object headers and groups, one-dimensional datasets of numbers and fixed-length
strings, stored compactly, in one piece, or in chunks indexed by a B-tree, packed by deflate, shuffle and checksum. Every
read is of a byte range; nothing looks at a whole file. Writing: superblock 0, with chunks put where a plan says, so that
tasks can write them side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: marks, message and filter numbers, the address of nothing.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
_DATASPACE, _DATATYPE, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _GROUP = 0x01, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
_DEFLATE, _SHUFFLE, _CHECKSUM = 1, 2, 3


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def shuffled(data: bytes, size: int) -> bytes:
    """First bytes of all items, then all second bytes, and so on."""
    whole = len(data) // size * size
    return np.frombuffer(data, np.uint8, whole).reshape(-1, size).T.tobytes() + data[whole:]


def unshuffled(data: bytes, size: int) -> bytes:
    whole = len(data) // size * size
    return np.frombuffer(data, np.uint8, whole).reshape(size, -1).T.tobytes() + data[whole:]


def _dtype(raw: bytes) -> np.dtype:
    """Numbers, fixed-length strings, and enumerations as the numbers they are kept as."""
    kind, bits, size = raw[0] & 15, raw[1], struct.unpack_from("<I", raw, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 8:
        return _dtype(raw[8:])
    raise ValueError(f"data of class {kind} are not read")


def _shape(raw: bytes) -> tuple[int, ...]:
    version, rank = raw[0], raw[1]
    return struct.unpack_from(f"<{rank}Q", raw, 8 if version == 1 else 4)


@dataclass
class Dataset:
    """One-dimensional data in a file: where its chunks are, and how they are packed."""

    file: File
    n: int
    dtype: np.dtype
    layout: bytes
    filters: list[tuple[int, tuple[int, ...]]]

    def chunks(self, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """First row, address, stored bytes and left-out filters of the chunks that hold rows of [low, high), in order."""
        root = struct.unpack_from("<Q", self.layout, 3)[0]
        if root != NOWHERE:
            yield from self._below(root, low, high)

    def _below(self, at: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        head = self.file.read(at, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("damaged chunk index")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        rank = self.layout[2]
        key = 8 + 8 * rank
        body = self.file.read(at + 24, used * (key + 8) + key)
        firsts = [struct.unpack_from("<Q", body, k * (key + 8) + 8)[0] for k in range(used + 1)]
        for k in range(used):
            last = firsts[k] + self.rows_of_chunk if level == 0 else max(firsts[k + 1], firsts[k] + 1)
            if firsts[k] < high and last > low:
                size, left_out = struct.unpack_from("<II", body, k * (key + 8))
                child = struct.unpack_from("<Q", body, k * (key + 8) + key)[0]
                if level:
                    yield from self._below(child, low, high)
                else:
                    yield firsts[k], child, size, left_out

    @property
    def rows_of_chunk(self) -> int:
        return struct.unpack_from("<I", self.layout, 11)[0]

    def _unpacked(self, raw: bytes, left_out: int) -> bytes:
        for k, (number, values) in reversed(list(enumerate(self.filters))):
            if left_out >> k & 1:
                continue
            if number == _DEFLATE:
                raw = zlib.decompress(raw)
            elif number == _SHUFFLE:
                raw = unshuffled(raw, values[0] if values else self.dtype.itemsize)
            elif number == _CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {number} is not known")
        return raw

    def __getitem__(self, rows: slice) -> np.ndarray:
        """Rows of a slice without step; of other chunks none is read."""
        low, high, _ = rows.indices(self.n)
        kind, size = self.layout[1], self.dtype.itemsize
        if high <= low:
            return np.zeros(0, self.dtype)
        if kind == 0:
            return np.frombuffer(self.layout, self.dtype, high - low, 4 + low * size)
        if kind == 1:
            at = struct.unpack_from("<Q", self.layout, 2)[0]
            return np.zeros(high - low, self.dtype) if at == NOWHERE else np.frombuffer(self.file.read(at + low * size, (high - low) * size), self.dtype)
        out = np.zeros(high - low, self.dtype)
        for first, at, stored, left_out in self.chunks(low, high):
            values = np.frombuffer(self._unpacked(self.file.read(at, stored), left_out), self.dtype)
            s, e = max(low, first), min(high, first + len(values))
            out[s - low : e - low] = values[s - first : e - first]
        return out


class File:
    """A file behind ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("no HDF5 file")
        version = head[8]
        if (head[13:15] if version < 2 else head[9:11]) != b"\x08\x08" or version > 3:
            raise ValueError(f"superblock {version} with other than 8-byte addresses is not read")
        start = 24 + 4 * (version == 1)
        self.root = struct.unpack_from("<Q", head, start + 40 if version < 2 else 36)[0]

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """Kind and content of every message of an object's header, continuations included."""
        head = self.read(at, 32)
        found: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags = head[5]
            start = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.read(at + start, width), "little")
            blocks = [(at + start + width, size)]
            extra = 2 * bool(flags & 4)
            while blocks:
                block_at, length = blocks.pop(0)
                block, k = self.read(block_at, length), 0
                while k + 4 + extra <= len(block):
                    kind, size, _ = struct.unpack_from("<BHB", block, k)
                    body = block[k + 4 + extra : k + 4 + extra + size]
                    k += 4 + extra + size
                    if kind == _CONTINUED:
                        more, length = struct.unpack("<QQ", body[:16])
                        blocks.append((more + 4, length - 8))  # between its mark and its checksum
                    elif kind:
                        found.append((kind, body))
            return found
        if head[0] != 1:
            raise ValueError("damaged object header")
        left, size = struct.unpack_from("<H", head, 2)[0], struct.unpack_from("<I", head, 8)[0]
        blocks = [(at + 16, size)]
        while blocks and left:
            block_at, length = blocks.pop(0)
            block, k = self.read(block_at, length), 0
            while left and k + 8 <= len(block):
                kind, size = struct.unpack_from("<HH", block, k)
                body = block[k + 8 : k + 8 + size]
                k += 8 + size
                left -= 1
                if kind == _CONTINUED:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                elif kind:
                    found.append((kind, body))
        return found

    def members(self, at: int) -> dict[str, int]:
        """Names in a group, and where their headers are."""
        found: dict[str, int] = {}
        for kind, body in self.messages(at):
            if kind == _GROUP:
                tree, heap = struct.unpack("<QQ", body[:16])
                _, size, _, data = struct.unpack("<4s4xQQQ", self.read(heap, 32))
                self._symbols(tree, self.read(data, size), found)
            elif kind == _LINK:
                flags, k = body[1], 2
                typed = body[2] if flags & 8 else 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 0x10)
                width = 1 << (flags & 3)
                size = int.from_bytes(body[k : k + width], "little")
                k += width
                if typed == 0:
                    found[body[k : k + size].decode()] = struct.unpack_from("<Q", body, k + size)[0]
        return found

    def _symbols(self, at: int, names: bytes, found: dict[str, int]) -> None:
        head = self.read(at, 24)
        used = struct.unpack_from("<H", head, 6)[0]
        if head[:4] == b"TREE":
            body = self.read(at + 24, used * 16 + 8)
            for k in range(used):
                self._symbols(struct.unpack_from("<Q", body, 16 * k + 8)[0], names, found)
        else:
            body = self.read(at + 8, 40 * used)
            for k in range(used):
                name, header = struct.unpack_from("<QQ", body, 40 * k)
                found[names[name : names.index(b"\0", name)].decode()] = header

    def find(self, path: str) -> int:
        at = self.root
        for name in filter(None, path.split("/")):
            inside = self.members(at)
            if name not in inside:
                raise KeyError(path)
            at = inside[name]
        return at

    def dataset(self, path: str) -> Dataset:
        n, dtype, layout, filters = None, None, None, []
        for kind, body in self.messages(self.find(path)):
            if kind == _DATASPACE:
                shape = _shape(body)
                if len(shape) != 1:
                    raise ValueError(f"{path} has {len(shape)} dimensions")
                n = shape[0]
            elif kind == _DATATYPE:
                dtype = _dtype(body)
            elif kind == _LAYOUT:
                layout = body
            elif kind == _FILTERS:
                filters = _filters(body)
        if n is None or dtype is None or layout is None:
            raise ValueError(f"{path} is no dataset")
        if layout[0] != 3:
            raise ValueError(f"{path}: chunk indexes of layout {layout[0]} are not read")
        return Dataset(self, n, dtype, layout, filters)

    def attributes(self, path: str = "") -> dict[str, object]:
        """Numbers and fixed-length strings attached to an object; others are left out."""
        found: dict[str, object] = {}
        for kind, body in self.messages(self.find(path)):
            if kind != _ATTRIBUTE:
                continue
            version, name, typed, space = struct.unpack_from("<BxHHH", body)
            pad = _padded if version == 1 else int
            k = 8 if version < 3 else 9
            label = body[k : k + name].split(b"\0")[0].decode()
            k += pad(name)
            kind_raw = body[k : k + typed]
            k += pad(typed)
            shape = _shape(body[k : k + space])
            k += pad(space)
            try:
                values = np.frombuffer(body, _dtype(kind_raw), int(np.prod(shape)) if shape else 1, k)
            except ValueError:
                continue
            value = values[0] if not shape else values
            found[label] = value.decode() if isinstance(value, bytes) else value.item() if isinstance(value, np.generic) else value
        return found


def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    version, count, k, out = body[0], body[1], 8 if body[0] == 1 else 2, []
    for _ in range(count):
        number = struct.unpack_from("<H", body, k)[0]
        k += 2
        name = 0
        if version == 1 or number >= 256:
            name = struct.unpack_from("<H", body, k)[0]
            k += 2
        _, values = struct.unpack_from("<HH", body, k)
        k += 4 + (_padded(name) if version == 1 else name)
        out.append((number, struct.unpack_from(f"<{values}I", body, k)))
        k += 4 * (values + (values & 1 if version == 1 else 0))
    return out


# ---- writing


@dataclass
class Planned:
    """A dataset to be written: rows, type, rows of a chunk, and of each chunk address and stored bytes."""

    n: int
    dtype: np.dtype
    rows_of_chunk: int
    places: list[tuple[int, int]]


@dataclass
class PlannedGroup:
    members: dict[str, PlannedGroup | Planned] = field(default_factory=dict)
    attributes: dict[str, int | str] = field(default_factory=dict)


def packed(values: np.ndarray) -> bytes:
    """A chunk as it is stored: shuffled and deflated."""
    return zlib.compress(shuffled(values.tobytes(), values.dtype.itemsize), 6)


def _type_message(dtype: np.dtype) -> bytes:
    if dtype.kind == "S":
        return struct.pack("<BBBBI", 0x13, 1, 0, 0, dtype.itemsize)  # ended or filled by zeros
    if dtype.kind == "f":
        low, bits, mantissa, bias = {4: (31, 8, 23, 127), 8: (63, 11, 52, 1023)}[dtype.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, low, 0, dtype.itemsize, 0, 8 * dtype.itemsize, mantissa, bits, 0, mantissa, bias)
    return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)


def _header(messages: list[tuple[int, bytes]]) -> bytes:
    body = b""
    for kind, content in messages:
        content = content.ljust(_padded(len(content)), b"\0")
        body += struct.pack("<HHB3x", kind, len(content), 0) + content
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _attribute(name: str, value: int | str) -> tuple[int, bytes]:
    data = np.array(value, np.int64).tobytes() if isinstance(value, int) else value.encode() or b"\0"
    kind = _type_message(np.dtype("<i8" if isinstance(value, int) else f"S{len(data)}"))
    parts = [name.encode() + b"\0", kind, struct.pack("<BBB5x", 1, 0, 0)]
    body = struct.pack("<BxHHH", 1, *map(len, parts)) + b"".join(p.ljust(_padded(len(p)), b"\0") for p in parts) + data
    return _ATTRIBUTE, body


class _Layer:
    """Bytes that follow what is already in the file."""

    def __init__(self, at: int):
        self.at, self.parts = at, []

    def put(self, data: bytes) -> int:
        here = self.at
        data = data.ljust(_padded(len(data)), b"\0")
        self.parts.append(data)
        self.at += len(data)
        return here


_CHUNKS_A_NODE, _NAMES_A_NODE = 64, 8


def _chunk_tree(layer: _Layer, data: Planned) -> int:
    if not data.places:
        return NOWHERE
    ends = data.n
    nodes = [(k * data.rows_of_chunk, at, size) for k, (at, size) in enumerate(data.places)]
    level = 0
    while True:
        made, key = [], lambda first, size: struct.pack("<IIQQ", size, 0, first, 0)
        groups = [nodes[k : k + _CHUNKS_A_NODE] for k in range(0, len(nodes), _CHUNKS_A_NODE)]
        size_of = 24 + _CHUNKS_A_NODE * 32 + 24
        first_at = layer.at
        for k, group in enumerate(groups):
            left = first_at + (k - 1) * size_of if k else NOWHERE
            right = first_at + (k + 1) * size_of if k + 1 < len(groups) else NOWHERE
            after = groups[k + 1][0][0] if k + 1 < len(groups) else -(-ends // data.rows_of_chunk) * data.rows_of_chunk
            body = b"".join(key(first, size) + struct.pack("<Q", at) for first, at, size in group) + key(after, 0)
            at = layer.put((struct.pack("<4sBBHQQ", b"TREE", 1, level, len(group), left, right) + body).ljust(size_of, b"\0"))
            made.append((group[0][0], at, group[0][2]))
        if len(made) == 1:
            return made[0][1]
        nodes, level = made, level + 1


def _dataset(layer: _Layer, data: Planned) -> int:
    tree = _chunk_tree(layer, data)
    size = data.dtype.itemsize
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", _SHUFFLE, 0, 1, 1, size, 0) + struct.pack("<HHHHII", _DEFLATE, 0, 1, 1, 6, 0)
    layout = struct.pack("<BBBQII", 3, 2, 2, tree, data.rows_of_chunk, size)
    # unlimited length; space when a chunk is written, zeros where none is
    return layer.put(_header([(_DATASPACE, struct.pack("<BBB5xQQ", 1, 1, 1, data.n, NOWHERE)), (_DATATYPE, _type_message(data.dtype)), (0x05, struct.pack("<BBBB", 2, 3, 2, 0)), (_LAYOUT, layout), (_FILTERS, filters)]))


def _group(layer: _Layer, group: PlannedGroup) -> tuple[int, int, int]:
    """Where the group's header, tree and heap are."""
    headers = {name: _group(layer, m) if isinstance(m, PlannedGroup) else (_dataset(layer, m), 0, 0) for name, m in sorted(group.members.items())}
    names, places = b"\0" * 8, {}
    for name in headers:
        places[name] = len(names)
        names += name.encode().ljust(_padded(len(name) + 1), b"\0")
    heap_data = layer.put(names + struct.pack("<QQ", 1, 16))
    heap = layer.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names) + 16, len(names), heap_data))
    listed = list(headers.items())
    keys, leaves = [0], []
    for k in range(0, len(listed), _NAMES_A_NODE):
        some = listed[k : k + _NAMES_A_NODE]
        body = b"".join(struct.pack("<QQI4xQQ", places[n], at, bool(tree), tree, own) for n, (at, tree, own) in some)
        leaves.append(layer.put((struct.pack("<4sBxH", b"SNOD", 1, len(some)) + body).ljust(8 + 40 * _NAMES_A_NODE, b"\0")))
        keys.append(places[some[-1][0]])
    body = struct.pack("<Q", keys[0]) + b"".join(struct.pack("<QQ", at, key) for at, key in zip(leaves, keys[1:]))
    tree = layer.put((struct.pack("<4sBBHQQ", b"TREE", 0, 0, len(leaves), NOWHERE, NOWHERE) + body).ljust(24 + 8 + 32 * 16, b"\0"))
    header = layer.put(_header([(_GROUP, struct.pack("<QQ", tree, heap)), *[_attribute(n, v) for n, v in group.attributes.items()]]))
    return header, tree, heap


#: Bytes at the start of a file that are kept for the superblock.
HEAD = 96


def superblock_and_index(root: PlannedGroup, at: int) -> tuple[bytes, bytes]:
    """The first ``HEAD`` bytes of a file, and those from ``at`` on, after all chunks."""
    layer = _Layer(at)
    header, tree, heap = _group(layer, root)
    index = b"".join(layer.parts)
    head = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, _NAMES_A_NODE // 2, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, at + len(index), NOWHERE) + struct.pack("<QQI4xQQ", 0, header, 1, tree, heap)
    return head, index
