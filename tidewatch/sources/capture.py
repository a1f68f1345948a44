"""Packet captures as a data source of Spark: batch partitions by byte range, and a stream with offsets.

Classic captures (either byte order, micro- or nanoseconds) and the block format of the next generation (one section a file, or sections that
tell their length; a section of unknown length that is followed by another raises an error, as does a record over LONGEST bytes).  A partition is a range of bytes.  It begins at the first record boundary at or after its start, found by chains of
plausible headers from well before it; and each partition checks that the next one
begins where it ended, so that a boundary found wrongly raises an error instead of losing packets (option split=false reads each file by one task).
Ranges are read in portions: memory doesn't grow with files.

``seq`` is a record's place in its file, so it rises with arrival.  IPv4 packets are given, over Ethernet (a VLAN tag too) or raw IP.
A record that is cut off at the end of a file is left out; on a stream it comes once it is whole.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load(path)
    spark.readStream.format("capture").option("path", folder).load()
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewatch.schema import PACKET

COLUMNS = "stream_id string, seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET)
#: Bytes of a partition, of a portion, and of a record at most.
SPLIT, PORTION, LONGEST = 64 << 20, 4 << 20, 1 << 18

# Magic numbers of classic captures -> byte order and parts of a second; block types; link types.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
SECTION, INTERFACE, OLD_PACKET, PACKET_BLOCK = 0x0A0D0D0A, 1, 2, 6
ORDER_MAGIC = 0x1A2B3C4D
ETHERNET = 1


@dataclass(frozen=True)
class Layout:
    """How records of a file are read.  links: (link type, parts of a second, seconds added) of each interface."""

    blocks: bool
    order: str
    links: tuple[tuple[int, float, float], ...]
    begin: int


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder whose names don't begin with a dot or underline."""
    fs, name = pafs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(name)) if x.is_file and x.base_name[0] not in "._"]
    return sorted((prefix + x.path, x.size) for x in found)


def _interface(body: bytes, order: str) -> tuple[int, float, float]:
    """Link type, parts of a second and offset of an interface block's body."""
    link, unit, shift, at = struct.unpack_from(order + "H", body)[0], 1e6, 0.0, 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        value = body[at + 4 : at + 4 + size]
        if code == 0:
            break
        if code == 9 and size == 1:
            unit = 2.0 ** (value[0] & 127) if value[0] & 128 else 10.0 ** value[0]
        if code == 14 and size == 8:
            shift = float(struct.unpack(order + "q", value)[0])
        at += 4 + size + -size % 4
    return link, unit, shift


def layout(f, at: int = 0) -> Layout | None:
    """The layout of the file, or of the section that begins at `at`; None while its head isn't whole."""
    f.seek(at)
    head = f.read(28)
    if len(head) < 24:
        return None
    if not at and head[:4] in CLASSIC:
        order, unit = CLASSIC[head[:4]]
        return Layout(False, order, ((struct.unpack(order + "I", head[20:24])[0] & 0xFFFF, unit, 0.0),), 24)
    if struct.unpack("<I", head[:4])[0] != SECTION:
        raise ValueError("not a packet capture")
    order = "<" if struct.unpack("<I", head[8:12])[0] == ORDER_MAGIC else ">"
    links, begin = [], at + struct.unpack(order + "I", head[4:8])[0]
    at = begin
    while True:
        f.seek(at)
        block = f.read(8)
        if len(block) < 8:
            break
        kind, size = struct.unpack(order + "II", block)
        if kind in (PACKET_BLOCK, OLD_PACKET, SECTION) or size < 12:
            break
        if kind == INTERFACE:
            links.append(_interface(f.read(size - 12), order))
        at += size
    return Layout(True, order, tuple(links), begin)


def sections(f, size: int) -> list[tuple[int, int]]:
    """(begin, end) of the sections; one of unknown length goes on to the file's end."""
    out, at = [], 0
    while at < size:
        f.seek(at)
        head = f.read(24)
        if len(head) < 24 or struct.unpack("<I", head[:4])[0] != SECTION:
            break
        order = "<" if struct.unpack("<I", head[8:12])[0] == ORDER_MAGIC else ">"
        length = struct.unpack(order + "q", head[16:24])[0]
        end = size if length < 0 else min(size, at + struct.unpack(order + "I", head[4:8])[0] + length)
        out.append((at, end))
        at = end
    return out or [(0, size)]


def _fields(data: np.ndarray, order: str) -> np.ndarray:
    """The 32-bit number that begins at each byte."""
    b = data.astype(np.uint64)
    n = len(b) - 3
    parts = [b[k : k + n] for k in range(4)]
    parts = parts if order == "<" else parts[::-1]
    return parts[0] | parts[1] << np.uint64(8) | parts[2] << np.uint64(16) | parts[3] << np.uint64(24)


def _lengths(how: Layout, word: np.ndarray, n: int) -> np.ndarray:
    """Bytes of a record that would begin at each byte, 0 where none can."""
    out = np.zeros(len(word), np.int64)
    m = len(word) - 12
    if m <= 0:
        return out
    if not how.blocks:
        kept, whole = word[8 : 8 + m], word[12 : 12 + m]
        fine = (word[4 : 4 + m] < how.links[0][1]) & (kept <= whole) & (kept <= LONGEST) & (whole > 0)
        out[:m] = np.where(fine, kept.astype(np.int64) + 16, 0)
        return out
    size = word[4 : 4 + m].astype(np.int64)
    at = np.flatnonzero((size >= 12) & (size % 4 == 0) & (size <= LONGEST + 64) & ((word[:m] < 0x1000) | (word[:m] == 0xBAD) | (word[:m] == 0x40000BAD)))
    end = at + size[at] - 4
    inside = end < len(word)
    at, end = at[inside], end[inside]
    at = at[word[end].astype(np.int64) == size[at]]
    out[at] = size[at]
    return out


def boundary(f, at: int, size: int, how: Layout) -> int:
    """The first record that begins at or after `at`, in a file (or section) of `size` bytes.

    Chains of plausible headers are followed from well before `at`: one that begins inside a packet dies or
    falls in with the records within a packet or two, even where packets carry captures themselves.
    """
    back = 2 * LONGEST
    low = how.begin if at - back <= how.begin else at - back + (-(at - back) % 4 if how.blocks else 0)
    if at <= how.begin or low >= size:
        return min(how.begin if at <= how.begin else size, size)
    f.seek(low)
    data = np.frombuffer(f.read(min(size, at + LONGEST) - low), np.uint8)
    n, whole = len(data), low + len(data) == size
    length = _lengths(how, _fields(data, how.order), n).tolist() if n >= 16 else []
    goal = at - low
    step = 4 if how.blocks else 1
    begins = [0] if low == how.begin else [o for o in range(0, LONGEST, step) if o < len(length) and length[o]]

    def follow(p: int, to: int) -> int | None:
        """The first place from `to` on that the chain from p comes to; None if it dies before."""
        path = []
        while p < to and p not in arrival:
            path.append(p)
            if p >= len(length) or not length[p]:
                p = -1
                break
            p += length[p]
        end = arrival.get(p, p) if p >= 0 else -1
        arrival.update(dict.fromkeys(path, end))
        return end if end >= 0 else None

    arrival: dict[int, int] = {}
    found = {x for o in begins if (x := follow(o, goal)) is not None}
    if len(found) > 1:
        arrival = {}
        found = {x for x in found if x >= n or follow(x, n - 16) is not None}
    if len(found) > 1:
        raise ValueError(f"records can't be told apart at byte {at}")
    return min(size, low + found.pop()) if found else size if whole else at


def walk(f, at: int, end: int, limit: int, how: Layout) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(bytes, their place, records' offsets in them) of whole records that begin in [at, end) of a file of `limit` bytes."""
    while at < end:
        f.seek(at)
        data = f.read(PORTION + LONGEST + 64)
        read, p, found = struct.Struct(how.order + "II").unpack_from, 0, []
        skip, extra = (4, 0) if how.blocks else (8, 16)
        while p < PORTION and at + p < end and p + 16 <= len(data):
            size = read(data, p + skip)[0] + extra
            if size < 12:
                raise ValueError(f"no record at byte {at + p}")
            if p + size > len(data):
                if at + p + size <= limit:
                    raise ValueError(f"a record of {size} bytes at byte {at + p}")
                break
            found.append(p)
            p += size
        if not found:
            return
        yield data, at, np.array(found, np.int64)
        at += p


def _text(octets: np.ndarray) -> pa.Array:
    parts = [pa.array(octets[:, k]).cast(pa.string()) for k in range(4)]
    return pc.binary_join_element_wise(*parts, ".")


def decode(data: bytes, at: int, records: np.ndarray, how: Layout, name: str) -> pa.RecordBatch:
    """The IPv4 packets among records."""
    raw = np.frombuffer(data, np.uint8)
    pad = np.concatenate([raw, np.zeros(128, np.uint8)])  # fields are looked up before it is known that they are there
    u4 = np.dtype(how.order + "u4")
    word = lambda o: np.stack([pad[o + k] for k in range(4)], 1).copy().view(u4)[:, 0].astype(np.int64)
    net2 = lambda o: pad[o].astype(np.int64) << 8 | pad[o + 1]
    if how.blocks:
        kind = word(records)
        if (kind == SECTION).any():
            raise ValueError("a section of unknown length is followed by another")
        records = records[(kind == PACKET_BLOCK) | (kind == OLD_PACKET)]
        kind = word(records)
        half = pad[records + 8].astype(np.int64) | pad[records + 9].astype(np.int64) << 8 if how.order == "<" else net2(records + 8)
        link_of = np.where(kind == OLD_PACKET, half, word(records + 8))
        if len(records) and (not how.links or link_of.max() >= len(how.links)):
            raise ValueError("a packet names an interface that the section's head doesn't have")
        ticks = (word(records + 12).astype(np.uint64) << np.uint64(32) | word(records + 16).astype(np.uint64)).astype(np.float64)
        unit, shift = (np.array([x[k] for x in how.links] or [1.0])[link_of] for k in (1, 2))
        ts, kept, length, frame = ticks / unit + shift, word(records + 20), word(records + 24), records + 28
        link = np.array([x[0] for x in how.links] or [0])[link_of]
    else:
        ts, kept, length, frame = word(records) + word(records + 4) / how.links[0][1], word(records + 8), word(records + 12), records + 16
        link = np.full(len(records), how.links[0][0])
    ether = link == ETHERNET
    kind = net2(np.where(ether, frame + 12, frame))
    tagged = ether & (kind == 0x8100) & (kept >= 18)
    kind = np.where(tagged, net2(np.where(tagged, frame + 16, frame)), kind)
    skip = np.where(tagged, 18, np.where(ether, 14, 0))
    ip, left = frame + skip, kept - skip
    take = np.flatnonzero((~ether | (kind == 0x0800)) & (left >= 20) & (pad[ip] >> 4 == 4))
    ts, length, ip, left, place = ts[take], length[take], ip[take], left[take], records[take] + at
    head = (pad[ip] & 15).astype(np.int64) * 4
    proto = pad[ip + 9].astype(np.int32)
    tcp = (proto == 6) & (left >= head + 14)
    port = lambda k: np.where(tcp, net2(ip + head + k), 0).astype(np.int32)
    octets = lambda k: np.stack([pad[ip + k + j] for j in range(4)], 1)
    columns = [pa.array([name] * len(take), pa.string()), pa.array(place), pa.array(ts), _text(octets(12)), _text(octets(16)), pa.array(port(0)), pa.array(port(2)), pa.array(proto), pa.array(np.where(tcp, pad[ip + head + 13], 0).astype(np.int32)), pa.array(length)]
    return pa.RecordBatch.from_arrays(columns, names=["stream_id", "seq", *PACKET.names])


@dataclass
class Range(InputPartition):
    """Records of a file that begin in [start, end), of a section that ends at `limit`; exact: one begins at start."""

    path: str
    section: int
    start: int
    end: int
    limit: int
    exact: bool


def ranges(path: str, start: int, end: int, split: int | None, f=None) -> list[Range]:
    """Partitions of the bytes [start, end) of a file, section by section."""
    f, out = f or _open(path), []
    for begin, stop in sections(f, end):
        if stop <= start:
            continue
        low = max(start, begin)
        cuts = [low, *(range(low + split, stop, split) if split else ()), stop]
        out += [Range(path, begin, a, b, stop, a == low) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def read(part: Range) -> Iterator[pa.RecordBatch]:
    with _open(part.path) as f:
        how = layout(f, part.section)
        if how is None:
            return
        at = max(how.begin, part.start) if part.exact else boundary(f, part.start, part.limit, how)
        name, ended = part.path.rstrip("/").rsplit("/", 1)[-1], at
        for data, place, records in walk(f, at, min(part.end, part.limit), part.limit, how):
            yield decode(data, place, records, how, name)
            last = int(records[-1])
            size = struct.unpack_from(how.order + "I", data, last + (4 if how.blocks else 8))[0]
            ended = place + last + size + (0 if how.blocks else 16)
        if part.end < part.limit and ended >= part.end and boundary(f, part.end, part.limit, how) != ended:
            raise ValueError(f"records of {part.path} can't be told apart at byte {part.end}: read it with the option split=false")


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = None if options.get("split", "true").lower() == "false" else int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return [r for path, size in files(self.path) for r in ranges(path, 0, size, self.split)] or [Range("", 0, 0, 0, 0, True)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read(partition) if partition.path else iter(())


class CaptureStream(DataSourceStreamReader):
    """Offsets are bytes of each file up to which whole records have been given; maxBytesPerTrigger bounds what a file adds at once."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.most = int(options.get("maxBytesPerTrigger", 1 << 40))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, path: str, size: int) -> int:
        """Where the last whole record of the first `size` bytes ends; headers only are looked at, from where the last look ended."""
        at = self.ends.get(path, 0)
        with _open(path) as f:
            last = sections(f, size)[-1][0]
            how = layout(f, last)
            if how is None:
                return at
            at = max(at, how.begin)
            for data, place, records in walk(f, at, min(size, at + self.most), size, how):
                end = int(records[-1])
                at = place + end + struct.unpack_from(how.order + "I", data, end + (4 if how.blocks else 8))[0] + (0 if how.blocks else 16)
        return min(at, size)

    def latestOffset(self) -> dict:
        for path, size in files(self.path):
            if size > self.ends.get(path, 0):
                self.ends[path] = self._whole(path, size)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for path, at in start.items():  # after a restart
            self.ends[path] = max(self.ends.get(path, 0), at)
        return [r for path, to in sorted(end.items()) if to > start.get(path, 0) for r in ranges(path, start.get(path, 0), to, self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self.options)
