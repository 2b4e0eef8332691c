"""MPEG transport streams in a media column.

``mux`` stores a payload as a transport stream of 188-byte packets: a program association table, a program map table,
and one elementary stream of private data in PES packets with presentation times; every RANDOM_ACCESS-th unit is a
random-access point with a clock reference, and the tables stand before it, so that a receiver can begin there. ``demux`` reads any such stream back: it finds the packets' sync, parses the
tables (checking their CRC), checks the continuity counter of each packet id, reassembles the elementary packets, and
keeps their timestamps with the random-access points.

Both run a row at a time in mapInArrow (a stream is one value of the column), so nothing is shuffled and memory is a
slice of a batch. The media column is written as a table, and read back from it.

Defined cases: null is the empty payload; damaged input gives counts of errors rather than an exception; repeated rows
repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.llm import arrowtext as at
from tilework.llm.common import documents, in_arrow, written

PACKET, SYNC = 188, 0x47
MAP_PID, DATA_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS = 2048, 3003, 8
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


_PROGRAMS = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | MAP_PID))
_MAP = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE, 0xE000 | DATA_PID, 0xF000))
#: Both tables' packets, by continuity counter.
_TABLES = [_table_packet(0, _PROGRAMS, c) + _table_packet(MAP_PID, _MAP, c) for c in range(16)]


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29 & 0x0E), (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def mux(payload: bytes) -> bytes:
    out, counter = [] if payload else [_TABLES[0]], 0
    for unit, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[start : start + UNIT_BYTES]
        pts = unit * UNIT_TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", len(data) + 8, 0x80, 0x80, 5) + _stamp(pts) + data
        extra = b""
        if unit % RANDOM_ACCESS == 0:
            out.append(_TABLES[unit // RANDOM_ACCESS & 15])
            extra = struct.pack(">BIH", 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00)
        at_, first = 0, 0x4000
        while at_ < len(pes):
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            left = len(pes) - at_
            if left < room:  # an adaptation field of stuffing fills the packet
                fill = room - left
                if extra:
                    extra += b"\xff" * fill
                else:
                    extra = b"" if fill == 1 else b"\x00" + b"\xff" * (fill - 2)
                field_ = bytes([len(extra)]) + extra
                room = left
            else:
                field_ = bytes([len(extra)]) + extra if extra else b""
            out.append(struct.pack(">BHB", SYNC, first | DATA_PID, (0x30 if field_ else 0x10) | counter) + field_ + pes[at_ : at_ + room])
            counter, at_, first, extra = counter + 1 & 15, at_ + room, 0, b""
    return b"".join(out)


@dataclass
class Unit:
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program -> pid of its map
    kinds: dict[int, int] = field(default_factory=dict)  # pid -> stream type
    units: dict[int, list[Unit]] = field(default_factory=dict)
    continuity_errors: int = 0
    crc_errors: int = 0
    sync_losses: int = 0


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _pes(raw: bytes, random_access: bool) -> Unit | None:
    if len(raw) < 9 or raw[:3] != b"\x00\x00\x01":
        return None
    length, flags, head = raw[4] << 8 | raw[5], raw[7], raw[8]
    pts = _time(raw[9:14]) if flags & 0x80 and len(raw) >= 14 else None
    dts = _time(raw[14:19]) if flags & 0x40 and len(raw) >= 19 else None
    return Unit(pts, dts, random_access, raw[9 + head : 6 + length if length else None])


def _tables(s: Stream, pid: int, section: bytes) -> None:
    size = 3 + ((section[1] & 0x0F) << 8 | section[2]) if len(section) >= 3 else 0
    section = section[:size]
    if size < 12 or len(section) < size or section_crc(section) != 0:
        s.crc_errors += 1
        return
    body = section[8:-4]
    if pid == 0 and section[0] == 0:
        for i in range(0, len(body) - 3, 4):
            program, target = struct.unpack_from(">HH", body, i)
            if program:
                s.programs[program] = target & 0x1FFF
    elif section[0] == 2:
        i = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
        while i + 5 <= len(body):
            kind, target, info = struct.unpack_from(">BHH", body, i)
            s.kinds[target & 0x1FFF] = kind
            i += 5 + (info & 0x0FFF)


def demux(data: bytes) -> Stream:
    s, at_, n = Stream(), 0, len(data)
    counters: dict[int, int] = {}
    parts: dict[int, list[bytes]] = {}
    access: dict[int, bool] = {}
    maps: set[int] = set()

    def close(pid: int) -> None:
        if parts.get(pid):
            raw = b"".join(parts[pid])
            if pid == 0 or pid in maps:
                _tables(s, pid, raw)
                for found in set(s.programs.values()) - maps:
                    parts[found] = []  # what came before the program was known isn't a whole section
                    maps.add(found)
            elif (unit := _pes(raw, access.get(pid, False))) is not None:
                s.units.setdefault(pid, []).append(unit)
        parts[pid] = []

    while at_ + PACKET <= n:
        if data[at_] != SYNC:
            s.sync_losses += 1
            at_ = data.find(SYNC, at_ + 1)
            while at_ >= 0 and at_ + PACKET < n and data[at_ + PACKET] != SYNC:
                at_ = data.find(SYNC, at_ + 1)
            if at_ < 0:
                break
            continue
        b1, flags = data[at_ + 1], data[at_ + 3]
        pid, start, body = (b1 & 0x1F) << 8 | data[at_ + 2], at_ + 4, at_ + PACKET
        s.packets += 1
        at_ = body
        if pid == 0x1FFF or b1 & 0x80:
            continue
        random_access = jump = False
        if flags & 0x20:
            size = data[start]
            if size:
                random_access, jump = bool(data[start + 1] & 0x40), bool(data[start + 1] & 0x80)
            start += 1 + size
        if not flags & 0x10:
            continue
        counter, last = flags & 15, counters.get(pid)
        if last is not None and not jump:
            if counter == last:
                continue  # a packet sent twice
            if counter != last + 1 & 15:
                s.continuity_errors += 1
                parts[pid] = []
        counters[pid] = counter
        piece = data[start:body]
        if b1 & 0x40:
            if pid == 0 or pid in maps:
                skip = piece[0] if piece else 0
                if parts.get(pid):
                    parts[pid].append(piece[1 : 1 + skip])
                close(pid)
                parts[pid] = [piece[1 + skip :]]
                whole = parts[pid][0]
                if len(whole) >= 3 and len(whole) >= 3 + ((whole[1] & 0x0F) << 8 | whole[2]):
                    close(pid)
            else:
                close(pid)
                parts[pid], access[pid] = [piece], random_access
        elif parts.get(pid):
            parts[pid].append(piece)
    for pid in list(parts):
        close(pid)
    return s


def feature(s: Stream) -> str:
    """The stream's tables, counts and times as one line."""
    out = [f"packets={s.packets}", "programs=" + ",".join(f"{p}:{m:04x}" for p, m in sorted(s.programs.items()))]
    for pid, units in sorted(s.units.items()):
        times = [u.pts for u in units if u.pts is not None]
        points = [u.pts for u in units if u.random_access]
        size = sum(len(u.data) for u in units)
        total = sum(sum(u.data) for u in units)
        out.append(f"pid={pid:04x},type={s.kinds.get(pid, 0):02x},units={len(units)},pts={times[0] if times else '-'}..{times[-1] if times else '-'},points={len(points)},last_point={points[-1] if points else '-'},mean={total * 1000 // max(1, size)}")
    return ";".join([*out, f"continuity={s.continuity_errors}", f"crc={s.crc_errors}", f"sync={s.sync_losses}"])


def times(s: Stream) -> tuple[int | None, int | None, list[int | None]]:
    """Presentation times of the first and the last unit that has one, and of the random-access points, in 1/90,000 s."""
    units = [u for _, units in sorted(s.units.items()) for u in units]
    known = [u.pts for u in units if u.pts is not None]
    return (known[0] if known else None, known[-1] if known else None, [u.pts for u in units if u.random_access])


def padded(raw: bytes) -> bytes:
    """raw with zeros up to a positive multiple of BLOCK."""
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a transport stream."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            _, offsets = at.utf8(column)
            for lo, hi in at.slices(offsets):
                raw = [(t or "").encode() for t in column.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def access_units(media: DataFrame) -> DataFrame:
    """From (doc_id, media): a row per elementary packet: doc_id, pid, stream_type, unit, pts, dts, random_access, data."""

    def run(batches):
        names = ["doc_id", "pid", "stream_type", "unit", "pts", "dts", "random_access", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = demux(data.as_py() or b"")
                rows = [(doc, pid, s.kinds.get(pid), i, u.pts, u.dts, u.random_access, u.data) for pid, units in sorted(s.units.items()) for i, u in enumerate(units)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, pid int, stream_type int, unit int, pts long, dts long, random_access boolean, data binary"
    return in_arrow(media.select(F.col("doc_id").cast("long"), "media"), run, schema)


def described(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): the digests of payload and stored form, the stream's features, and the presentation times
    of its units (first and last) and of all random-access points."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2):
                raw = data.as_py()
                s = demux(raw)
                payload = b"".join(u.data for u in s.units.get(DATA_PID, []))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), *times(s)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "first_pts", "last_pts", "random_access_pts"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, first_pts long, last_pts long, random_access_pts array<long>"
    return in_arrow(media, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return described(written(stored(documents(spark, sf_dir)), "media"))
