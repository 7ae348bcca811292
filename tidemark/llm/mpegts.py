"""Payloads in MPEG transport streams, and streams read back: program tables, continuity counters, elementary packets.

A stream holds one program with one private elementary stream (stream type 6). Its packetised elementary packets (PES)
carry UNIT payload bytes each, with a presentation timestamp one picture time (1/25 s, 90 kHz clock) apart. Every
ACCESS_EVERY-th packet is a random-access point: the program association and map tables stand before it, and its
adaptation field holds the random-access flag and a clock reference. Equal payloads make equal streams.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, widened

PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE_DATA = 188, 0x47, 0, 0x1000, 0x100, 1, 6
BLOCK = 576
UNIT, ACCESS_EVERY, TICKS = 8 * BLOCK, 4, 3600
#: Output goes back to Spark in pieces of about so many bytes.
CHUNK_BYTES = 8 << 20
UNITS = "array<struct<pts:bigint,offset:bigint,length:int,random_access:boolean>>"
PROGRAMS = "array<struct<program:int,pmt_pid:int,pid:int,stream_type:int>>"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section that ends with its right checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """The packets of the two program tables, continuity counters 0."""
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000))
    rows = [struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + body for pid, body in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(x.ljust(PACKET, b"\xff") for x in rows), np.uint8).reshape(2, PACKET)


@lru_cache(maxsize=4096)
def _pes_header(unit: int, size: int) -> bytes:
    t = unit * TICKS & (1 << 33) - 1
    stamp = bytes((0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1))
    return struct.pack(">IHBBB", 0x1BD, size + 8, 0x84, 0x80, 5) + stamp


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload; an empty one has no packets."""
    count = -(-len(payload) // UNIT)
    if not count:
        return b""
    units = [payload[i * UNIT : (i + 1) * UNIT] for i in range(count)]
    elementary = np.frombuffer(b"".join(x for i, u in enumerate(units) for x in (_pes_header(i, len(u)), u)), np.uint8)
    access = np.arange(count) % ACCESS_EVERY == 0
    size = np.array([len(u) + 14 for u in units])
    room = np.where(access, PACKET - 12, PACKET - 4)
    packets = 1 + -(-np.maximum(size - room, 0) // (PACKET - 4))
    last = np.cumsum(packets) - 1
    first = last - packets + 1
    unit = np.repeat(np.arange(count), packets)
    n = len(unit)
    load = np.full(n, PACKET - 4)
    load[first] = np.minimum(room, size)
    more = packets > 1
    load[last[more]] = (size - room - (packets - 2) * (PACKET - 4))[more]
    head = PACKET - load
    rows = np.full((n, PACKET), 255, np.uint8)
    rows[np.arange(PACKET) >= head[:, None]] = elementary
    rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    rows[first, 1] |= 0x40
    rows[:, 3] = np.where(head > 4, 0x30, 0x10) | np.arange(n) % 16
    rows[head > 4, 4] = head[head > 4] - 5
    rows[head > 5, 5] = 0
    at = first[access]
    clock = np.flatnonzero(access).astype(np.uint64) * TICKS
    rows[at, 5] = 0x50
    for k, shift in enumerate((25, 17, 9, 1)):
        rows[at, 6 + k] = clock >> np.uint64(shift) & np.uint64(255)
    rows[at, 10], rows[at, 11] = (clock & np.uint64(1)) << np.uint64(7) | np.uint64(0x7E), 0
    out = np.empty((n + 2 * len(at), PACKET), np.uint8)
    before = 2 * np.cumsum(access)[unit]
    out[np.arange(n) + before] = rows
    table_at = at + 2 * np.arange(len(at))
    for k in range(2):
        out[table_at + k] = _tables()[k]
        out[table_at + k, 3] |= (np.arange(len(at)) % 16).astype(np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    programs: list[tuple[int, int, int, int]] = field(default_factory=list)
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)
    payload: bytes = b""
    continuity_errors: int = 0
    damaged: int = 0


@lru_cache(maxsize=1024)
def _parse_section(section: bytes) -> tuple[int, int, bytes] | None:
    """Table id, number and content of a whole section; None if it is too short or its checksum is wrong."""
    if len(section) < 12 or section_crc(section):
        return None
    return section[0], struct.unpack(">H", section[3:5])[0], section[8:-4]


def assembled(parts: list[tuple[bool, bytes]]) -> tuple[list[bytes], int]:
    """The sections in a table's packets (begins, payload), which may span packets or share one, and the number of those cut off."""
    out, held, cut, going = [], b"", 0, False

    def settle(held: bytes) -> bytes:
        while len(held) >= 3 and held[0] != 0xFF:
            end = 3 + (struct.unpack(">H", held[1:3])[0] & 0xFFF)
            if len(held) < end:
                break
            out.append(held[:end])
            held = held[end:]
        return b"" if held[:1] == b"\xff" else held

    for begins, payload in parts:
        if begins and payload:
            at = 1 + payload[0]
            if going:
                cut += bool(settle(held + payload[1:at]))
            held, going = settle(payload[at:]), True
        elif going:
            held = settle(held + payload)
        elif payload:
            cut += 1
    return out, cut + bool(held)


def demux(data: bytes) -> Stream:
    """Reads a stream of whole packets.

    As damaged count, and are left out: packets without sync byte, an incomplete last packet, sections cut off or with a wrong checksum,
    elementary packets without start code or of a wrong length, and bytes before a stream's first packet start. A payload packet whose
    counter does not follow the one before it on its PID is a continuity error, unless its adaptation field says that the stream
    begins anew; one repetition of a packet is allowed and left out.
    """
    out = Stream()
    rows = np.frombuffer(data, np.uint8)[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == SYNC
    out.damaged = int((~good).sum()) + bool(len(data) % PACKET)
    rows = rows[good]
    pid = (rows[:, 1] & 31).astype(np.int32) << 8 | rows[:, 2]
    begins, control, counter = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    adapted = (control & 2 > 0) & (rows[:, 4] > 0)
    anew, access_flag = adapted & (rows[:, 5] & 0x80 > 0), adapted & (rows[:, 5] & 0x40 > 0)
    start = np.where(control & 2, np.minimum(5 + rows[:, 4].astype(np.int32), PACKET), 4)

    def packets(number: int) -> np.ndarray:
        """The payload packets of a PID without repetitions; counts continuity errors."""
        at = np.flatnonzero((pid == number) & (control & 1 > 0))
        if len(at) < 2:
            return at
        step = np.diff(counter[at].astype(np.int32)) & 15
        again = np.r_[False, step == 0]
        again[again] = (rows[at[again]] == rows[at[np.flatnonzero(again) - 1]]).all(axis=1)
        again &= ~np.r_[False, again[:-1]]
        at = at[~again]
        step = np.diff(counter[at].astype(np.int32)) & 15
        out.continuity_errors += int(((step != 1) & ~anew[at[1:]]).sum())
        return at

    def sections(number: int, table_id: int):
        whole, cut = assembled([(bool(begins[i]), rows[i, start[i] :].tobytes()) for i in packets(number)])
        out.damaged += cut
        for section in whole:
            if (found := _parse_section(section)) is None:
                out.damaged += 1
            elif found[0] == table_id:
                yield found

    maps = {p & 0x1FFF: n for _, _, body in sections(PAT_PID, 0) for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}
    streams: dict[int, tuple[int, int, int, int]] = {}
    for map_pid, program in maps.items():
        for _, _, body in sections(map_pid, 2):
            at = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF)
            while at + 5 <= len(body):
                kind, own, info = struct.unpack(">BHH", body[at : at + 5])
                streams[own & 0x1FFF] = (program, map_pid, own & 0x1FFF, kind)
                at += 5 + (info & 0xFFF)
    out.programs = [streams[k] for k in sorted(streams)]
    parts: list[bytes] = []
    offset = 0
    for own in sorted(streams):
        at = packets(own)
        if not len(at):
            continue
        own_rows, own_start = rows[at], start[at]
        flat = own_rows[np.arange(PACKET) >= own_start[:, None]].tobytes()
        ends = np.cumsum(PACKET - own_start)
        first = np.flatnonzero(begins[at])
        out.damaged += not begins[at[0]]
        lo = (ends - (PACKET - own_start))[first].tolist()
        for a, b, access in zip(lo, [*lo[1:], len(flat)], access_flag[at][first].tolist(), strict=True):
            size = struct.unpack(">H", flat[a + 4 : a + 6])[0] if b - a >= 9 else 0
            if b - a < 14 or flat[a : a + 3] != b"\0\0\1" or size and size + 6 != b - a:
                out.damaged += 1
                continue
            t = flat[a + 9 : a + 14]
            stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if flat[a + 7] & 0x80 else -1
            parts.append(flat[a + 9 + flat[a + 8] : b])
            out.units.append((stamp, offset, len(parts[-1]), access))
            offset += len(parts[-1])
    out.payload = b"".join(parts)
    return out


def _batched(rows, sizes):
    """Splits lists of rows into runs of about CHUNK_BYTES."""
    start = size = 0
    for i, s in enumerate(sizes):
        if i > start and size + s > CHUNK_BYTES:
            yield rows[start:i], start
            start, size = i, 0
        size += s
    if start < len(rows):
        yield rows[start:], start


def pack(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_bytes (UTF-8 bytes of the text) and media (its padded payload's transport stream). A null text counts as empty: one block of padding."""
    names = list(keep)
    schema = widened(df.select(*names).schema, "n_bytes bigint, media binary")

    def run(batches):
        for batch in batches:
            texts = batch.column("_text")
            for part, lo in _batched(range(len(texts)), pc.binary_length(texts).to_pylist()):
                raw = [x.as_py() for x in texts.slice(lo, len(part)).cast(pa.binary())]
                made = pa.array([mux(pad(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(part)) for k in names), pa.array(list(map(len, raw)), pa.int64()), made], [*names, "n_bytes", "media"])

    return df.select(*names, whole_text(text).alias("_text")).mapInArrow(run, schema)


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what a stream holds: payload, programs, units (timestamp, offset, length, random access), continuity_errors and damaged.
    Null media give an empty payload and no units."""
    more_names = ["payload", "programs", "units", "continuity_errors", "damaged"]
    schema = widened(df.schema, f"payload binary, programs {PROGRAMS}, units {UNITS}, continuity_errors int, damaged int")
    names = [k for k in df.columns if k not in more_names]
    kinds = [pa.list_(pa.struct([(k, t) for k, t in x])) for x in ([(k, pa.int32()) for k in ("program", "pmt_pid", "pid", "stream_type")], [("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("random_access", pa.bool_())])]

    def listed(rows: list[list[tuple]], kind) -> pa.Array:
        flat = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(kind.value_type)
        values = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, kind.value_type, strict=True)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    def run(batches):
        for batch in batches:
            column = batch.column(media)
            for part, lo in _batched(range(len(column)), pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                got = [demux(x.as_py() or b"") for x in column.slice(lo, len(part))]
                more = [pa.array([g.payload for g in got], pa.binary()), listed([g.programs for g in got], kinds[0]), listed([g.units for g in got], kinds[1]), pa.array([g.continuity_errors for g in got], pa.int32()), pa.array([g.damaged for g in got], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(part)) for k in names), *more], [*names, *more_names])

    return df.mapInArrow(run, schema)


def digests(documents: DataFrame) -> DataFrame:
    """Digests of the payload read back and of the stored stream, with a feature string. It holds counts, the first and last timestamp, and
    digests over all units (timestamp, offset, length) and all random-access points (timestamp, offset).

    A null text counts as empty: one block of padding. Repeated rows are given as often, equal texts have equal values, other columns
    are not read, and an empty table gives no rows.
    """
    listed = lambda xs, *names: F.md5(F.array_join(F.transform(xs, lambda u: F.concat_ws("@", *[u[k].cast("string") for k in names])), ","))
    got = probe(pack(documents))
    units = F.col("units")
    access = F.filter(units, lambda u: u.random_access)
    feature = F.concat_ws(
        ";",
        F.format_string("programs=%d", F.size("programs")),
        F.format_string("units=%d@%s", F.size(units), listed(units, "pts", "offset", "length")),
        F.format_string("pts=%d-%d", F.array_min(units.pts), F.array_max(units.pts)),
        F.format_string("access=%d@%s", F.size(access), listed(access, "pts", "offset")),
        F.format_string("continuity=%d", F.col("continuity_errors")),
        F.format_string("damaged=%d", F.col("damaged")),
    )
    return got.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
