"""MPEG transport streams as media columns (operator 7).

The reader parses the program tables (PAT, then PMT), checks continuity counters, reassembles the
packetised elementary stream and keeps each unit's timestamp with the random-access points. The
writer makes streams of one program with one private elementary stream.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import slices

PACKET, ROOM, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE, STUFFING = 0xBD, 0x06, 0xFF
TICKS = 3003  # of 90 kHz, between units
UNIT, UNITS_PER_POINT = 16 * 576, 8  # bytes of a unit; units from one random-access point to the next


@functools.lru_cache(maxsize=64)
def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def packet_head(pid: int, starts: bool, control: int, counter: int) -> bytes:
    return bytes((SYNC, starts << 6 | pid >> 8, pid & 0xFF, control << 4 | counter & 15))


def table_packet(pid: int, payload: bytes) -> bytes:
    return (packet_head(pid, True, 1, 0) + b"\x00" + payload).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)
MIDDLE = [packet_head(ES_PID, False, 1, c) for c in range(16)]


def stamp(ticks: int) -> bytes:
    return bytes((0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1))


def unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def padded(adaptation: bytes, length: int) -> bytes:
    """An adaptation field of that many bytes in all, its length byte included."""
    return b"\x00" if length == 1 else bytes([length - 1]) + adaptation.ljust(length - 1, b"\xff")


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream, in units of UNIT bytes."""
    out, counter = [TABLES], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        ticks = number * TICKS & (1 << 33) - 1
        unit = payload[at : at + UNIT]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(ticks) + unit
        point = number % UNITS_PER_POINT == 0
        clock = (ticks << 15 | 0x3F << 9).to_bytes(6, "big")
        adaptation = bytes([0x50 if point else 0x10]) + clock
        first = max(8, ROOM - len(data))
        out += (packet_head(ES_PID, True, 3, counter), padded(adaptation, first), data[: ROOM - first])
        counter, done = counter + 1, ROOM - first
        while len(data) - done >= ROOM:
            out += (MIDDLE[counter & 15], data[done : done + ROOM])
            counter, done = counter + 1, done + ROOM
        if done < len(data):
            rest = data[done:]
            out += (packet_head(ES_PID, False, 3, counter), padded(b"\x00", ROOM - len(rest)), rest)
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    kind: int
    units: list[bytes] = field(default_factory=list)
    stamps: list[int | None] = field(default_factory=list)
    points: list[tuple[int | None, int]] = field(default_factory=list)  # (timestamp, packet)


@dataclass
class Media:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # number -> PID of its map
    streams: dict[int, Stream] = field(default_factory=dict)  # PID -> stream
    clocks: dict[int, list[int]] = field(default_factory=dict)  # PID -> program clock, of 27 MHz
    discontinuities: int = 0
    bad_sections: int = 0  # of a wrong CRC, or not whole
    cut_units: int = 0  # that have no header, or end before the length that it says


def read_stream(raw: bytes) -> Media:
    """Parses a stream. A break in a continuity counter drops the unit it is in, and one that ends before
    the length of its header is dropped as well; a table whose CRC is wrong is not used; a repeated
    packet counts once. A packet may hold the end of a section and any number of further ones. Raises
    ValueError where packets lose their sync."""
    if len(raw) % PACKET:
        raise ValueError("not whole packets")
    media, counters, last = Media(packets=len(raw) // PACKET), {}, {}
    open_units: dict[int, list[bytes]] = {}
    sections: dict[int, bytes] = {}
    maps: set[int] = set()
    point_at: dict[int, int] = {}

    def close(pid: int) -> None:
        if (parts := open_units.pop(pid, None)) is None:
            return
        data, stream = b"".join(parts), media.streams[pid]
        point, said = point_at.pop(pid, None), int.from_bytes(data[4:6], "big")
        if len(data) < 9 or data[:3] != b"\x00\x00\x01" or len(data) < max(9 + data[8], 6 + said):
            media.cut_units += 1
            return
        begins = 9 + data[8]
        ticks = unstamp(data[9:14]) if data[7] & 0x80 else None
        stream.units.append(data[begins : 6 + said if said else len(data)])
        stream.stamps.append(ticks)
        if point is not None:
            stream.points.append((ticks, point))

    def gather(pid: int, data: bytes) -> bytes:
        """Reads whole sections off the front, and returns what begins the next one."""
        while data and data[0] != STUFFING:
            need = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < 3 or len(data) < need:
                return data
            table(pid, data[:need])
            data = data[need:]
        return b""

    def table(pid: int, whole: bytes) -> None:
        if len(whole) < 12 or crc32_mpeg(whole[:-4]) != int.from_bytes(whole[-4:], "big"):
            media.bad_sections += 1
            return
        if pid == PAT_PID and whole[0] == 0:
            for k in range(8, len(whole) - 4, 4):
                number, where = int.from_bytes(whole[k : k + 2], "big"), int.from_bytes(whole[k + 2 : k + 4], "big") & 0x1FFF
                if number:
                    media.programs[number] = where
                    maps.add(where)
        elif pid in maps and whole[0] == 2:
            k = 12 + (int.from_bytes(whole[10:12], "big") & 0xFFF)
            while k < len(whole) - 4:
                where = int.from_bytes(whole[k + 1 : k + 3], "big") & 0x1FFF
                media.streams.setdefault(where, Stream(whole[k]))
                k += 5 + (int.from_bytes(whole[k + 3 : k + 5], "big") & 0xFFF)

    for number in range(media.packets):
        at = number * PACKET
        if raw[at] != SYNC:
            raise ValueError(f"packet {number} is out of sync")
        second, flags = raw[at + 1], raw[at + 3]
        pid = (second & 0x1F) << 8 | raw[at + 2]
        if pid == NULL_PID:
            continue
        control, begin, random_access, announced = flags >> 4 & 3, at + 4, False, False
        if control & 2:
            if raw[begin]:
                random_access, announced = bool(raw[begin + 1] & 0x40), bool(raw[begin + 1] & 0x80)
                if raw[begin + 1] & 0x10 and raw[begin] >= 7:
                    clock = int.from_bytes(raw[begin + 2 : begin + 8], "big")
                    media.clocks.setdefault(pid, []).append((clock >> 15) * 300 + (clock & 0x1FF))
            begin += 1 + raw[begin]
        if not control & 1:
            continue
        counter, before = flags & 15, counters.get(pid)
        if before is not None and not announced and counter != (before + 1 & 15):
            if counter == before and raw[last[pid] : last[pid] + PACKET] == raw[at : at + PACKET]:
                continue
            media.discontinuities += 1
            open_units.pop(pid, None)
            sections.pop(pid, None)
        counters[pid], last[pid] = counter, at
        payload = raw[min(begin, at + PACKET) : at + PACKET]
        if pid in media.streams:
            if second & 0x40:
                close(pid)
                open_units[pid] = [payload]
                if random_access:
                    point_at[pid] = number
            elif pid in open_units:
                open_units[pid].append(payload)
        elif (pid == PAT_PID or pid in maps) and payload:
            held = sections.pop(pid, b"")
            if second & 0x40:
                first = 1 + payload[0]
                if held and gather(pid, held + payload[1:first]) or first > len(payload):
                    media.bad_sections += 1
                sections[pid] = gather(pid, payload[first:])
            elif held:
                sections[pid] = gather(pid, held + payload)
    media.bad_sections += sum(map(bool, sections.values()))
    for pid in list(open_units):
        close(pid)
    return media


def feature(media: Media, stream: Stream) -> str:
    shown = [s for s in stream.stamps if s is not None]
    return f"programs={len(media.programs)} streams={len(media.streams)} type={stream.kind} packets={media.packets} units={len(stream.units)} points={len(stream.points)} clocks={sum(map(len, media.clocks.values()))} first={shown[0] if shown else ''} last={shown[-1] if shown else ''} breaks={media.discontinuities}"


def text_media(df: DataFrame, block: int = 576, tail: int = 32, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 8 << 20) -> DataFrame:
    """Each text as a transport stream and back: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, points), one row for each row in.

    The payload is the text's UTF-8, with bytes 255 up to a positive multiple of `block`; so a null or
    empty text is one block of them. points: timestamp and packet of the random-access points. Equal
    texts have equal values; ids may be null or repeat; an empty table gives an empty result; other
    columns are not looked at.
    """
    kind = df.schema[id_column].dataType.simpleString()
    points = pa.list_(pa.struct([("ticks", pa.int64()), ("packet", pa.int64())]))
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                rows = []
                for text in batch.column(1):
                    raw = (text.as_py() or "").encode()
                    stored = write_stream(raw.ljust(max(1, -(-len(raw) // block)) * block, b"\xff"))
                    media = read_stream(stored)
                    (stream,) = media.streams.values()
                    read = b"".join(stream.units)
                    if media.discontinuities or media.bad_sections or media.cut_units:
                        raise ValueError("a stream was not read back whole")
                    rows.append((len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-tail:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, stream), [{"ticks": t, "packet": p} for t, p in stream.points]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    schema = f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<ticks: bigint, packet: bigint>>"
    return df.select(id_column, text_column).mapInArrow(run, schema)
