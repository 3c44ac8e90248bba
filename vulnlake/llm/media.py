"""MPEG transport streams in a binary column: a small muxer, and a parser for what such a column holds.

A stream has 188-byte packets. The parser reads the program association and map tables, checks continuity counters
per packet id, puts elementary packets together again and keeps their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import id_and_text, slices

#: Fixed values of the format, and of the streams that are written here.
PACKET, SYNC, NULL_PID, STUFFING = 188, 0x47, 0x1FFF, 0xFF
PMT_PID, DATA_PID, PRIVATE_DATA, PRIVATE_STREAM = 0x1000, 0x100, 0x06, 0xBD
UNIT_BYTES, RANDOM_EVERY, CLOCK_STEP = 4096, 4, 3600


def table_crc(data: bytes, crc: int = 0xFFFFFFFF) -> int:
    """CRC-32 of a table section (most significant bit first, no final inversion)."""
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A table section that fits in one packet, with its pointer byte and stuffing."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    whole = head + body
    return (b"\0" + whole + table_crc(whole).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


PAT = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")


def timestamp_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def clock_bytes(pts: int) -> bytes:
    return (pts << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A single-program stream that carries the payload as timed access units of `UNIT_BYTES`."""
    out = [b"\x47\x40\x00\x10", PAT, bytes([SYNC, 0x40 | PMT_PID >> 8, PMT_PID & 0xFF, 0x10]), PMT]
    counter = 0
    for unit, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, pts = payload[start : start + UNIT_BYTES], (unit * CLOCK_STEP) & 0x1FFFFFFFF
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp_bytes(pts) + data
        field = b"\x50" + clock_bytes(pts) if unit % RANDOM_EVERY == 0 else b""
        at = 0
        while at < len(pes):
            first = 0x40 if at == 0 else 0
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            body = pes[at : at + room]
            at += len(body)
            if len(body) < room:  # stuffing goes to the adaptation field
                spare = PACKET - 4 - len(body)
                field = b"" if spare == 1 else (field or b"\0").ljust(spare - 1, b"\xff")
                adapted = bytes([spare - 1]) + field
            else:
                adapted = bytes([len(field)]) + field if field else b""
            out.append(bytes([SYNC, first | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adapted else 0x10) | counter]) + adapted + body)
            counter, field = counter + 1 & 15, b""
    return b"".join(out)


class Tables:
    """The program tables of a stream, put together from sections, which may go over several packets.

    A section counts once it is whole and its checksum holds; those marked as not yet in force are left out. Sections of
    one version add up; a new version replaces what the one before said.
    """

    def __init__(self):
        self.programs: dict[int, int] = {}  # program -> pid of its map
        self.maps: dict[int, dict[int, int]] = {}  # program -> its streams: pid -> type
        self.streams: dict[int, int] = {}
        self.open: dict[int, bytes] = {}  # pid -> what has come of a section
        self.versions: dict[tuple[int, int], int] = {}
        self.broken = 0

    def dropped(self, pid: int) -> None:
        """The section that was being put together is lost."""
        self.broken += pid in self.open
        self.open.pop(pid, None)

    def take(self, pid: int, body: bytes, start: bool) -> None:
        """A packet's payload; with `start` its first byte tells where the first new section begins."""
        if not start:
            if pid in self.open:
                self.read(pid, self.open[pid] + body)
            return
        begin = 1 + body[0] if body else 0
        if pid in self.open:
            self.read(pid, self.open[pid] + body[1:begin])
            self.dropped(pid)
        if body and begin < len(body):
            self.read(pid, body[begin:])
        else:
            self.broken += 1

    def read(self, pid: int, data: bytes) -> None:
        self.open.pop(pid, None)
        while data and data[0] != STUFFING:
            end = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF) if len(data) >= 3 else len(data) + 1
            if end > len(data):
                self.open[pid] = data
                return
            whole, data = data[:end], data[end:]
            if end < 12 or table_crc(whole[:-4]) != int.from_bytes(whole[-4:], "big"):
                self.broken += 1
            elif whole[5] & 1:
                self.told(pid, whole[0], int.from_bytes(whole[3:5], "big"), whole[5] >> 1 & 31, whole[8:-4])

    def told(self, pid: int, table: int, number: int, version: int, body: bytes) -> None:
        if not (table == 0 and pid == 0 or table == 2 and self.programs.get(number) == pid and len(body) >= 4):
            return
        new = self.versions.get((table, number)) != version
        self.versions[table, number] = version
        if table == 0:
            found = {int.from_bytes(body[i : i + 2], "big"): int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body) - 3, 4)}
            found.pop(0, None)  # network information, no program
            self.programs = found if new else self.programs | found
        else:
            found, i = {} if new else self.maps[number], 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while i + 5 <= len(body):
                found[int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF] = body[i]
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)
            self.maps[number] = found
        self.streams = {pid: kind for program in self.programs for pid, kind in self.maps.get(program, {}).items()}


def demux(stream: bytes) -> dict:
    """What a stream holds: programs, elementary streams, packet and error counts, access units and their bytes.

    Bytes outside packets are skipped up to the next sync byte and counted; a repeated packet is dropped once; a gap in
    a counter is an error and ends the unit that was being put together (it stays, marked as not whole).
    """
    tables = Tables()
    counters: dict[int, int] = {}
    open_units: dict[int, dict] = {}
    units: list[dict] = []
    packets = gaps = broken = skipped = clocks = at = 0

    def close(pid: int, whole: bool = True) -> None:
        if unit := open_units.pop(pid, None):
            raw = b"".join(unit.pop("parts"))
            if raw[:3] != b"\0\0\1" or len(raw) < 9:
                whole, data = False, b""
            else:
                told = int.from_bytes(raw[4:6], "big")
                data = raw[9 + raw[8] : 6 + told if told else len(raw)]
                whole = whole and (not told or len(raw) >= 6 + told)
                if raw[7] & 0x80 and len(raw) >= 14:
                    p = raw[9:14]
                    unit["pts"] = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
            units.append(unit | {"data": data, "whole": whole})

    while at + PACKET <= len(stream):
        if stream[at] != SYNC:
            at, skipped = at + 1, skipped + 1
            continue
        b1, b2, b3 = stream[at + 1 : at + 4]
        pid, start, control, counter = (b1 & 0x1F) << 8 | b2, b1 & 0x40, b3 >> 4 & 3, b3 & 15
        packets += 1
        body_at, marks = at + 4, 0
        if control & 2:
            if stream[at + 4]:
                marks = stream[at + 5]
            body_at += 1 + stream[at + 4]
        body = stream[body_at : at + PACKET] if control & 1 else b""
        at += PACKET
        if b1 & 0x80:
            broken += 1
            continue
        if pid == NULL_PID:
            continue
        clocks += bool(marks & 0x10)
        if control & 1:
            before = counters.get(pid)
            counters[pid] = counter
            if before is not None and not marks & 0x80:
                if counter == before:
                    continue
                if counter != before + 1 & 15:
                    gaps += 1
                    close(pid, whole=False)
                    tables.dropped(pid)
        if pid == 0 or pid in tables.programs.values():
            if control & 1:
                tables.take(pid, body, bool(start))
        elif pid in tables.streams:
            if start:
                close(pid)
                open_units[pid] = {"pid": pid, "pts": None, "random": bool(marks & 0x40), "parts": [body]}
            elif pid in open_units:
                open_units[pid]["parts"].append(body)
    for pid in list(open_units):
        close(pid)
    for pid in list(tables.open):
        tables.dropped(pid)
    return {"programs": tables.programs, "streams": tables.streams, "packets": packets, "gaps": gaps, "broken": broken + tables.broken, "skipped": skipped + len(stream) - at, "clocks": clocks, "units": units}


UNIT = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random", pa.bool_()), ("whole", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64())])
PARSED = (
    "programs map<int,int>, streams map<int,int>, packets long, gaps long, broken long, skipped long, clocks long, "
    "units array<struct<pid:int,pts:long,random:boolean,whole:boolean,offset:long,size:long>>, payload binary"
)


def padded(text: str | None, block: int = 64) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % block if raw else block)


def mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            media = [mux(padded(t)) for t in part["text"].to_pylist()]
            sizes = pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(part["text"]), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([part["doc_id"], sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def texts_to_streams(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, media`: each text (null: empty) padded with zeros to a positive multiple of 64, as a stream.

    Repeated rows stay repeated, an empty table gives an empty one, a very long text is one stream, held whole in its task;
    other columns are left out.
    """
    return id_and_text(docs).mapInArrow(mux_rows, "doc_id long, n_bytes long, media binary")


def parse_rows(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media"):
            found = [demux(m or b"") for m in part["media"].to_pylist()]
            payloads = [b"".join([u["data"] for u in f["units"]]) for f in found]
            for f in found:
                offset = 0
                for u in f["units"]:
                    size = len(u.pop("data"))
                    u |= {"offset": offset, "size": size}
                    offset += size
            pairs = lambda k: pa.array([sorted(f[k].items()) for f in found], pa.map_(pa.int32(), pa.int32()))
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in ("packets", "gaps", "broken", "skipped", "clocks")]
            columns = [pairs("programs"), pairs("streams"), *counts, pa.array([f["units"] for f in found], pa.list_(UNIT)), pa.array(payloads, pa.binary())]
            names = ["programs", "streams", "packets", "gaps", "broken", "skipped", "clocks", "units", "payload"]
            yield pa.RecordBatch.from_arrays([*[part[k] for k in keep], *columns], names=[*keep, *names])


def parse_streams(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """The columns `keep` and `media`, with what the stream in `media` holds: tables, checks, timed units and their bytes.

    A null or empty stream has no packets, empty tables and an empty payload. Repeated rows stay repeated, an empty table
    gives an empty one. A kept column may not be named like one of the results (`programs`, `payload` and so on).
    """
    chosen = df.select(*keep, F.col(media).alias("media"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(lambda batches: parse_rows(batches, [*keep, "media"]), f"{kinds}, {PARSED}")


def digests(parsed: DataFrame) -> DataFrame:
    """The digest columns of a parsed stream column, by built-in functions."""
    units = F.col("units")
    randoms = F.filter(units, lambda u: u["random"])
    shown = F.concat_ws(
        ";",
        F.concat(F.lit("programs="), F.array_join(F.transform(F.map_entries("programs"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")),
        F.concat(F.lit("streams="), F.array_join(F.transform(F.map_entries("streams"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")),
        F.concat(F.lit("packets="), "packets"), F.concat(F.lit("gaps="), "gaps"), F.concat(F.lit("broken="), "broken"),
        F.concat(F.lit("clocks="), "clocks"), F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("last_pts="), F.coalesce(F.array_max(F.transform(units, lambda u: u["pts"])), F.lit(-1))),
        F.concat(F.lit("random="), F.array_join(F.transform(randoms, lambda u: u["pts"]), ",")),
    )
    size = F.length("payload")
    return parsed.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), shown.alias("feature"),
    )
