"""MPEG transport streams: writing, parsing program tables, checking continuity, reassembling elementary packets.

`mux` stores payloads as the private-data stream of one program; `parse` reads any stream of 188-byte packets: it follows
the program association and map tables (sections may span packets; their CRC is checked), counts continuity errors for each
PID (repeated packets and announced discontinuities are not errors), reassembles packetized elementary streams, and keeps
each one's timestamps and whether it starts at a random-access point.

`media_table` applies the parser to a column of streams. A null stream, an empty one, or one without a sync byte gives a
stream without programs; trailing bytes that fill no packet are ignored. `store_texts` takes null and empty texts as one padded
unit; a very long text is one row and one stream, held whole by the task that writes it. Repeated rows keep a row each, with
equal values for equal texts; null ids stay null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspec.llm.common import ID, TEXT, id_text, ship

PACKET = 188
BODY = PACKET - 4
#: Fixed values of the format: sync byte, PID of the association table, of null packets, stream type of private data.
SYNC, PAT_PID, NULL_PID, PRIVATE_DATA = 0x47, 0, 0x1FFF, 0x06
PMT_PID, ES_PID, PROGRAM, STREAM_ID = 0x100, 0x101, 1, 0xBD
#: Bytes of payload that are padded to and that make a unit; units in an elementary packet; clock ticks (90 kHz) of a unit.
UNIT, UNITS, TICKS = 576, 16, 1080
CLOCK = 1 << 33


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC of program tables; over a section with its CRC it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section + b"\xff" * (BODY - 1 - len(section))


PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(mark: int, t: int) -> bytes:
    """33 bits of a timestamp between marker bits."""
    return bytes([mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def _elementary(pts: int, data: bytes, aligned: bool) -> bytes:
    size = 8 + len(data)
    head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (size if size < 65536 else 0).to_bytes(2, "big")
    return head + bytes([0x84 if aligned else 0x80, 0x80, 5]) + _stamp(2, pts) + data


def mux(payload: bytes, start_pts: int = 0) -> bytes:
    """A stream of whole packets that holds the payload; each elementary packet starts at a random-access point."""
    out, counter = [PAT, PMT], 0
    step = UNIT * UNITS
    for k in range(0, max(len(payload), 1), step):
        pts = (start_pts + k // UNIT * TICKS) % CLOCK
        data = _elementary(pts, payload[k : k + step], True)
        # the first packet has an adaptation field with the random-access flag and the clock reference
        ref = (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = BODY - 8
        stuffing = max(0, room - len(data))
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | counter, 7 + stuffing, 0x50]) + ref + b"\xff" * stuffing + data[: room - stuffing])
        counter = counter + 1 & 15
        rest = data[room:]
        full, left = divmod(len(rest), BODY)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if left:
            field_len = BODY - left - 1
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter, field_len]) + (b"\x00" + b"\xff" * (field_len - 1) if field_len else b"") + rest[full * BODY :])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: its stream, presentation and decoding time, random access, and data."""

    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)  # program -> {PID: stream type}
    continuity_errors: int = 0
    bad_sections: int = 0
    lost_sync: int = 0
    units: list[Unit] = field(default_factory=list)

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join([x.data for x in self.units if pid is None or x.pid == pid])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _read_elementary(pid: int, data: bytes, random_access: bool) -> Unit | None:
    if data[:3] != b"\x00\x00\x01" or len(data) < 6:
        return None
    size, pts, dts, at = int.from_bytes(data[4:6], "big"), None, None, 6
    if data[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(data) >= 9:
        flags, at = data[7] >> 6, 9 + data[8]
        if flags & 2 and len(data) >= 14:
            pts = _read_stamp(data[9:14])
        if flags == 3 and len(data) >= 19:
            dts = _read_stamp(data[14:19])
    return Unit(pid, data[3], pts, dts, random_access, data[at : 6 + size if size else None])


def _sections(data: bytes) -> Iterator[bytes]:
    """The whole sections at the start of data; stuffing ends them."""
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if len(data) < size:
            return
        yield data[:size]
        data = data[size:]


def parse(stream: bytes | None) -> Stream:
    out = Stream()
    n = len(stream or b"") // PACKET
    if not n:
        return out
    raw = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    good = raw[:, 0] == SYNC
    out.lost_sync, out.packets = int(n - good.sum()), int(good.sum())
    raw = raw[good]
    pids = (raw[:, 1].astype(np.int32) & 0x1F) << 8 | raw[:, 2]
    has_body, has_field = (raw[:, 3] & 0x10) > 0, (raw[:, 3] & 0x20) > 0
    field_len = np.where(has_field, raw[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(has_field & (field_len > 1), raw[:, 5], 0)
    begins = (raw[:, 1] & 0x40) > 0
    counters = raw[:, 3] & 15
    bodies = np.minimum(4 + field_len, PACKET)

    def body(i: int) -> bytes:
        return raw[i, bodies[i] :].tobytes() if has_body[i] else b""

    def tables(pid: int) -> Iterator[bytes]:
        held = b""
        for i in np.flatnonzero((pids == pid) & has_body):
            data = body(i)
            if begins[i]:
                pointer = data[0]
                yield from _checked(held + data[1 : 1 + pointer])
                held = data[1 + pointer :]
            else:
                held += data
        yield from _checked(held)

    def _checked(data: bytes) -> Iterator[bytes]:
        for section in _sections(data):
            if section_crc(section):
                out.bad_sections += 1
            else:
                yield section

    for section in tables(PAT_PID):
        for k in range(8, len(section) - 4, 4):
            number, pid = int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
            if section[0] == 0 and number and number not in out.programs:
                out.programs[number] = {}
                for table in tables(pid):
                    if table[0] != 2 or int.from_bytes(table[3:5], "big") != number:
                        continue
                    at = 12 + (int.from_bytes(table[10:12], "big") & 0xFFF)
                    while at + 5 <= len(table) - 4:
                        out.programs[number][int.from_bytes(table[at + 1 : at + 3], "big") & 0x1FFF] = table[at]
                        at += 5 + (int.from_bytes(table[at + 3 : at + 5], "big") & 0xFFF)

    for pid in sorted({int(p) for p in np.unique(pids)} - {NULL_PID}):
        own = np.flatnonzero(pids == pid)
        step = (counters[own][1:].astype(int) - counters[own][:-1]) & 15
        expected = has_body[own][1:].astype(int)
        repeated = (step == 0) & has_body[own][1:]
        announced = (flags[own][1:] & 0x80) > 0
        twice = repeated & (raw[own][1:] == raw[own][:-1]).all(1) if repeated.any() else repeated
        out.continuity_errors += int(((step != expected) & ~twice & ~announced).sum())
        if not any(pid in x for x in out.programs.values()):
            continue
        own = own[np.concatenate([[True], ~twice])]
        own = own[has_body[own]]
        starts = np.flatnonzero(begins[own])
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            group = own[a:b]
            plain = group[1:][bodies[group[1:]] == 4]
            if len(plain) == len(group) - 1:
                data = body(group[0]) + raw[plain, 4:].tobytes()
            elif len(plain) == len(group) - 2 and bodies[group[-1]] > 4:
                data = body(group[0]) + raw[plain, 4:].tobytes() + body(group[-1])
            else:
                data = b"".join([body(i) for i in group])
            if (unit := _read_elementary(pid, data, bool(flags[group[0]] & 0x40))) is not None:
                out.units.append(unit)
    return out


def feature(stream: Stream) -> str:
    """What a stream holds, in a line."""
    times = [x.pts for x in stream.units if x.pts is not None]
    points = [x.pts for x in stream.units if x.random_access]
    ends = f"{times[0]}-{times[-1]}" if times else "-"
    return f"programs={len(stream.programs)};packets={stream.packets};units={len(stream.units)};pts={ends};random_access={len(points)};continuity_errors={stream.continuity_errors};bad_sections={stream.bad_sections}"


def padded(data: bytes) -> bytes:
    """Followed by bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT or UNIT * (not data))


_COLUMNS = "media binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, timestamps array<bigint>, random_access array<bigint>"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as a stream, and what is read back from it.

    One row per input row; a null text counts as empty, an empty one is padded to one unit. With keep_media false the
    stored bytes and the lists of timestamps are left out of the result, after they were read back.
    """
    kept = [x.strip() for x in _COLUMNS.split(", ")]
    kept = kept if keep_media else kept[1:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):  # streams of few rows at a time are held
                part = batch.slice(first, 500)
                rows: dict[str, list] = {x.split(" ", 1)[0]: [] for x in kept}
                for data in part.column("data").to_pylist():
                    media = mux(padded(data))
                    stream = parse(media)
                    payload = stream.payload(ES_PID)
                    got = {"media": media, "n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(stream)}
                    if keep_media:
                        got |= {"timestamps": [x.pts for x in stream.units], "random_access": [x.pts for x in stream.units if x.random_access]}
                    for k, v in rows.items():
                        v.append(got[k])
                types = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([part.column(ID), *(pa.array(rows[x.split(" ", 1)[0]], types[x.split(" ", 1)[1]]) for x in kept)], names=[id_col, *rows])

    data = id_text(docs, id_col, text_col)
    return data.select(ID, data[TEXT].cast("binary").alias("data")).mapInArrow(run, f"`{id_col}` bigint, " + ", ".join(kept))


def media_table(streams: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per elementary packet of each stream: id, program, pid, stream type, position, pts, dts, random_access, data, and the stream's continuity errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "program", "pid", "stream_type", "position", "pts", "dts", "random_access", "data", "continuity_errors"]
        for batch in batches:
            for key, media in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                stream = parse(media)
                kinds = {pid: (program, kind) for program, own in stream.programs.items() for pid, kind in own.items()}
                rows = [(key, *kinds[u.pid][:1], u.pid, kinds[u.pid][1], i, u.pts, u.dts, u.random_access, u.data, stream.continuity_errors) for i, u in enumerate(stream.units)]
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ship(streams.sparkSession)
    schema = "id bigint, program int, pid int, stream_type int, position int, pts bigint, dts bigint, random_access boolean, data binary, continuity_errors bigint"
    return streams.select(streams[id_col].cast("bigint").alias("id"), streams[media_col].alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
