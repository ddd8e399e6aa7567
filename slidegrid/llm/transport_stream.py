"""MPEG transport streams as a media column.

``store_streams`` writes each text's bytes as a transport stream: a program
association table, a program map table and one private elementary stream, whose
access units carry timestamps and, at every eighth unit, a random-access point
with a clock reference. ``read_streams`` parses stored streams: it follows PAT
to PMT to the elementary stream, verifies table checksums and continuity
counters, reassembles the elementary packets and collects timestamps and
random-access points. ``elementary_packets`` gives them one row a unit.

Edge cases: a null or empty text stores 64 zero bytes; equal texts give equal
streams; bytes that are no transport stream read as no payload with ``ok``
false, and so do empty or torn tables; a packet sent twice counts once; after
lost packets the payload holds what arrived and ``ok`` is false; a null stream
reads as null; very long texts are stored whole, one text at a time; ties do
not occur; repeated rows are kept; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import byte_column, chunks

PACKET, PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 188, 0, 0x100, 0x101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT, TICKS, RANDOM_ACCESS = 16_000, 3600, 8
_COLS = np.arange(PACKET)


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), key, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(head.ljust(PACKET, b"\xff"), dtype=np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000)))


def _timestamp(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFF | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFF | 1))


def mux(payload: bytes) -> bytes:
    """The transport stream that holds ``payload``."""
    parts, counter = [], 0
    for i, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        chunk, pts, access = payload[at : at + UNIT], (i * TICKS) & (1 << 33) - 1, i % RANDOM_ACCESS == 0
        body = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(chunk) + 8, 0x84, 0x80, 5) + _timestamp(pts) + chunk
        if access:
            for table in (_PAT, _PMT):
                table = table.copy()
                table[3] |= (i // RANDOM_ACCESS) & 15
                parts.append(table)
        lead = 8 if access else 0
        n = -(-(len(body) + lead) // 184)
        p = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        start = np.full(n, 4)
        start[0] += lead
        start[-1] += n * 184 - lead - len(body)
        has = np.flatnonzero(start > 4)
        p[has, 3] |= 0x20
        p[has, 4] = start[has] - 5
        p[has[start[has] > 5], 5] = 0
        if access:
            base = pts
            p[0, 5] = 0x50
            p[0, 6:12] = (base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0)
        p[_COLS >= start[:, None]] = np.frombuffer(body, dtype=np.uint8)
        parts.append(p.reshape(-1))
    return np.concatenate(parts).tobytes()


def _table(packets: np.ndarray, table_id: int) -> bytes | None:
    """The body of the first sound section of a table."""
    for p in packets:
        raw = p.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if at >= PACKET - 4 or not raw[1] & 0x40:
            continue
        at += 1 + raw[at]
        if at + 3 > PACKET or raw[at] != table_id:
            continue
        end = at + 3 + ((raw[at + 1] & 0x0F) << 8 | raw[at + 2])
        if end <= PACKET and end - at >= 12 and crc32_mpeg(raw[at : end - 4]) == int.from_bytes(raw[end - 4 : end], "big"):
            return raw[at + 8 : end - 4]
    return None


def demux(media: bytes) -> dict:
    """What a stream holds: ``units`` are (pts, random access, packet index, bytes)."""
    out = {"ok": False, "packets": 0, "pids": [], "cc_errors": 0, "units": [], "payload": b"", "program": 0, "stream_type": 0}
    if not media or len(media) % PACKET:
        return out
    a = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != 0x47).any():
        return out
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    control = a[:, 3] >> 4 & 3
    out |= {"packets": len(a), "pids": np.unique(pid).tolist()}
    # a packet may be sent a second time with the same counter; its copy is passed over
    twice = np.zeros(len(a), dtype=bool)
    for x in out["pids"]:
        at = np.flatnonzero((pid == x) & (control & 1 == 1))
        step = (np.diff((a[at, 3] & 15).astype(np.int16)) & 15) if len(at) > 1 else np.zeros(0, dtype=np.int16)
        same = np.flatnonzero(step == 0)
        same = same[(a[at[same]] == a[at[same + 1]]).all(axis=1)] if len(same) else same
        twice[at[same + 1]] = True
        at = at[~twice[at]]
        out["cc_errors"] += int(((np.diff((a[at, 3] & 15).astype(np.int16)) & 15) != 1).sum())
    pat = _table(a[pid == PAT_PID][:64], 0) or b""
    # program 0 names the network table, no program
    programs = [x for x in struct.iter_unpack(">HH", pat[: len(pat) // 4 * 4]) if x[0]]
    if not programs:
        return out
    program, at = programs[0]
    pmt = _table(a[pid == at & 0x1FFF][:64], 2) or b""
    skip = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    if len(pmt) < skip + 5:
        return out
    kind, stream = struct.unpack(">BH", pmt[skip : skip + 3])
    where = np.flatnonzero((pid == stream & 0x1FFF) & (control & 1 == 1) & ~twice)
    e, c = a[where], control[where]
    start = np.where(c & 2, 5 + e[:, 4].astype(np.int64), 4).clip(max=PACKET)
    access = (c & 2 > 0) & (e[:, 4] > 0) & (e[:, 5] & 0x40 > 0)
    data = e[_COLS >= start[:, None]].tobytes()
    offset = np.concatenate(([0], np.cumsum(PACKET - start)))
    first = np.flatnonzero(e[:, 1] & 0x40)
    ends = np.append(offset[first[1:]], len(data))
    bodies, torn = [], False
    for k, end in zip(first.tolist(), ends.tolist(), strict=True):
        unit = data[int(offset[k]) : end]
        if len(unit) < 14 or unit[:3] != b"\0\0\1":
            torn = True
            continue
        t = unit[9:14] if unit[7] & 0x80 else None
        pts = None if t is None else (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
        size = struct.unpack(">H", unit[4:6])[0]
        body = unit[9 + unit[8] : 6 + size if size else len(unit)]
        torn |= bool(size) and len(body) != 6 + size - 9 - unit[8]
        bodies.append(body)
        out["units"].append((pts, bool(access[k]), int(where[k]), len(body)))
    return out | {"ok": not torn and not out["cc_errors"], "payload": b"".join(bodies), "program": program, "stream_type": kind}


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = byte_column(b.column(1))
        for at, to in chunks(texts, 1 << 22):
            some = texts[at:to]
            yield pa.record_batch([b.column(0).slice(at, to - at), pa.array([len(t) for t in some], pa.int64()), pa.array([mux(padded(t)) for t in some], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ok boolean, cc_errors long, first_pts long, last_pts long, random_access_pts array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("ok", pa.bool_()), ("cc_errors", pa.int64()), ("first_pts", pa.int64()), ("last_pts", pa.int64()), ("random_access_pts", pa.list_(pa.int64()))])
    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows = []
            for key, n, media in zip(*[c.to_pylist() for c in b.slice(at, 256).columns], strict=True):
                if media is None:
                    rows.append([key, n] + [None] * 11)
                    continue
                x = demux(media)
                p, units = x["payload"], x["units"]
                pts = [u[0] for u in units if u[0] is not None]
                access = [u[0] for u in units if u[1]]
                feature = f"program={x['program']};type={x['stream_type']};pids={'/'.join(map(str, x['pids']))};packets={x['packets']};units={len(units)};access={len(access)};last_pts={pts[-1] if pts else -1};cc_errors={x['cc_errors']}"
                rows.append([key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["ok"], x["cc_errors"], pts[0] if pts else None, pts[-1] if pts else None, access])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def read_streams(media: DataFrame) -> DataFrame:
    """Features of each stored stream, read back from its bytes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), ("unit", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("n_bytes", pa.int64())])
    for b in batches:
        for key, media in zip(*[c.to_pylist() for c in b.columns], strict=True):
            units = demux(media or b"")["units"]
            yield pa.record_batch([pa.array([key] * len(units), pa.int64()), pa.array(range(len(units)), pa.int64()), *[pa.array([u[k] for u in units], kinds.field(k + 2).type) for k in range(4)]], schema=kinds)


def elementary_packets(media: DataFrame) -> DataFrame:
    """One row for each elementary packet: its timestamp, access flag, packet and size."""
    return media.select("doc_id", "media").mapInArrow(_units, "doc_id long, unit long, pts long, random_access boolean, packet long, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_streams(store_streams(spark.read.parquet(f"{sf_dir}/documents.parquet")))
