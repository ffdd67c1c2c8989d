"""MPEG transport streams as a binary column.

``write_streams`` stores payloads as single-program transport streams, ``read_streams`` parses any
binary column of 188-byte packets: program association and map tables (sections that cross packets and
several sections in one packet as well), continuity counters, and for every elementary stream its
reassembled packets with presentation and decoding times and random-access points. Both are per-row
maps, so a plan with them has no shuffle, and a lost executor costs its own tasks only.

Cases: a null payload is stored as an empty one; a null, empty or truncated stream gives a row with
zero packets or with the bytes left over counted in ``bad_bytes``; packets without the sync byte are
counted in ``bad_bytes`` and skipped; a packet that repeats the counter and the bytes before it is a
duplicate and is ignored, any other jump that isn't announced is a continuity error. A unit that lost
packets, or has fewer bytes than it says, is listed as damaged and has the bytes that came; a section
with lost packets or a wrong checksum is left out. Repeated rows are separate rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import per_slice, text_of

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, PRIVATE_DATA, PRIVATE_STREAM_1 = 188, 0x47, 0x0000, 0x06, 0xBD

#: What this writer puts into its tables, and the pace of its units: 25 a second on a 90 kHz clock.
PMT_PID, ES_PID, PROGRAM, TICKS = 0x1000, 0x0100, 1, 3600
UNIT_BYTES, UNITS_PER_RAP = 16384, 4


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def psi_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ext >> 8, ext & 255, 0xC1, 0, 0])
    return head + body + psi_crc(head + body).to_bytes(4, "big")


def _psi_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    stream = bytes([PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])
    pmt = _section(0x02, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]) + stream)
    return _psi_packet(PAT_PID, pat) + _psi_packet(PMT_PID, pmt)


_TABLES = _tables()


def _pts(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _unit(data: bytes, number: int, counter: int) -> np.ndarray:
    """Packets of one elementary packet; its last one is stuffed through the adaptation field."""
    length = len(data) + 8
    pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1, length >> 8, length & 255, 0x84, 0x80, 5]) + _pts(number * TICKS) + data
    field = bytes([7, 0x10 | 0x40 * (number % UNITS_PER_RAP == 0)]) + (number * TICKS << 15 | 0x7E00).to_bytes(6, "big")
    first = PACKET - 4 - len(field)
    rest = len(pes) - first
    n = 1 + max(0, -(-rest // 184))
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    if rest < 0:  # one packet: its adaptation field grows
        field = bytes([field[0] - rest]) + field[1:] + b"\xff" * -rest
        out[0, 4:] = np.frombuffer(field + pes, np.uint8)
        return out
    out[0, 4:] = np.frombuffer(field + pes[:first], np.uint8)
    body = np.frombuffer(pes, np.uint8)[first:]
    full, left = divmod(rest, 184)
    out[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
    if left:
        pad = 184 - left
        last = out[n - 1]
        last[3] |= 0x20
        last[4] = pad - 1
        if pad > 1:
            last[5] = 0
            last[6 : 4 + pad] = 0xFF
        last[4 + pad :] = body[full * 184 :]
    return out


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries the payload in units of ``UNIT_BYTES``."""
    parts, counter = [_TABLES], 0
    for number, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        packets = _unit(payload[at : at + UNIT_BYTES], number, counter)
        counter = (counter + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


def _steps(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For packets of one pid that carry a payload: which repeat the one before, and before which some were lost."""
    n = len(packets)
    repeats, lost = np.zeros(n, bool), np.zeros(n, bool)
    step = np.diff(packets[:, 3] & 15) & 15
    for j in np.flatnonzero(step != 1) + 1:
        repeats[j] = step[j - 1] == 0 and (packets[j] == packets[j - 1]).all()
        announced = packets[j, 3] & 0x20 and packets[j, 4] and packets[j, 5] & 0x80
        lost[j] = not repeats[j] and not announced
    return repeats, lost


def _sections(packets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """All sections of one table pid, put together from their packets; those with lost packets or a wrong checksum are left out."""
    out: list[bytes] = []
    held: bytearray | None = None  # None: no section is open
    repeats, lost = _steps(packets)

    def close() -> None:
        nonlocal held
        while held and held[0] != 0xFF and len(held) >= 3:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                return
            section = bytes(held[:size])
            if size >= 12 and psi_crc(section) == 0:
                out.append(section)
            del held[:size]
        if held and held[0] == 0xFF:
            held = None

    for row, at, again, gap in zip(packets, starts, repeats, lost, strict=True):
        if again:
            continue
        raw = row[at:].tobytes()
        if gap:
            held = None
        if row[1] & 0x40:
            skip = raw[0] if raw else 0
            if held is not None:  # what stands before the pointer ends the open section
                held += raw[1 : 1 + skip]
                close()
            held = bytearray(raw[1 + skip :])
        elif held is not None:
            held += raw
        close()
    return out


def _stamp(p: bytes) -> int:
    return (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1


def _elementary(packets: np.ndarray, starts: np.ndarray) -> dict:
    """Units of one elementary pid: times, random access, damage, and their bytes."""
    repeats, lost = _steps(packets)
    rows, at, lost = packets[~repeats], starts[~repeats], lost[~repeats]
    found: dict = {"cc_errors": int(lost.sum()), "cc_repeats": int(repeats.sum()), "n_units": 0, "pts": [], "dts": [], "random_access": [], "damaged": [], "payload": b""}
    begins = np.flatnonzero(rows[:, 1] & 0x40)
    if not len(begins):
        return found
    body = rows[np.arange(PACKET)[None, :] >= at[:, None]].tobytes()
    offsets = np.append(0, np.cumsum(PACKET - at))
    # packets lost before one that begins a unit are of the unit before
    broken = set(np.searchsorted(begins, np.flatnonzero(lost) - 1, "right") - 1)
    out = []
    for i, (b, e) in enumerate(zip(begins, np.append(begins[1:], len(rows)), strict=True)):
        unit = body[offsets[b] : offsets[e]]
        if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
            continue
        size = unit[4] << 8 | unit[5]
        if i in broken or (size and len(unit) < 6 + size):
            found["damaged"].append(found["n_units"])
        out.append(unit[9 + unit[8] : 6 + size if size else len(unit)])
        found["pts"].append(_stamp(unit[9:14]) if unit[7] & 0x80 and len(unit) >= 14 else None)
        found["dts"].append(_stamp(unit[14:19]) if unit[7] & 0xC0 == 0xC0 and len(unit) >= 19 else None)
        if rows[b, 3] & 0x20 and rows[b, 4] and rows[b, 5] & 0x40:
            found["random_access"].append(found["n_units"])
        found["n_units"] += 1
    found["payload"] = b"".join(out)
    return found


def read_stream(stream: bytes) -> dict:
    """What a stream holds: packets, programs, and ``streams``, one entry for each elementary pid in order.

    The totals, and times, access points, damage and payload of the first elementary pid, stand at the top as well.
    """
    found: dict = {"n_packets": 0, "bad_bytes": 0, "programs": [], "streams": []}
    data = np.frombuffer(stream or b"", np.uint8)
    n = len(data) // PACKET
    packets = data[: n * PACKET].reshape(n, PACKET)
    good = packets[:, 0] == SYNC
    found["n_packets"] = int(good.sum())
    found["bad_bytes"] = len(data) - found["n_packets"] * PACKET
    packets = packets if good.all() else packets[good]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + packets[:, 4].astype(np.int32), 4)
    start[control & 1 == 0] = PACKET
    start = np.minimum(start, PACKET)

    def carried(where: int) -> np.ndarray:
        return (pid == where) & (start < PACKET)

    maps: dict[int, int] = {}
    own = carried(PAT_PID)
    for s in _sections(packets[own], start[own]):
        if s[0] == 0x00:
            for at in range(8, len(s) - 4, 4):
                program, where = s[at] << 8 | s[at + 1], (s[at + 2] & 31) << 8 | s[at + 3]
                if program:
                    maps[where] = program
    kinds: dict[int, int] = {}
    for where in sorted(maps):
        own, streams = carried(where), {}
        for s in _sections(packets[own], start[own]):
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while s[0] == 0x02 and at + 5 <= len(s) - 4:
                streams[(s[at + 1] & 31) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
        kinds = streams | kinds
        found["programs"].append((maps[where], where, sorted(streams.items())))
    for es in sorted(kinds):
        own = carried(es)
        found["streams"].append({"pid": es, "kind": kinds[es]} | _elementary(packets[own], start[own]))
    for c in ("cc_errors", "cc_repeats", "n_units"):
        found[c] = sum(x[c] for x in found["streams"])
    first = found["streams"][0] if found["streams"] else {"pts": [], "dts": [], "random_access": [], "damaged": [], "payload": b""}
    return found | {c: first[c] for c in ("pts", "dts", "random_access", "damaged", "payload")}


def padded(data: bytes) -> bytes:
    """The bytes, followed by zeros up to a positive multiple of 64."""
    return data + b"\x00" * (64 - len(data) if not data else -len(data) % 64)


def write_streams(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each whole text as a transport stream."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.encode() for x in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([write_stream(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return text_of(docs).mapInArrow(per_slice(work), "doc_id long, n_bytes long, media binary")


#: Columns of ``read_streams`` besides those it keeps; ``streams`` has one entry for each elementary pid.
STREAM = "pid int, kind int, cc_errors long, cc_repeats long, n_units long, pts array<long>, dts array<long>, random_access array<int>, damaged array<int>, payload binary"
STREAM_FIELDS = f"n_packets long, bad_bytes long, programs string, streams array<struct<{STREAM.replace(' ', ':').replace(',:', ',')}>>"


def read_streams(media: DataFrame) -> DataFrame:
    """Parse the column ``media`` of each row; ``doc_id`` and ``n_bytes`` are kept."""
    of = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    entry = pa.struct([(name, of[kind]) for name, kind in (c.split() for c in STREAM.split(", "))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [read_stream(x) for x in batch["media"].to_pylist()]
        columns = [pa.array([r["n_packets"] for r in rows], pa.int64()), pa.array([r["bad_bytes"] for r in rows], pa.int64()), pa.array([_programs(r) for r in rows]), pa.array([r["streams"] for r in rows], pa.list_(entry))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], batch["media"], *columns], ["doc_id", "n_bytes", "media", "n_packets", "bad_bytes", "programs", "streams"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(per_slice(work), f"doc_id long, n_bytes long, media binary, {STREAM_FIELDS}")


def stream_digests(media: DataFrame) -> DataFrame:
    """Digest columns of each stored stream, from what ``read_stream`` gives back."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "cc_errors", "n_units", "last_pts", "n_random_access")}
        for raw in batch["media"].to_pylist():
            r = read_stream(raw)
            payload = r["payload"]
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(r), r["n_packets"], r["cc_errors"], r["n_units"], max((t for t in r["pts"] if t is not None), default=None), len(r["random_access"]))
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        strings = {"payload_sha256", "media_sha256", "feature"}
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(v, pa.string() if c in strings else pa.int64()) for c, v in out.items())], ["doc_id", "n_bytes", *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(per_slice(work), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, cc_errors long, n_units long, last_pts long, n_random_access long")


def _programs(found: dict) -> str:
    """``program@pid:stream/kind,...`` of each program."""
    return ";".join(f"{p}@{where}:" + ",".join(f"{es}/{kind}" for es, kind in streams) for p, where, streams in found["programs"])


def feature(found: dict) -> str:
    """A line of what was found: programs, packets, units, errors, damage, times and random-access points."""
    times = [t for t in found["pts"] if t is not None]
    steps = sorted({b - a for a, b in zip(times, times[1:], strict=False)})
    return f"programs={_programs(found)} packets={found['n_packets']} units={found['n_units']} errors={found['cc_errors']} repeats={found['cc_repeats']} bad={found['bad_bytes']} damaged={','.join(map(str, found['damaged']))} pts={times[0] if times else ''}..{times[-1] if times else ''} steps={','.join(map(str, steps))} access={','.join(map(str, found['random_access']))}"


def digest_table(docs: DataFrame) -> DataFrame:
    """Store every whole text as a transport stream, read it back and digest it."""
    return stream_digests(write_streams(docs))
