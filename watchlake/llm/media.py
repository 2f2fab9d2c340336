"""Media columns: MPEG transport streams in a binary column.

``write_stream`` packs bytes into a transport stream (program tables, one private elementary stream, a random
access point with PTS and PCR for each access unit). ``parse_stream`` reads any transport stream of
188-byte packets: program tables with their CRC, continuity counters, packetised elementary units put together
again, time stamps and random access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, materialize, table

PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PMT_PID, DATA_PID = 0, 0x1000, 0x100
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 32768  # data of an access unit; a unit's 16-bit length holds up to 65,527
TICKS = 3600  # of the 90 kHz clock between access units
TABLES_EVERY = 8  # access units
FIRST_BODY = BODY - 8  # after an adaptation field with a PCR


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """The CRC of program tables: polynomial 04C11DB7, not reflected, no final xor. 0 over a section with its CRC."""
    c, tab = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ tab[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _table_packets() -> np.ndarray:
    """A program association and a program map packet, with continuity counter 0."""
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    rows = []
    for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)):
        packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
        rows.append(packet.ljust(PACKET, b"\xff"))
    return np.frombuffer(b"".join(rows), np.uint8).reshape(2, PACKET)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def write_stream(payload: bytes) -> bytes:
    """``payload`` as a transport stream; the same bytes give the same stream."""
    out, counter = [], 0
    for unit in range(max(1, -(-len(payload) // UNIT_BYTES))):
        data = payload[unit * UNIT_BYTES : (unit + 1) * UNIT_BYTES]
        if unit % TABLES_EVERY == 0:
            tables = _table_packets().copy()
            tables[:, 3] |= unit // TABLES_EVERY & 15
            out.append(tables.tobytes())
        pts = unit * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        n = 1 + max(0, -(-(len(pes) - FIRST_BODY) // BODY))
        p = np.full((n, PACKET), 255, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        p[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        body = np.frombuffer(pes, np.uint8)
        first = min(len(pes), FIRST_BODY)
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        p[0, 4] = 7 + FIRST_BODY - first
        p[0, 5] = 0x50  # random access, PCR
        p[0, 6:12] = np.frombuffer(((pts << 15) | 0x7E00).to_bytes(6, "big"), np.uint8)
        p[0, PACKET - first :] = body[:first]
        if n > 1:
            p[1:-1, 4:] = body[first : first + BODY * (n - 2)].reshape(-1, BODY)
            rest = body[first + BODY * (n - 2) :]
            if len(rest) < BODY:
                p[-1, 3] |= 0x20
                p[-1, 4] = BODY - 1 - len(rest)
                if len(rest) < BODY - 1:
                    p[-1, 5] = 0
            p[-1, PACKET - len(rest) :] = rest
        out.append(p.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, start: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    """Sections with a right CRC; of a PID's packets, whether a section starts in them, and where their payload is."""
    held = b""
    for row, first, off in zip(packets, start, at):
        body = row[off:].tobytes()
        if first and body:
            pointer = body[0]
            held += body[1 : 1 + pointer]
            todo = [held, body[1 + pointer :]]
        else:
            todo = [held + body]
        for data in todo:
            while len(data) >= 3 and data[0] != 0xFF:
                size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
                if len(data) < size:
                    break
                if size >= 12 and section_crc(data[:size]) == 0:
                    yield data[:size]
                data = data[size:]
            held = b"" if data[:1] == b"\xff" else data


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse_stream(media: bytes | None) -> dict:
    """What a transport stream holds; broken packets are counted and left out, a cut-off last packet too.

    ``programs``: (program, pmt_pid); ``streams``: a dict each with pid, stream_type, program, packets,
    cc_errors, duplicates; ``units``: a dict each with pid, pts, dts, random_access, packet, data.
    """
    raw = np.frombuffer(media or b"", np.uint8)
    starts = [i for i in range(min(PACKET, len(raw))) if (raw[i::PACKET][:4] == SYNC).all()]
    skip = starts[0] if starts else 0
    p = raw[skip : skip + (len(raw) - skip) // PACKET * PACKET].reshape(-1, PACKET)
    good = (p[:, 0] == SYNC) & (p[:, 1] < 128) if len(p) else np.zeros(0, bool)
    out = {"packets": len(p), "broken": int((~good).sum()), "programs": [], "streams": [], "units": []}
    place, p = np.flatnonzero(good), p[good]
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    first, has_field, has_body, counter = p[:, 1] & 64 > 0, p[:, 3] & 32 > 0, p[:, 3] & 16 > 0, p[:, 3].astype(np.int64) & 15
    at = np.where(has_field, 5 + p[:, 4].astype(np.int64), 4)
    has_body &= at < PACKET
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    body = lambda k: (p[sel := (pid == k) & has_body], first[sel], at[sel])
    seen: dict[int, int] = {}
    for s in _sections(*body(PAT_PID)):
        if s[0] == 0:
            seen |= {int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF: int.from_bytes(s[i : i + 2], "big") for i in range(8, len(s) - 4, 4)}
    out["programs"] = sorted((program, k) for k, program in seen.items() if program)
    kinds: dict[int, tuple[int, int]] = {}
    for program, k in out["programs"]:
        for s in _sections(*body(k)):
            if s[0] == 2:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while i + 5 <= len(s) - 4:
                    kinds[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = (s[i], program)
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    for k, (kind, program) in sorted(kinds.items()):
        mine = np.flatnonzero((pid == k) & has_body)
        step = np.diff(counter[mine]) % 16
        jump = flags[mine[1:]] & 128 > 0  # a discontinuity that the stream announces
        twice = np.zeros(len(mine), bool)
        twice[1:] = (step == 0) & (p[mine[1:]] == p[mine[:-1]]).all(axis=1) if len(mine) > 1 else False
        wrong = int(((step != 1) & ~jump & ~twice[1:]).sum())
        out["streams"].append({"pid": k, "stream_type": kind, "program": program, "packets": len(mine), "cc_errors": wrong, "duplicates": int(twice.sum())})
        mine = mine[~twice]
        if not len(mine):
            continue
        sizes = PACKET - at[mine]
        data = p[mine][np.arange(PACKET)[None, :] >= at[mine][:, None]].tobytes()
        ends = np.cumsum(sizes)
        heads = np.flatnonzero(first[mine])
        cuts = [*(ends - sizes)[heads].tolist(), len(data)]
        for h, a, b in zip(heads.tolist(), cuts, cuts[1:]):
            pes = data[a:b]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            length = int.from_bytes(pes[4:6], "big")
            pes = pes[: 6 + length] if length else pes
            has = pes[7] >> 6
            pts = _time(pes[9:14]) if has & 2 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if has == 3 and len(pes) >= 19 else pts
            rap = bool(flags[mine[h]] & 64)
            out["units"].append({"pid": k, "pts": pts, "dts": dts, "random_access": rap, "packet": int(place[mine[h]]) , "data": pes[9 + pes[8] :]})
    return out


def padded(text: bytes | None) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    raw = text or b""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def with_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_bytes (of the text) and media, the padded text as a transport stream.

    A null or empty text is a payload of 64 bytes 0; texts of any length are stored whole. Equal texts have equal streams, repeated
    rows stay repeated, and an empty table stays empty. Of the kept columns none may be called n_bytes or media.
    """
    body = free_name([*keep, "n_bytes", "media"], "body")
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(b.num_columns - 1).to_pylist()
                cols = [b.column(i) for i in range(b.num_columns - 1)]
                n, media = [len(x or b"") for x in texts], [write_stream(padded(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return docs.select(*keep, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


INDEX = (
    "packets long, broken long, programs array<struct<program int, pmt_pid int>>, "
    "streams array<struct<pid int, stream_type int, program int, packets long, cc_errors long, duplicates long>>, "
    "units array<struct<pid int, pts long, dts long, random_access boolean, packet long, n_bytes long>>"
)


def stream_index(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The kept columns, what the stream in ``media`` holds, and digests of its bytes and its units' data.

    Null and empty streams have no packets, and the digests of no bytes. Broken ones are read as far as they go, and
    streams of any length whole. Repeated rows stay repeated, an empty table stays empty, and other columns may have any
    names; those that are kept should differ from the new ones.
    Added columns: those of ``INDEX``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256.
    """
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    schema = df.select(*keep).schema
    for part in (INDEX, more):
        for f in df.sparkSession.createDataFrame([], part).schema:
            schema = schema.add(f)
    added = [f.name for f in schema][len(keep) :]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    body = free_name([*keep, *added], "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for raw in b.column(b.num_columns - 1).to_pylist():
                    raw = raw or b""
                    x = parse_stream(raw)
                    data = b"".join(u["data"] for u in x["units"])
                    x["programs"] = [{"program": a, "pmt_pid": k} for a, k in x["programs"]]
                    x["units"] = [{k: v for k, v in u.items() if k != "data"} | {"n_bytes": len(u["data"])} for u in x["units"]]
                    x |= {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:])}
                    rows.append(x | {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()})
                cols = [b.column(i) for i in range(b.num_columns - 1)]
                cols += [pa.array([r[c] for r in rows], arrow.field(c).type) for c in added]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return df.select(*keep, F.col(media).cast("binary").alias(body)).mapInArrow(run, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document, read back from its stored stream; nulls, repeats, long texts and empty tables as in ``with_media``."""
    stored = materialize(with_media(table(spark, sf_dir, "documents"), ["doc_id"]), "media")
    x = stream_index(stored, ["doc_id", "n_bytes"])
    total = lambda field: F.aggregate("streams", F.lit(0).cast("long"), lambda a, s: a + s[field])
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    kinds = F.array_join(F.transform("streams", lambda s: F.concat(F.lower(F.hex(s["pid"])), F.lit(":"), F.lower(F.hex(s["stream_type"])))), ",")
    feature = F.format_string(
        "packets=%d;broken=%d;programs=%d;streams=%s;cc_errors=%d;duplicates=%d;units=%d;random_access=%d;pts=%d-%d",
        "packets", "broken", F.size("programs"), kinds, total("cc_errors"), total("duplicates"), F.size("units"), points,
        F.coalesce(F.array_min(F.transform("units", lambda u: u["pts"])), F.lit(-1).cast("long")),
        F.coalesce(F.array_max(F.transform("units", lambda u: u["pts"])), F.lit(-1).cast("long")),
    )
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
