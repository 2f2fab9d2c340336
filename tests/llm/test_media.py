import hashlib
import random
import zlib

import pytest
from watchlake.llm import media as M

SIZES = [0, 1, 63, 64, 65, 128, 160, 161, 162, 176, 184, 346, 347, 348, 32768, 32769, 100_000, 700_000]


def walk(stream):
    """A plain reader: payload of the data PID, packet by packet."""
    units, now = [], None
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        pid = (p[1] & 31) << 8 | p[2]
        body = p[5 + p[4] :] if p[3] & 32 else p[4:]
        if pid == M.DATA_PID:
            if p[1] & 64:
                units.append(now := bytearray())
            now += body
    return b"".join(bytes(u[9 + u[8] : 6 + int.from_bytes(u[4:6], "big")]) for u in units)


@pytest.mark.parametrize("n", SIZES)
def test_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = M.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text) and not payload[n:].strip(b"\0")
    stream = M.write_stream(payload)
    assert stream == M.write_stream(payload) and len(stream) % 188 == 0 and walk(stream) == payload
    x = M.parse_stream(stream)
    assert b"".join(u["data"] for u in x["units"]) == payload
    (s,) = x["streams"]
    assert (s["pid"], s["stream_type"], s["cc_errors"], s["duplicates"], x["broken"]) == (M.DATA_PID, 6, 0, 0, 0)
    assert [u["pts"] for u in x["units"]] == [M.TICKS * k for k in range(len(x["units"]))] and all(u["random_access"] for u in x["units"])


def test_table_crc_known_value():
    assert M.section_crc(b"123456789") == 0x0376E6E7


def test_faults():
    payload = M.padded(bytes(range(256)) * 300)
    stream = M.write_stream(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    read = lambda ps: M.parse_stream(b"".join(ps))
    assert read(packets[:9] + packets[10:])["streams"][0]["cc_errors"] == 1
    twice = read(packets[:9] + packets[8:])
    assert twice["streams"][0]["duplicates"] == 1 and b"".join(u["data"] for u in twice["units"]) == payload
    broken = read([*packets[:5], b"\0" * 188, *packets[6:]])
    assert broken["broken"] == 1 and broken["streams"][0]["cc_errors"] == 1
    assert M.parse_stream(stream[:1000])["packets"] == 5
    assert b"".join(u["data"] for u in M.parse_stream(b"junk!" + stream)["units"]) == payload
    bad_crc = bytearray(stream)
    bad_crc[188 + 20] ^= 1  # in the program map
    assert M.parse_stream(bytes(bad_crc))["streams"] == []
    for junk in (None, b"", b"x", b"\x47" * 1000, random.Random(1).randbytes(5000)):
        assert M.parse_stream(junk)["units"] == []


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 40_000), (5, "é" * 40_000), (None, "x"), (3, "a" * 64)]
    df = spark.createDataFrame([(*r, 1, b"clash") for r in rows], "doc_id long, text string, n_bytes int, media binary")
    made = M.with_media(df, ["doc_id"])
    got = M.stream_index(made, ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(rows)
    for r, (d, text) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or "")))):
        want = M.padded((text or "").encode())
        assert (r["doc_id"], r["n_bytes"]) == (d, len((text or "").encode()))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert M.stream_index(M.with_media(df.limit(0), ["doc_id"]), ["doc_id"]).count() == 0
    null = M.stream_index(spark.createDataFrame([(1, None)], "doc_id long, media binary"), ["doc_id"]).first()
    assert null["packets"] == 0 == null["payload_bytes"]


def test_query_gives_equal_texts_equal_values(spark, sf_dir):
    from watchlake.llm import entry

    got = entry.QUERIES["op6_media"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().merge(got, on="doc_id")
    assert len(docs) == len(got) and docs.groupby("text")[["media_sha256", "feature"]].nunique().eq(1).all().all()
    assert all(hashlib.sha256(M.padded(t.encode())).hexdigest() == s for t, s in zip(docs["text"], docs["payload_sha256"]))
