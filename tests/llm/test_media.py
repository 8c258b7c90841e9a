import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import media as V

from .conftest import ODD


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(data):
    made = V.container(data)
    track = V.tracks(made)[0]
    chunks, keys, n = V.layout(track, len(made))
    assert n == track["sizes"][1]
    assert V.payload_of(made, chunks) == V.padded(data)
    assert len(V.padded(data)) % 64 == 0 and len(V.padded(data)) >= 64
    assert track["sizes"] == (64, len(V.padded(data)) // 64) and track["time"] == (V.RATE, len(V.padded(data)))
    start = chunks[0][0]
    assert keys == [(start + 64 * i, 64) for i in range(0, track["sizes"][1], V.KEY_EVERY)]


def test_foreign_sample_tables():
    """Sizes of their own, two runs of chunks, wide offsets and sizes, a box that reaches to the end."""
    track = {"codec": "abcd", "time": (1000, 5), "sizes": ((3, 5, 7, 11, 13), 5), "chunks": (100, 200, 300), "runs": [(1, 2, 1), (3, 1, 1)], "sync": (2, 5), "fragments": []}
    assert V.layout(track, 400) == ([(100, 8), (200, 18), (300, 13)], [(103, 5), (300, 13)], 5)
    del track["sync"]
    assert [n for _, n in V.layout(track, 400)[1]] == [3, 5, 7, 11, 13]
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert [(k, b - a) for k, _, a, b in V.boxes(memoryview(wide))] == [(b"free", 4), (b"mdat", 4)]


@pytest.mark.parametrize("bad", [b"", b"abc", struct.pack(">I4s", 400, b"moov"), struct.pack(">I4s", 4, b"moov"), V.container(b"x" * 100)[:300]])
def test_broken_containers_have_an_error(spark, bad):
    df = spark.createDataFrame([(1, bytearray(bad))], "id long, media binary")
    row = V.probe(df).first()
    assert row["error"] and row["codec"] is None


def test_probe_reads_no_payload():
    made = bytearray(V.container(b"hello" * 100))
    at = V.layout(V.tracks(bytes(made))[0], len(made))[0][0][0]
    zeroed = bytes(made[:at]) + bytes(len(made) - at)
    assert V.layout(V.tracks(zeroed)[0], len(made)) == V.layout(V.tracks(bytes(made))[0], len(made))


def nested(depth):
    out = b""
    for _ in range(depth):
        out = V._box(b"moov", out)
    return out


def claims(samples, size=1):
    """A small file whose table of sizes claims many samples."""
    table = V._box(b"stbl", V._full(b"stsd", struct.pack(">I", 1), V._box(b"raw ", bytes(28))), V._full(b"stsz", struct.pack(">II", size, samples)), V._full(b"stsc", struct.pack(">IIII", 1, 1, samples, 1)), V._full(b"stco", struct.pack(">II", 1, 0)))
    return V._box(b"moov", V._box(b"trak", V._box(b"mdia", V._full(b"mdhd", struct.pack(">IIII", 0, 0, 8000, 5)), V._box(b"minf", table))))


HOSTILE = [nested(5000), nested(17), claims(3_000_000), claims(2**32 - 1), claims(2**32 - 1, 0), claims(50, 5), V._box(b"moov", V._box(b"trak", V._box(b"stbl", V._full(b"stco", struct.pack(">I", 2**32 - 1)))))]


def test_hostile_files_are_error_rows(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(HOSTILE)], "id long, media binary")
    assert all(r["error"] and r["keyframes"] is None for r in V.probe(df).collect())


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400), st.binary(max_size=6))
def test_damaged_files_never_raise_anything_else(data, at, noise):
    made = V.container(data)
    at = at % len(made)
    damaged = made[:at] + noise + made[at + len(noise) :]
    try:
        for track in V.tracks(damaged):
            V.layout(track, len(damaged))
    except (ValueError, KeyError, IndexError, OverflowError, struct.error):
        pass


def fragmented():
    """A file of one empty movie box and two fragments, with sizes and flags of their own in the first and defaults in the second."""
    empty = V._box(b"stbl", V._full(b"stsd", struct.pack(">I", 1), V._box(b"avc1", bytes(28))), V._full(b"stsz", struct.pack(">II", 0, 0)), V._full(b"stsc", struct.pack(">I", 0)), V._full(b"stco", struct.pack(">I", 0)))
    track = V._box(b"trak", V._full(b"tkhd", struct.pack(">III", 0, 0, 9)), V._box(b"mdia", V._full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)), V._box(b"minf", empty)))
    movie = V._box(b"moov", track, V._box(b"mvex", V._full(b"trex", struct.pack(">5I", 9, 1, 40, 6, 0x10000))))
    head = V._box(b"ftyp", b"iso6", bytes(4)) + movie
    out = head
    for own in (True, False):
        def moof(offset):
            if own:
                run = V._full(b"trun", struct.pack(">Ii", 3, offset), struct.pack(">9I", 10, 4, 0, 20, 5, 0x10000, 30, 6, 0), flags=0x701)
            else:
                run = V._full(b"trun", struct.pack(">IiI", 2, offset, 0), flags=0x5)
            return V._box(b"moof", V._box(b"traf", V._full(b"tfhd", struct.pack(">I", 9)), run))
        size = len(moof(0))
        out += moof(size + 8) + V._box(b"mdat", b"x" * (15 if own else 12))
    return out


def test_fragments(spark):
    made = fragmented()
    row = V.probe(spark.createDataFrame([(1, bytearray(made))], "id long, media binary")).first()
    first, second = made.find(b"x" * 12), made.rfind(b"mdat") + 4
    assert row["error"] is None and (row["codec"], row["timescale"], row["duration"], row["n_samples"], row["n_tracks"]) == ("avc1", 1000, 60 + 80, 5, 1)
    assert [tuple(c) for c in row["chunks"]] == [(first, 15), (second, 12)]
    assert [tuple(k) for k in row["keyframes"]] == [(first, 4), (first + 9, 6), (second, 6)]


def test_compact_sizes():
    box = lambda bits, n, raw: memoryview(bytes(4) + struct.pack(">II", bits, n) + raw)
    assert V._sizes(box(4, 3, b"\x12\x30"), 0, 14, True) == ((1, 2, 3), 3)
    assert V._sizes(box(8, 2, b"\x07\x09"), 0, 14, True) == ((7, 9), 2) and V._sizes(box(16, 1, b"\x01\x02"), 0, 14, True) == ((258,), 1)
    with pytest.raises(ValueError):
        V._sizes(box(16, 9, b"\x01\x02"), 0, 14, True)


def test_query(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(V, "documents", lambda *a: odd.select("doc_id", "text"))
    got = V.op8_media_columns(spark, "").collect()
    want = []
    for d, t, *_ in ODD:
        p = V.padded((t or "").encode())
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by_text = {(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}
    assert len(by_text) == len({w[3] for w in want})
    monkeypatch.setattr(V, "documents", lambda *a: empty.select("doc_id", "text"))
    assert V.op8_media_columns(spark, "").count() == 0


def test_clash_and_null(spark, clash):
    out = V.probe(V.encode(clash))
    assert out.columns.count("media") == 1 and out.where("error IS NOT NULL").count() == 0
    assert V.probe(spark.createDataFrame([(None,)], "media binary")).first()["error"] == "null"
