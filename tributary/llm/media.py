"""Media columns: ISO base media containers (boxes and sample tables) in binary columns.

``encode`` wraps each row's bytes as a one-track container of 64-byte frames of raw 8-bit samples; ``probe`` walks the boxes
of any container of this family, decodes the sample tables (sizes, chunks, times, sync samples) and stores codec, duration and the byte
range of every key frame. ``probe`` never touches the payload itself: all it reads are box headers and tables. Both run in
Arrow batches on the executors, without a shuffle, so memory is bounded by one batch and any row can be redone alone.

``probe`` knows plain and fragmented files (moof, traf, trun), compact sizes (stz2), and any number of tracks, of which it reports the first and their number. Boxes are walked with a stack of
bounded depth, and every table is checked against its box and the file before it is read, so what a row takes in memory is bounded by its own length.

Cases: a null value is the empty payload in ``encode`` (one frame of zeros); a null, truncated or foreign value gives a row with
``error`` set and null features in ``probe``, whatever is wrong with it; a very long value is one container, of 64-bit boxes where needed; there are no ties. Repeated rows give repeated equal results. Empty tables stay empty. Columns of the
input that have an output's name are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents

FRAME, KEY_EVERY, FRAMES_PER_CHUNK, RATE = 64, 16, 64, 8000
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
DEPTH = 16
RANGE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
PROBED = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("timescale", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_keyframes", T.LongType()),
        T.StructField("keyframes", T.ArrayType(RANGE)),
        T.StructField("chunks", T.ArrayType(RANGE)),
        T.StructField("n_tracks", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """data and as many bytes 0 as make its length a positive multiple of unit."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _moov(frames: int, first: int) -> bytes:
    """The movie box of a track of equal frames whose first byte is at file offset first."""
    chunks = -(-frames // FRAMES_PER_CHUNK)
    step, time = FRAME * FRAMES_PER_CHUNK, frames * FRAME
    wide = first + frames * FRAME >= 1 << 32
    at = range(first, first + chunks * step, step)
    offsets = _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *at)) if wide else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *at))
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    keys = range(1, frames + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        offsets,
    )
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    time &= 0xFFFFFFFF
    header = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, time, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    track = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, time, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
    media = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, time, 0x55C4, 0))
    handler = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"frames\0")
    data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    return _box(b"moov", header, _box(b"trak", track, _box(b"mdia", media, handler, _box(b"minf", _full(b"smhd", bytes(4)), data, table))))


def container(data: bytes) -> bytes:
    """A container that holds data, padded to whole frames, without loss."""
    payload = padded(data)
    frames = len(payload) // FRAME
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")
    media_head = 8 if len(payload) + 8 < 1 << 32 else 16
    moov = _moov(frames, 0)
    moov = _moov(frames, len(head) + len(moov) + media_head)
    if len(moov) != len(_moov(frames, len(head) + len(moov) + media_head)):  # offsets became wide
        moov = _moov(frames, len(head) + len(moov) + media_head)
    return head + moov + _box(b"mdat", payload)


def boxes(data: memoryview) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, box start, body start, body end) of every box, containers before what they hold. Raises ValueError where a box leaves its parent or is nested too deep."""
    stack = [(0, len(data))]
    while stack:
        at, end = stack.pop()
        if at >= end:
            continue
        if end - at < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, at, body, stop
        stack.append((stop, end))
        if kind in CONTAINERS:
            if len(stack) > DEPTH:
                raise ValueError("boxes nested too deep")
            stack.append((body, stop))


def _numbers(view: memoryview, at: int, end: int, count: int, kind: str) -> tuple:
    """count numbers of a table that must fit in its box."""
    if count * struct.calcsize(kind) > end - at:
        raise ValueError("table leaves its box")
    return struct.unpack_from(f">{count}{kind}", view, at)


def _listed(view: memoryview, a: int, b: int, kind: str) -> tuple:
    """The numbers of a table that begins with their count."""
    (n,) = struct.unpack_from(">I", view, a + 4)
    return _numbers(view, a + 8, b, n, kind)


def _sizes(view: memoryview, a: int, b: int, compact: bool) -> tuple[int | tuple, int]:
    """(one size or all of them, how many) of stsz or stz2."""
    size, n = struct.unpack_from(">II", view, a + 4)
    if not compact:
        if size and size * n > len(view):
            raise ValueError("samples beyond the end")
        return (size, n) if size else (_numbers(view, a + 12, b, n, "I"), n)
    bits = size & 0xFF
    if bits == 4:
        pairs = _numbers(view, a + 12, b, -(-n // 2), "B")
        return tuple(x for p in pairs for x in (p >> 4, p & 15))[:n], n
    if bits not in (8, 16):
        raise ValueError("unknown width of sizes")
    return _numbers(view, a + 12, b, n, "B" if bits == 8 else "H"), n


def _run(view: memoryview, a: int, b: int, traf: dict, defaults: tuple[int, int, int]) -> dict:
    """A run of fragment samples: byte range, sizes, durations' sum and which samples are key frames. defaults: duration, size, flags."""
    flags, n = struct.unpack_from(">II", view, a)
    flags &= 0xFFFFFF
    at = a + 8
    offset = first = None
    if flags & 1:
        (offset,) = struct.unpack_from(">i", view, at)
        at += 4
    if flags & 4:
        (first,) = struct.unpack_from(">I", view, at)
        at += 4
    fields = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
    if sum(fields):
        rows = _numbers(view, at, b, n * sum(fields), "I")
    else:
        rows = ()
        if n * max(1, defaults[1]) > len(view):
            raise ValueError("samples beyond the end")
    column = lambda i: rows[sum(fields[:i]) :: sum(fields)] if fields[i] else None
    durations, sizes, marks = column(0), column(1), column(2)
    sizes = sizes or (defaults[1],) * n
    marks = list(marks or (defaults[2],) * n)
    if first is not None and n and not fields[2]:
        marks[0] = first
    begin = traf["base"] + offset if offset is not None else traf["next"]
    total = sum(sizes)
    if begin < 0 or begin + total > len(view):
        raise ValueError("chunk beyond the end")
    traf["next"] = begin + total
    keys, place = [], begin
    for size, mark in zip(sizes, marks):
        if not mark & 0x10000:
            keys.append((place, size))
        place += size
    return {"range": (begin, total), "n": n, "keys": keys, "duration": sum(durations) if durations else n * defaults[0]}


def tracks(data: bytes) -> list[dict]:
    """Decoded sample tables of each track, and the runs of its fragments."""
    view, found = memoryview(data), []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof = traf = None
    for kind, start, a, b in boxes(view):
        now = found[-1] if found else None
        if kind == b"trak":
            found.append({"fragments": []})
        elif kind == b"trex":
            who, _, *rest = struct.unpack_from(">5I", view, a + 4)
            defaults[who] = tuple(rest)
        elif kind == b"moof":
            moof = start
        elif kind == b"traf":
            traf = {"base": moof if moof is not None else start, "next": moof if moof is not None else start, "track": None}
        elif kind == b"tfhd" and traf is not None:
            flags, who = struct.unpack_from(">II", view, a)
            at = a + 8
            own = list(defaults.get(who, (0, 0, 0)))
            if flags & 1:
                (traf["base"],) = struct.unpack_from(">Q", view, at)
                traf["next"] = traf["base"]
                at += 8
            at += 4 * bool(flags & 2)
            for i, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    (own[i],) = struct.unpack_from(">I", view, at)
                    at += 4
            traf |= {"track": next((t for t in found if t.get("id") == who), None), "defaults": tuple(own)}
        elif kind == b"trun" and traf is not None and traf["track"] is not None:
            traf["track"]["fragments"].append(_run(view, a, b, traf, traf["defaults"]))
        elif now is None:
            continue
        elif kind == b"tkhd":
            (now["id"],) = struct.unpack_from(">I", view, a + (20 if view[a] else 12))
        elif kind == b"mdhd":
            now["time"] = struct.unpack_from(">IQ" if view[a] else ">II", view, a + (20 if view[a] else 12))
        elif kind == b"stsd":
            now["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind in (b"stsz", b"stz2"):
            now["sizes"] = _sizes(view, a, b, kind == b"stz2")
        elif kind in (b"stco", b"co64"):
            now["chunks"] = _listed(view, a, b, "I" if kind == b"stco" else "Q")
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", view, a + 4)
            flat = _numbers(view, a + 8, b, 3 * n, "I")
            now["runs"] = [flat[i : i + 3] for i in range(0, 3 * n, 3)]
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", view, a + 4)
            flat = _numbers(view, a + 8, b, 2 * n, "I")
            now["ticks"] = sum(flat[i] * flat[i + 1] for i in range(0, 2 * n, 2))
        elif kind == b"stss":
            now["sync"] = _listed(view, a, b, "I")
    return found


def layout(track: dict, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Byte ranges of the chunks and of the key frames of a track in a file of end bytes, and its number of samples."""
    sizes, n = track["sizes"]
    chunks, runs = track["chunks"], track["runs"]
    wanted = iter(track["sync"] if "sync" in track else range(1, n + 1))
    key = next(wanted, None)
    ranges, keys, sample = [], [], 0
    for r, (first, per, _) in enumerate(runs):
        until = runs[r + 1][0] - 1 if r + 1 < len(runs) else len(chunks)
        if first < 1 or until > len(chunks) or until < first - 1:
            raise ValueError("runs of chunks out of order")
        for c in range(first - 1, until):
            at, count = chunks[c], min(per, n - sample)
            total = sizes * count if isinstance(sizes, int) else sum(sizes[sample : sample + count])
            if at + total > end:
                raise ValueError("chunk beyond the end")
            if isinstance(sizes, int):
                while key is not None and key <= sample + count:
                    keys.append((at + sizes * (key - 1 - sample), sizes))
                    key = next(wanted, None)
            else:
                place = at
                for s in range(sample, sample + count):
                    if key == s + 1:
                        keys.append((place, sizes[s]))
                        key = next(wanted, None)
                    place += sizes[s]
            ranges.append((at, total))
            sample += count
    if sample < n:
        raise ValueError("samples outside all chunks")
    for run in track["fragments"]:
        ranges.append(run["range"])
        keys += run["keys"]
        n += run["n"]
    return ranges, keys, n


def payload_of(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The stored payload, read back through the chunk ranges."""
    return b"".join(data[a : a + n] for a, n in ranges)


def _with(df: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in keep], T.StructType([*keep, *fields])


def encode(df: DataFrame, column: str = "text", out: str = "media") -> DataFrame:
    """df and a binary column with a container of each value of column (string as UTF-8, or binary)."""
    kept, schema = _with(df, [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            made = pa.array([container(v.as_py() or b"") for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), made], names=[*kept, out])

    return df.mapInArrow(run, schema)


def probe(df: DataFrame, column: str = "media") -> DataFrame:
    """df and codec, timescale, duration, sample and key frame counts, and byte ranges of key frames and chunks of the first track."""
    kept, schema = _with(df, list(PROBED.fields))
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8 + ("null",)
        try:
            found = tracks(data)
            if not found:
                raise ValueError("no track")
            track = found[0]
            chunks, keys, samples = layout(track, len(data))
            scale, duration = track["time"]
            duration = duration or track.get("ticks", 0) + sum(r["duration"] for r in track["fragments"])
            if duration >= 1 << 63:
                raise ValueError("duration out of range")
            pairs = [[{"offset": a, "length": n} for a, n in x] for x in (keys, chunks)]
            return (track["codec"], scale, duration, samples, len(keys), *pairs, len(found), None)
        except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
            return (None,) * 8 + (f"{type(e).__name__}: {e}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, kind, pa.int64(), pa.string()]
        for batch in batches:
            rows = [one(v.as_py()) for v in batch.column(batch.schema.get_field_index(column))]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a container, probed, read back and digested."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                doc, n, media, codec, scale, duration, samples, n_keys, keys, chunks = (batch.column(i)[r].as_py() for i in range(10))
                payload = payload_of(media, [(c["offset"], c["length"]) for c in chunks])
                key_bytes = hashlib.sha256(b"".join(struct.pack(">QQ", k["offset"], k["length"]) for k in keys)).hexdigest()[:16]
                feature = f"codec={codec.strip()};duration={duration}/{scale};samples={samples};chunks={len(chunks)};keyframes={n_keys};ranges={key_bytes}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    docs = documents(spark, sf_dir, "doc_id", "text").selectExpr("doc_id", "coalesce(octet_length(text), 0L) AS n_bytes", "text")
    stored = probe(encode(docs).drop("text")).drop("n_tracks", "error")
    return stored.mapInArrow(digest, schema)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of every document's payload, read back from its container."""
    return op8_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
