"""Media columns: ISO media containers whose nested boxes are walked and whose sample tables are read.

``pack`` writes a payload as the samples of a one-track container (uncompressed 8-bit audio, one sample entry a block);
``probe`` walks the boxes of any container with 32- or 64-bit sizes, reads the tables of its first track and gives codec,
time scale, duration and the byte ranges of its key samples, without reading a payload; ``read`` follows the sample ranges to the stored bytes.
A container that is cut short, or whose box sizes are wrong, has null columns and an error, never an exception of the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import utf8

BLOCK = 576
KEY_EVERY = 16
RATE = 8000
#: Boxes that hold boxes, and the bytes before their first one.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def pack(payload: bytes, per_chunk: int = 64) -> bytes:
    """A container whose samples of BLOCK bytes are payload; each KEY_EVERY-th is a key sample."""
    n = len(payload) // BLOCK
    chunks = -(-n // per_chunk)
    duration = n * BLOCK
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, per_chunk)] if n >= per_chunk else []
    if n % per_chunk:
        runs.append((chunks, n % per_chunk))
    keys = range(1, n + 1, KEY_EVERY)

    def head(first: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, count, 1) for at, count in runs)),
            full(b"stsz", struct.pack(">II", BLOCK, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + i * per_chunk * BLOCK for i in range(chunks)))),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration & 0xFFFFFFFF, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3), media)
        movie = box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, duration & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41") + movie

    size = len(head(0))
    long = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return head(size + len(mdat)) + mdat + payload


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    def key_ranges(self) -> list[tuple[int, int]]:
        return [self.samples[i - 1] for i in self.keys if 0 < i <= len(self.samples)]


def walk(data: bytes, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of every box's body, parents first. Raises ValueError on sizes that don't fit."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield (*path, kind), body, stop
        if kind in NESTED and len(path) < 16:
            yield from walk(data, body + NESTED[kind], stop, (*path, kind))
        start = stop


def probe(data: bytes) -> Track:
    """The first track with a sample table; each track has its own tables."""
    tracks: list[tuple[Track, dict[bytes, tuple[int, int]]]] = []
    for path, start, stop in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            tracks.append((Track(), {}))
        if not tracks or b"trak" not in path or kind in tracks[-1][1]:
            continue
        track, tables = tracks[-1]
        if kind == b"mdhd":
            wide = data[start] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, start + (20 if wide else 12))
        if path[-2] == b"stbl" or kind == b"mdhd":
            tables[kind] = (start, stop)
    track, tables = next((x for x in tracks if b"stsz" in x[1]), (Track(), {}))

    def numbers(kind: bytes, at: int, form: str) -> list[int]:
        start, stop = tables[kind]
        count = struct.unpack_from(">I", data, start + at)[0]
        width = struct.calcsize(">" + form)
        if start + at + 4 + count * width > stop:
            raise ValueError(f"table {kind!r} is cut short")
        return list(struct.unpack_from(f">{form * count}" if len(form) > 1 else f">{count}{form}", data, start + at + 4))

    try:
        start, _ = tables[b"stsd"]
        track.codec = data[start + 12 : start + 16].decode("latin-1")
        start, _ = tables[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, start + 4)
        sizes = [fixed] * count if fixed else numbers(b"stsz", 8, "I")
        offsets = numbers(b"co64", 4, "Q") if b"co64" in tables else numbers(b"stco", 4, "I")
        runs = numbers(b"stsc", 4, "III")
        track.keys = numbers(b"stss", 4, "I") if b"stss" in tables else list(range(1, count + 1))
    except (KeyError, struct.error) as e:
        raise ValueError(f"no whole sample table: {e}") from e
    firsts, counts = [*runs[0::3], len(offsets) + 1], runs[1::3]
    sample = 0
    for i, per in enumerate(counts):
        for chunk in range(firsts[i] - 1, firsts[i + 1] - 1):
            at = offsets[chunk]
            for size in sizes[sample : sample + per]:
                track.samples.append((at, size))
                at += size
            sample += per
    return track


def read(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order."""
    return b"".join(data[at : at + size] for at, size in track.samples)


def feature(track: Track) -> str:
    keys = track.key_ranges()
    first, last = (keys[0], keys[-1]) if keys else ((-1, 0), (-1, 0))
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.samples)};keys={len(keys)};first={first[0]}+{first[1]};last={last[0]}+{last[1]}"


def _mapped(df: DataFrame, columns: list[str], source: str, made: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    names = [n for n, _, _ in made]
    columns = [c for c in columns if c not in names]  # new columns replace those of their names
    raw = df.schema[source].dataType.typeName() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x or b"" for x in batch.column(source).to_pylist()] if raw else utf8(batch.column(source))
            for at in range(0, max(1, len(values)), 512):
                rows = [row(x) for x in values[at : at + 512]]
                parts = zip(*rows, strict=True) if rows else [[]] * len(made)
                kept = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), *(pa.array(list(x), t) for x, (_, _, t) in zip(parts, made, strict=True))], [*columns, *names])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), *(f"`{n}` {k}" for n, k, _ in made)])
    return df.mapInArrow(run, schema)


def store(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """df with the container of each text's UTF-8 bytes, padded by ``pad``, in binary out_col. Null is stored as empty text."""
    return _mapped(df, df.columns, text_col, [(out_col, "binary", pa.binary())], lambda x: (pack(pad(x)),))


def media_columns(df: DataFrame, media_col: str = "media", prefix: str = "media_") -> DataFrame:
    """df with codec, timescale, duration (in units of timescale), n_samples, key_ranges array<struct<offset, length>> and error under prefix, read from box headers and sample tables only.
    Null and broken containers have nulls and an error."""
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    made = [("codec", "string", pa.string()), ("timescale", "bigint", pa.int64()), ("duration", "bigint", pa.int64()), ("n_samples", "bigint", pa.int64()), ("key_ranges", "array<struct<offset:bigint,length:bigint>>", ranges), ("error", "string", pa.string())]

    def row(data: bytes):
        try:
            track = probe(data)
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, None, str(e)
        return track.codec, track.timescale, track.duration, len(track.samples), [{"offset": a, "length": n} for a, n in track.key_ranges()], None

    return _mapped(df, df.columns, media_col, [(prefix + n, k, t) for n, k, t in made], row)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and figures of each text stored as a container and read back by its own sample tables."""

    def row(text: bytes):
        media = pack(pad(text))
        track = probe(media)
        payload = read(media, track)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)

    made = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return _mapped(df.select(id_col, text_col), [id_col], text_col, made, row)
