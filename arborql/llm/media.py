"""ISO base media containers: write lossless 8-bit audio tracks, and read the tables of any such file.

``media_columns`` walks the nested boxes of every file and decodes its sample tables; the payload is only ever
sliced, never decoded. A column of files that are null, empty or broken gives null features and says why in ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import small_batches

UNIT = 192
UNITS_PER_CHUNK = 64
RATE = 8000
#: Boxes that hold boxes (fixed values of the format).
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class BrokenMedia(ValueError):
    pass


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def audio_file(payload: bytes) -> bytes:
    """A file with one mono track of 8-bit PCM. A sample is an access unit of UNIT bytes; the first of each chunk is a sync sample."""
    units = len(payload) // UNIT
    if units * UNIT != len(payload) or not units:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    chunks = -(-units // UNITS_PER_CHUNK)
    last = units - (chunks - 1) * UNITS_PER_CHUNK
    runs = [(1, UNITS_PER_CHUNK)] if chunks > 1 else []
    if not runs or last != UNITS_PER_CHUNK:
        runs.append((chunks, last))
    starts = np.arange(chunks, dtype=np.int64)
    entry = box(b"ipcm", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16), full(b"pcmC", struct.pack(">BB", 1, 8)))
    wide = len(payload) > (1 << 32) - (1 << 16)

    def header(first: int) -> bytes:
        offsets = first + starts * (UNITS_PER_CHUNK * UNIT)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(">I", chunks), (starts * UNITS_PER_CHUNK + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, min(len(payload), 0xFFFFFFFF), 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, min(len(payload), 0xFFFFFFFF), 0, 0, 0x100, 0), UNITY, bytes(8), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, min(len(payload), 0xFFFFFFFF), 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    before = len(header(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return header(before) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first content byte and end of each box between ``start`` and ``end``."""
    while start < end:
        if end - start < 8:
            raise BrokenMedia("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise BrokenMedia("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise BrokenMedia(f"box {kind!r} has a wrong size")
        yield kind, body, start + size
        start += size


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    chunk_offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first_unit: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    unit_size: int = 0
    unit_ends: np.ndarray | None = None
    units: int = 0
    sync: np.ndarray | None = None

    def unit_range(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of samples, counted from zero."""
        chunk = np.searchsorted(self.first_unit, unit, "right") - 1
        first = self.first_unit[chunk]
        if self.unit_ends is None:
            start = self.chunk_offsets[chunk] + (unit - first) * self.unit_size
            return start, start + self.unit_size
        ends = np.concatenate([np.zeros(1, np.int64), self.unit_ends])
        start = self.chunk_offsets[chunk] + ends[unit] - ends[first]
        return start, start + ends[unit + 1] - ends[unit]

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.unit_range(np.arange(self.units) if self.sync is None else self.sync)

    def chunk_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(self.first_unit)
        if self.unit_ends is None:
            return self.chunk_offsets, self.chunk_offsets + counts * self.unit_size
        ends = np.concatenate([np.zeros(1, np.int64), self.unit_ends])
        return self.chunk_offsets, self.chunk_offsets + ends[self.first_unit[1:]] - ends[self.first_unit[:-1]]


def _table(data: memoryview, body: int, end: int, width: int, kind: str, head: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + head)
    at = body + head + 4
    if at + n * width * np.dtype(kind).itemsize > end:
        raise BrokenMedia("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, at).astype(np.int64).reshape(n, width)


def _leaf(tables: dict, data: memoryview, kind: bytes, body: int, end: int) -> None:
    version = data[body] if end > body else 0
    if kind == b"mdhd":
        tables["mdhd"] = struct.unpack_from(">IQ" if version else ">II", data, body + (20 if version else 12))
    elif kind == b"stsd":
        tables["codec"] = bytes(data[body + 12 : body + 16]).decode("latin-1")
    elif kind in (b"stts", b"stss", b"stsc", b"stco", b"co64"):
        width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
        tables[kind.decode()] = _table(data, body, end, width, ">u8" if kind == b"co64" else ">u4")
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, body + 4)
        tables["stsz"] = (size, n, None if size else _table(data, body, end, 1, ">u4", head=8)[:, 0])


def _track(tables: dict) -> Track:
    if not {"codec", "stsc", "stsz"} <= tables.keys() or not ("stco" in tables or "co64" in tables):
        raise BrokenMedia("a track lacks a sample table")
    offsets = tables["co64" if "co64" in tables else "stco"][:, 0]
    runs, (size, units, sizes) = tables["stsc"], tables["stsz"]
    firsts = runs[:, 0] - 1
    if len(runs) and (firsts[0] != 0 or (np.diff(firsts) <= 0).any() or firsts[-1] >= max(1, len(offsets))):
        raise BrokenMedia("stsc isn't in order")
    counts = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(offsets)))) if len(runs) else np.zeros(0, np.int64)
    first_unit = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    if first_unit[-1] != units:
        raise BrokenMedia("stsc and stsz disagree")
    scale, duration = tables.get("mdhd", (0, 0))
    sync = tables["stss"][:, 0] - 1 if "stss" in tables else None
    if sync is not None and len(sync) and (sync.min() < 0 or sync.max() >= units):
        raise BrokenMedia("stss names a sample that isn't there")
    return Track(tables["codec"], scale, duration, offsets, first_unit, size, None if size else np.cumsum(sizes), units, sync)


def tracks(file: bytes) -> list[Track]:
    """The tracks of a file, from its sample tables."""
    data = memoryview(file)
    found: list[Track] = []

    def walk(start: int, end: int, tables: dict | None, depth: int) -> None:
        if depth > 16:
            raise BrokenMedia("boxes are nested too deep")
        for kind, body, stop in boxes(data, start, end):
            if kind == b"trak":
                own: dict = {}
                walk(body, stop, own, depth + 1)
                found.append(_track(own))
            elif kind in NESTS:
                walk(body, stop, tables, depth + 1)
            elif tables is not None:
                _leaf(tables, data, kind, body, stop)

    try:
        walk(0, len(data), None, 0)
    except struct.error as e:
        raise BrokenMedia("a box is cut off") from e
    if not found:
        raise BrokenMedia("no track")
    return found


def payload_of(file: bytes, track: Track) -> bytes:
    """The bytes that a track's chunks hold, in order."""
    starts, ends = track.chunk_ranges()
    if len(ends) and (int(ends.max()) > len(file) or int(starts.min()) < 0):
        raise BrokenMedia("a chunk lies outside the file")
    view = memoryview(file)
    return b"".join(view[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def encode_audio(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, n_bytes, media): each value's UTF-8 or binary bytes, padded, as an audio file. Null is empty; rows may repeat."""
    chosen = df.select(df[id_col].alias("id"), df[data_col].cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([audio_file(padded(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def media_columns(df: DataFrame, media_col: str, with_payload: bool = False) -> DataFrame:
    """``df`` with media_codec, media_timescale, media_duration, media_samples, media_keyframes (byte ranges), media_error, and
    media_payload if asked for: those of the file's first track.

    Null, empty or broken files have nulls and their reason in media_error. Columns of ``df`` with these names are replaced.
    """
    names = ["media_codec", "media_timescale", "media_duration", "media_samples", "media_keyframes", "media_error", *["media_payload"] * with_payload]
    kept = df.select(*(df[c] for c in df.columns if c not in names or c == media_col))
    at = kept.columns.index(media_col)
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(RANGE), pa.string(), *[pa.binary()] * with_payload]

    def one(file: bytes | None) -> tuple:
        try:
            track = tracks(file or b"")[0]
            payload = payload_of(file, track) if with_payload else None
            start, end = track.keyframes()
        except BrokenMedia as e:
            return (None, None, None, None, None, str(e), None)
        return (track.codec, track.timescale, track.duration, track.units, [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)], None, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [one(x) for x in batch.column(at).to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "media_codec string, media_timescale long, media_duration long, media_samples long, media_keyframes array<struct<start:long,end:long>>, media_error string", *["media_payload binary"] * with_payload])
    return kept.mapInArrow(run, schema)
