"""Media columns: ISO base media containers (MP4 family).

``mux`` stores bytes losslessly as 8-bit grey video samples; ``probe`` walks the nested boxes, decodes
the sample tables (stts, ctts, stss, stsz, stz2, stsc, stco, co64), the edit list (elst) and the
fragments (mvex/trex, moof/traf/tfhd/tfdt/trun), and gives codec, duration and key-frame byte ranges
from the tables alone; ``demux`` reads the stored bytes back through the sample ranges.  Payloads are
never decoded.  ``media_columns`` does all of this for texts, ``describe_files`` describes a column of
given files.

Cases: a null text is empty and is stored as one frame of padding; very long texts are stored whole,
one file in memory at a time; equal texts give equal files; boxes with 64-bit sizes or reaching to the
end of the file are walked; a truncated box or table raises ValueError in ``probe`` and gives its
message in the column ``error`` of ``describe_files``; a null file has no tracks and no error; null ids
and repeated rows pass through; an empty table gives an empty result; other columns are not read by
``media_columns`` and pass through ``describe_files``, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from corvane.llm.common import fresh

#: Fixed values of the file format: boxes that only hold other boxes, and the bytes before a box's children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}

FRAME = 576  # 24 x 24 grey samples of 8 bits
SIDE = 24
TIMESCALE = 25
#: Every so many frames is marked as a key frame.
KEY_EVERY = 8
FRAMES_PER_CHUNK = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _u32(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}I", *numbers)


_MATRIX = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the frame size."""
    return data + b"\xff" * (FRAME - len(data) if not data else -len(data) % FRAME)


def mux(payload: bytes) -> bytes:
    """An MP4 file whose samples are the frames of ``payload``, a positive multiple of the frame size."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("the payload isn't a positive number of whole frames")
    chunks = -(-n // FRAMES_PER_CHUNK)
    last = n - (chunks - 1) * FRAMES_PER_CHUNK
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", SIDE, SIDE),
        _u32(0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1),
    )
    runs = [(1, FRAMES_PER_CHUNK)] if chunks > 1 else []
    if last != FRAMES_PER_CHUNK or chunks == 1:
        runs.append((chunks, last))
    keys = range(1, n + 1, KEY_EVERY)
    wide = len(payload) >= 1 << 31

    def moov(first: int) -> bytes:
        offsets = [first + c * FRAMES_PER_CHUNK * FRAME for c in range(chunks)]
        places = _full(b"co64", _u32(chunks), struct.pack(f">{chunks}Q", *offsets)) if wide else _full(b"stco", _u32(chunks, *offsets))
        stbl = _box(
            b"stbl",
            _full(b"stsd", _u32(1), entry),
            _full(b"stts", _u32(1, n, 1)),
            _full(b"stss", _u32(len(keys), *keys)),
            _full(b"stsc", _u32(len(runs)), *(_u32(c, k, 1) for c, k in runs)),
            _full(b"stsz", _u32(FRAME, n)),
            places,
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", _u32(1), _full(b"url ", flags=1))), stbl)
        hdlr = _full(b"hdlr", _u32(0), b"vide", bytes(12), b"text frames\0")
        mdia = _box(b"mdia", _full(b"mdhd", _u32(0, 0, TIMESCALE, n), struct.pack(">HH", 0x55C4, 0)), hdlr, minf)
        tkhd = _full(b"tkhd", _u32(0, 0, 1, 0, n), bytes(8), bytes(8), _MATRIX, _u32(SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", _u32(0, 0, TIMESCALE, n, 0x10000), struct.pack(">H", 0x100), bytes(10), _MATRIX, bytes(24), _u32(2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", _u32(512), b"isommp41")
    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + _box(b"mdat", payload)


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of box kinds, first byte, first byte of the body, end) of every box, parents before children."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError(f"box {kind!r} at {at} is truncated")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} is truncated")
        yield (*path, kind), at, body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], at + size, (*path, kind))
        at += size


_NONE = np.zeros(0, np.int64)


@dataclass
class Track:
    """What the tables of one track say."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    movie_timescale: int = 0
    #: (duration in the movie's time, first time of the media or -1 for nothing shown)
    edits: list = field(default_factory=list)
    #: presentation times within the media, in decoding order
    times: np.ndarray = field(default_factory=lambda: _NONE)
    offsets: np.ndarray = field(default_factory=lambda: _NONE)
    sizes: np.ndarray = field(default_factory=lambda: _NONE)
    keys: np.ndarray = field(default_factory=lambda: _NONE)

    def key_ranges(self) -> list[tuple[int, int]]:
        """[first byte, end) of each key frame."""
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]

    def seconds(self) -> np.ndarray:
        """When each sample is shown: media times moved by the edits before and at the first one that shows anything."""
        wait = skip = 0.0
        for length, first in self.edits:
            if first >= 0:
                skip = first / self.timescale if self.timescale else 0.0
                break
            wait += length / self.movie_timescale if self.movie_timescale else 0.0
        return (self.times / self.timescale if self.timescale else self.times * 0.0) + wait - skip

    def duration_s(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    return _numbers(data, at + 4, end, n * columns, kind).reshape(n, columns)


def _numbers(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError(f"a table at {at} is truncated")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


class _Tables:
    """The sample tables and fragment runs of one track, as they are read."""

    def __init__(self) -> None:
        self.track = Track()
        self.raw: dict[str, np.ndarray] = {}
        self.defaults = (0, 0, 0)  # duration, size, flags of a sample
        self.clock = 0  # decoding time of the next fragment's first sample
        self.runs: list[tuple[np.ndarray, ...]] = []

    def samples(self) -> None:
        """Places the samples that the tables list."""
        raw, track = self.raw, self.track
        sizes = track.sizes = raw.get("sizes", _NONE)
        n = len(sizes)
        chunk_at, runs = raw.get("chunks", _NONE), raw.get("runs", np.zeros((0, 3), np.int64))
        if n:
            # samples per chunk: each run holds until the next run's first chunk
            reach = np.append(runs[1:, 0], len(chunk_at) + 1) - runs[:, 0]
            if not len(runs) or (reach < 0).any():
                raise ValueError("the chunk tables place fewer samples than there are sizes")
            per_chunk = np.repeat(runs[:, 1], reach)[: len(chunk_at)]
            chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
            if len(chunk_of) != n:
                raise ValueError("the chunk tables place fewer samples than there are sizes")
            before = np.cumsum(sizes) - sizes
            first = np.cumsum(per_chunk) - per_chunk
            track.offsets = chunk_at[chunk_of] + before - before[np.minimum(first[chunk_of], n - 1)]
        steps = raw.get("stts", np.zeros((0, 2), np.int64))
        deltas = np.repeat(steps[:, 1], steps[:, 0])[:n]
        self.clock = int(deltas.sum())
        track.times = np.cumsum(deltas) - deltas
        if "ctts" in raw:
            shift = np.repeat(raw["ctts"][:, 1], raw["ctts"][:, 0])
            track.times = track.times[: len(shift)] + shift[: len(track.times)]
        track.keys = raw["stss"] - 1 if "stss" in raw else np.arange(n)

    def finish(self) -> Track:
        """Adds the samples of the fragments."""
        track = self.track
        for offsets, sizes, times, keys in self.runs:
            track.keys = np.concatenate([track.keys, keys + len(track.sizes)])
            track.offsets, track.sizes, track.times = (np.concatenate(x) for x in ((track.offsets, offsets), (track.sizes, sizes), (track.times, times)))
        if not track.duration:  # files in fragments often leave it out
            track.duration = self.clock
        return track


#: Fixed values of the file format: flags of tfhd and trun, and the bit of a sample that is no key frame.
TF_BASE, TF_DESCRIPTION, TF_DURATION, TF_SIZE, TF_FLAGS, TF_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TR_OFFSET, TR_FIRST, TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEY = 0x10000


class _Fragment:
    """One traf: its track, defaults and the place where the next run's data begins."""

    def __init__(self, tables: _Tables, flags: int, view: memoryview, at: int, moof: int, after: int):
        self.tables, self.next = tables, after if not flags & TF_MOOF else moof
        if flags & TF_BASE:
            (self.next,) = struct.unpack_from(">Q", view, at)
            at += 8
        self.base = self.next
        at += 4 * bool(flags & TF_DESCRIPTION)
        own = list(tables.defaults)
        for k, bit in enumerate((TF_DURATION, TF_SIZE, TF_FLAGS)):
            if flags & bit:
                (own[k],) = struct.unpack_from(">I", view, at)
                at += 4
        self.defaults = own

    def run(self, view: memoryview, at: int, end: int, version: int, flags: int) -> None:
        (n,) = struct.unpack_from(">I", view, at)
        at += 4
        if flags & TR_OFFSET:
            self.next = self.base + struct.unpack_from(">i", view, at)[0]
            at += 4
        first = None
        if flags & TR_FIRST:
            (first,) = struct.unpack_from(">I", view, at)
            at += 4
        named = [bit for bit in (TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT) if flags & bit]
        rows = _numbers(view, at, end, n * len(named), ">u4").reshape(n, len(named))
        column = {bit: rows[:, k] for k, bit in enumerate(named)}
        duration, size, flag = (column.get(bit, np.full(n, d, np.int64)) for bit, d in zip((TR_DURATION, TR_SIZE, TR_FLAGS), self.defaults))
        if first is not None and n and TR_FLAGS not in column:
            flag = flag.copy()
            flag[0] = first
        shift = column.get(TR_SHIFT, np.zeros(n, np.int64))
        if version:  # signed
            shift = shift - ((shift >> 31) << 32)
        t = self.tables
        t.runs.append((self.next + np.cumsum(size) - size, size, t.clock + np.cumsum(duration) - duration + shift, np.flatnonzero(flag & NO_KEY == 0)))
        self.next += int(size.sum())
        t.clock += int(duration.sum())


def probe(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes and tables alone."""
    try:
        return _probe(data)
    except struct.error as e:
        raise ValueError(f"a box is truncated: {e}") from None


def _probe(data: bytes) -> list[Track]:
    view, found, by_number, movie, moof, fragment = memoryview(data), [], {}, 0, 0, None
    placed, after = False, 0
    for path, start, at, end in walk(view):
        kind = path[-1]
        t = found[-1] if found else None
        version, flags, body = (view[at], int.from_bytes(view[at + 1 : at + 4], "big"), at + 4) if at + 4 <= end else (0, 0, at)
        if kind == b"trak":
            found.append(_Tables())
        elif kind == b"mvhd":
            (movie,) = struct.unpack_from(">I", view, body + (16 if version else 8))
        elif kind == b"trex":
            number, _, *defaults = struct.unpack_from(">IIIII", view, body)
            by_number.setdefault(number, {})["defaults"] = tuple(defaults)
        elif kind == b"moof":
            if not placed:
                _place(found, by_number)
                placed = True
            moof = after = start
        elif kind == b"tfhd":
            (number,) = struct.unpack_from(">I", view, body)
            own = next((x for x in found if x.track.number == number), None)
            if fragment is not None:
                after = fragment.next if path[0] == b"moof" and moof == fragment.moof else moof
            fragment = _Fragment(own, flags, view, body + 4, moof, after) if own else None
            if fragment:
                fragment.moof = moof
        elif kind == b"tfdt" and fragment:
            (fragment.tables.clock,) = struct.unpack_from(">Q" if version else ">I", view, body)
        elif kind == b"trun" and fragment:
            fragment.run(view, body, end, version, flags)
        elif t is None or path[0] != b"moov":
            continue
        elif kind == b"tkhd":
            (t.track.number,) = struct.unpack_from(">I", view, body + (16 if version else 8))
        elif kind == b"mdhd":
            t.track.timescale, t.track.duration = struct.unpack_from(">IQ" if version else ">II", view, body + (16 if version else 8))
        elif kind == b"hdlr" and b"mdia" in path:
            t.track.handler = bytes(view[body + 4 : body + 8]).decode("latin-1")
        elif kind == b"elst":
            (n,) = struct.unpack_from(">I", view, body)
            step, form = (20, ">Qq") if version else (12, ">Ii")
            t.track.edits = [struct.unpack_from(form, view, body + 4 + k * step) for k in range(n)]
        elif kind == b"stsd":
            t.track.codec = bytes(view[body + 8 : body + 12]).decode("latin-1").strip()
        elif kind in (b"stts", b"ctts"):
            t.raw[kind.decode()] = _table(view, body, end, 2, ">i4" if kind == b"ctts" and version else ">u4")
        elif kind == b"stss":
            t.raw["stss"] = _table(view, body, end, 1).ravel()
        elif kind == b"stsc":
            t.raw["runs"] = _table(view, body, end, 3)
        elif kind == b"stco":
            t.raw["chunks"] = _table(view, body, end, 1).ravel()
        elif kind == b"co64":
            t.raw["chunks"] = _table(view, body, end, 1, ">u8").ravel()
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", view, body)
            t.raw["sizes"] = np.full(n, fixed, np.int64) if fixed else _table(view, body + 4, end, 1).ravel()
        elif kind == b"stz2":
            bits, n = view[body + 3], struct.unpack_from(">I", view, body + 4)[0]
            if bits == 4:
                pair = _numbers(view, body + 8, end, (n + 1) // 2, ">u1")
                t.raw["sizes"] = np.stack([pair >> 4, pair & 15], 1).ravel()[:n]
            else:
                t.raw["sizes"] = _numbers(view, body + 8, end, n, f">u{bits // 8}")
    if not placed:
        _place(found, by_number)
    for t in found:
        t.track.movie_timescale = movie
    return [t.finish() for t in found]


def _place(found: list[_Tables], by_number: dict) -> None:
    for t in found:
        t.samples()
        t.defaults = by_number.get(t.track.number, {}).get("defaults", t.defaults)


def demux(data: bytes, track: Track) -> bytes:
    """A track's stored bytes in sample order.  Samples that lie side by side are read as one range."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(ends)) - 1
    view = memoryview(data)
    return b"".join(view[track.offsets[a] : ends[b]] for a, b in zip(firsts, lasts))


def feature(track: Track) -> str:
    ranges = ",".join(f"{a}-{b}" for a, b in track.key_ranges())
    return f"codec={track.codec};handler={track.handler};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={ranges}"


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores each text as a container and describes what is read back from it.

    ``with_media`` adds the column ``media`` with the file itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration_s", "n_keyframes", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, n_keyframes long, feature string"
    if with_media:
        names, kinds, schema = [*names, "media"], [*kinds, pa.binary()], f"{schema}, media binary"

    def describe(text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        file = mux(pad(raw))
        (track,) = probe(file)
        back = demux(file, track)
        sha = hashlib.sha256
        row = (
            len(raw), len(back), sha(back).hexdigest(), zlib.crc32(back[-32:]), len(file), sha(file).hexdigest(),
            track.codec, track.duration_s(), len(track.keys), feature(track),
        )
        return (*row, file) if with_media else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = zip(*(describe(t.as_py() or "") for t in part.column("text")))
                arrays = [pa.array(list(v), k) for v, k in zip(found, kinds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_TRACK = "struct<handler:string,codec:string,duration_s:double,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint,at_s:double>>>"


def describe_files(files: DataFrame, column: str) -> DataFrame:
    """``files`` with the columns ``tracks`` and ``error`` for the binary column ``column``.

    Where ``files`` has one of these names, the new column's name gets an underscore.
    """
    tracks_, error_ = fresh(files, "tracks", "error")
    names = [*files.columns, tracks_, error_]
    schema = StructType([*files.schema.fields]).add(tracks_, DataType.fromDDL(f"array<{_TRACK}>")).add(error_, "string")
    kind = to_arrow_type(schema[tracks_].dataType)

    def describe(file: bytes | None) -> tuple[list, str | None]:
        if file is None:
            return [], None
        try:
            return [
                {
                    "handler": t.handler, "codec": t.codec, "duration_s": t.duration_s(), "n_samples": len(t.sizes),
                    "keyframes": [{"start": a, "end": b, "at_s": float(x)} for (a, b), x in zip(t.key_ranges(), t.seconds()[t.keys])],
                }
                for t in probe(file)
            ], None
        except ValueError as e:
            return [], str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = zip(*(describe(f.as_py()) for f in batch.column(column))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], names=names)

    return files.mapInArrow(run, schema)
