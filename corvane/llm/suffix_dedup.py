"""Removal of long repeated byte strings by a logarithmic family of anchor tables in place of suffix arrays.

A string of ``LENGTH`` bytes is repeated if it starts anywhere else in the corpus.  Suffixes are
indexed at content-defined anchors only: in every window of ``LENGTH`` bytes the anchor is the place
of the smallest hash of ``GRAM`` bytes (the first one if several).  Equal windows have equal anchors,
so two equal strings always meet under the anchor's key, and about one suffix in eighty is indexed.

A *batch* of documents is turned into a table: its entries (key, context) sorted by key within a part,
the context being the bytes of all windows that share the anchor.  Keys are hashes, so there is no
order of suffixes.  The table is scanned (a semi-join on the key) against itself and every existing level; keys met more than once are reported.  Then
the batch becomes a level, and levels of equal size merge, two of rank r giving one of rank r + 1, so
the index holds at most log2(batches) levels and every entry is rewritten as often at most.

Reported keys are then decided exactly.  Entries are counted by (key, context) with map-side partial
sums: a context that occurs twice repeats as a whole, however often.  Different contexts of one key
are compared window by window, each window's hash being counted over the contexts; no pairs are
formed.  Keys with at most ``GROUP_LIMIT`` different contexts are counted in memory, one key after the
other; beyond it the window hashes are counted by distributed aggregation, with the same result.

Texts are packed into compressed chunks once and only these are moved.

Hashes have 64 bits within a key of 64 bits (together 128).

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; very long texts are whole, one
chunk each, and take part in their own comparison; repeated rows are rows of their own and remove each
other; a string that overlaps its own repetition counts; null ids stay; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import tidied, whole_groups
from corvane.plans.scratch import materialize, release

LENGTH = 200
GRAM = 40
BATCHES = 4
#: Different contexts of a key that one task may hold; beyond it they are counted by distributed aggregation.
GROUP_LIMIT = 60_000
#: Contexts of several keys that are compared at once.
HELD = 20_000
#: Bytes of text whose windows are held at once, one document at least.
BLOCK_BYTES = 2 << 20
#: Windows whose anchors are looked for at once, and bits that number the bytes of their text.
SEGMENT = 1 << 16
_PLACE_BITS = 22


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place (by doubling)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    have, powers = 1, [(1, h)]
    while have * 2 <= GRAM:
        h = (h[:-have] * np.uint64(0xBF58476D1CE4E5B9)) + (h[have:] ^ (h[have:] >> np.uint64(31)))
        have *= 2
        powers.append((have, h))
    got, out = 0, None
    for size, part in reversed(powers):
        if got + size <= GRAM:
            n = len(data) - GRAM + 1
            piece = part[got : got + n]
            out = piece.copy() if out is None else out * np.uint64(0x94D049BB133111EB) + (piece ^ (piece >> np.uint64(33)))
            got += size
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` neighbours (by doubling)."""
    have, m = 1, a
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        n = len(a) - width + 1
        m = np.minimum(m[:n], m[width - have : width - have + n])
    return m


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, anchor place, first and last window start) over documents that lie in ``data``.

    Runs of neighbouring windows of one document that share their anchor form one entry.  A window's
    anchor depends on its bytes alone, so texts of any length are taken a segment at a time; a run that
    a segment cuts becomes two entries.
    """
    parts = [_segment_anchors(data, starts, ends, at) for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT)]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segment_anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    piece = np.frombuffer(data, np.uint8)[base : base + SEGMENT + LENGTH - 1]
    places = np.arange(len(piece) - GRAM + 1, dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (_gram_hashes(piece) & ~low) | places
    low_most = _window_min(ranked, LENGTH - GRAM + 1)
    at = (low_most & low).astype(np.int64) + base  # of each window start
    window = np.arange(len(at)) + base
    doc = np.searchsorted(ends, window, "right")
    good = window + LENGTH <= ends[np.minimum(doc, len(ends) - 1)]
    w = np.flatnonzero(good)
    if not len(w):
        return none, none, none, none
    a, d = at[w], doc[w]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    return d[first], a[first], w[first] + base, w[last] + base


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


#: Bits of a row's number inside its chunk, and of a window count beside a place.
_ROW_BITS, _SIDE_BITS = 20, 10
_CHUNK = "batch int, chunk bigint, blob binary"


def pack_texts(docs: DataFrame, batches: int) -> DataFrame:
    """(chunk, blob, batch): texts as UTF-8 bytes with their ids, some megabytes a chunk."""

    @tidied
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 20, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk % batches], pa.int32()), pa.array([chunk], pa.int64()), pa.array([_pack((ids, texts))], pa.binary())],
                names=["batch", "chunk", "blob"],
            )

        for part in parts:
            for doc_id, text in zip(part.column("doc_id"), part.column("text")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and (size + len(raw) > BLOCK_BYTES or len(texts) >> _ROW_BITS):
                    yield out()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(raw)
                size += len(raw)
        if texts:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, _CHUNK)


#: row: chunk and number in it.  place: anchor, bytes before and after it that its windows cover.
_ENTRY = "key bigint, ctx bigint, row bigint, place bigint"


@tidied
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h64 = xxhash.xxh3_64_intdigest
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
            texts = _unpack(blob.as_py())[1]
            data = b"".join(texts)
            view = memoryview(data)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            d, a, w0, w1 = anchors(data, ends - sizes, ends)
            back, stop = a - w0, w1 + LENGTH
            places = ((a - (ends - sizes)[d]) << 2 * _SIDE_BITS) | (back << _SIDE_BITS) | (stop - a)
            rows = (chunk << _ROW_BITS) | d
            keys = np.fromiter((h64(view[i : i + GRAM]) for i in a.tolist()), np.uint64, len(a))
            ctxs = np.fromiter((h64(view[i:j], k) for i, j, k in zip(w0.tolist(), stop.tolist(), back.tolist())), np.uint64, len(a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(ctxs.view(np.int64)), pa.array(rows, pa.int64()), pa.array(places, pa.int64())],
                names=["key", "ctx", "row", "place"],
            )


class SuffixIndex:
    """Levels of suffix arrays that grow geometrically, and the keys met more than once so far."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.met: DataFrame | None = None

    def add(self, batch: DataFrame) -> None:
        """Scan a batch of entries against itself and every level, then make it a level."""
        array = materialize(batch.sortWithinPartitions("key"), "level0")
        # each side sends a key once a task: a hot key is one row of a task, not one of an entry
        own = array.groupBy("key").count()
        met = own.where("count > 1").select("key")
        for level in self.levels.values():
            met = met.unionByName(own.select("key").join(level.select("key").distinct(), "key", "left_semi"))
        met = materialize(met.distinct(), "met")
        self.met = met if self.met is None else self.met.unionByName(met)
        rank = 0
        while rank in self.levels:
            older = self.levels.pop(rank)
            rank += 1
            merged = materialize(array.unionByName(older).sortWithinPartitions("key"), f"level{rank}")
            release(array, older)
            array = merged
        self.levels[rank] = array

    def entries(self) -> DataFrame:
        out = None
        for level in self.levels.values():
            out = level if out is None else out.unionByName(level)
        return out

    def repeated(self) -> DataFrame:
        """The entries whose key was met more than once."""
        # written first: both sides of the join then come from an exchange, and a hot key can be split over tasks
        return self.entries().join(materialize(self.met.distinct(), "met"), "key", "left_semi")


def _sides(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side = (1 << _SIDE_BITS) - 1
    return place >> 2 * _SIDE_BITS, (place >> _SIDE_BITS) & side, place & side


_CONTEXT = "key bigint, ctx bigint, single boolean, row bigint, place bigint, raw binary"


def _contexts(part: pd.DataFrame) -> pd.DataFrame:
    """The bytes of the wanted entries of one chunk."""
    texts = _unpack(part.blob[part.blob.notna()].iloc[0])[1]
    want = part[part.blob.isna()]
    at, back, fore = _sides(want.place.to_numpy(np.int64))
    number = want.row.to_numpy(np.int64) & ((1 << _ROW_BITS) - 1)
    raw = [texts[n][i - b : i + f] for n, i, b, f in zip(number.tolist(), at.tolist(), back.tolist(), fore.tolist())]
    return want[["key", "ctx", "single", "row", "place"]].assign(raw=raw).astype({"key": "int64", "ctx": "int64", "row": "int64", "place": "int64"})


_SPAN = "chunk bigint, row bigint, start bigint, end bigint"


@tidied
def _shared_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the contexts in rows sorted by key; some keys are held at a time, one at least."""
    for table, cuts in whole_groups(batches, "key"):
        first = 0
        while first < len(cuts) - 1:
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + HELD, "right")) - 1)
            found = _common_windows(table.slice(int(cuts[first]), int(cuts[last] - cuts[first])).to_pandas())
            if len(found):
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)
            first = last


def _common_windows(part: pd.DataFrame) -> pd.DataFrame:
    """Spans of single contexts that another context of their key holds too.

    The contexts are laid out with their anchors in one column.  One window a row and distance is
    hashed from two running sums; equal (key, hash) in two rows are a common window.
    """
    n, width = len(part), 2 * LENGTH
    key = part.key.to_numpy(np.int64).view(np.uint64)
    at, back, fore = _sides(part.place.to_numpy(np.int64))
    grid = np.zeros((n, width), np.uint8)
    reach = LENGTH - GRAM  # column of the anchors
    for i, (raw, b) in enumerate(zip(part.raw, back.tolist())):
        grid[i, reach - b : reach - b + len(raw)] = np.frombuffer(raw, np.uint8)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(pow(int(base), LENGTH, 1 << 64))
    hold = np.zeros((n, reach + 1), bool)  # by distance
    spread = lambda col: (grid[:, col].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    lead = np.zeros(n, np.uint64)
    for col in range(LENGTH):
        lead = lead * base + (spread(col) ^ (spread(col) >> np.uint64(32)))
    for start in range(reach + 1):
        dist = reach - start
        ok = np.flatnonzero((back >= dist) & (fore >= LENGTH - dist))
        if len(ok) > 1:
            h = (lead[ok] ^ (lead[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ key[ok]
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            hit = np.zeros(len(ok), bool)
            hit[order[1:]] |= same
            hit[order[:-1]] |= same
            hold[ok[hit], dist] = True
        if start < reach:
            new, old = spread(start + LENGTH), spread(start)
            lead = lead * base + (new ^ (new >> np.uint64(32))) - (old ^ (old >> np.uint64(32))) * power
    hold &= part.single.to_numpy(bool)[:, None]
    edge = np.diff(np.pad(hold, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r0, d0 = np.nonzero(edge == 1)
    _, d1 = np.nonzero(edge == -1)  # one past the last distance
    row = part.row.to_numpy(np.int64)[r0]
    return pd.DataFrame({"chunk": row >> _ROW_BITS, "row": row, "start": at[r0] - (d1 - 1), "end": at[r0] - d0 + LENGTH})


_WINDOW = "key bigint, dist int, win bigint, single boolean, row bigint, at bigint"


@tidied
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of the contexts."""
    h64 = xxhash.xxh3_64_intdigest
    for batch in batches:
        for rec in batch.to_pylist():
            at, back, fore = (int(x) for x in _sides(np.int64(rec["place"])))
            dists = [d for d in range(max(0, LENGTH - fore), back + 1)]
            view = memoryview(rec["raw"])
            wins = [_signed(h64(view[back - d : back - d + LENGTH])) for d in dists]
            n = len(dists)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rec["key"]] * n, pa.int64()), pa.array(dists, pa.int32()), pa.array(wins, pa.int64()),
                 pa.array([rec["single"]] * n, pa.bool_()), pa.array([rec["row"]] * n, pa.int64()), pa.array([at] * n, pa.int64())],
                names=["key", "dist", "win", "single", "row", "at"],
            )


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(digest: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _unpack(part.blob[part.blob.notna()].iloc[0])
        spans = part[part.blob.isna()]
        number = spans.row.to_numpy(np.float64).astype(np.int64) & ((1 << _ROW_BITS) - 1) if len(spans) else np.zeros(0, np.int64)
        order = np.lexsort((spans.start.to_numpy(np.float64), number))
        number, start, end = number[order], spans.start.to_numpy(np.float64).astype(np.int64)[order], spans.end.to_numpy(np.float64).astype(np.int64)[order]
        bounds = np.searchsorted(number, np.arange(len(texts) + 1))
        out = []
        for k, (doc_id, raw) in enumerate(zip(ids, texts)):
            runs: list[list[int]] = []
            for s, e in zip(start[bounds[k] : bounds[k + 1]].tolist(), end[bounds[k] : bounds[k + 1]].tolist()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            kept, at = [], 0
            for s, e in runs:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]])
            last = hashlib.sha256(kept).hexdigest() if digest else kept
            out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), last))
        found = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
        if not found.doc_id.map(type).eq(str).any():
            found["doc_id"] = pd.array(found["doc_id"].tolist(), dtype="Int64")
        return found

    return run


def _with_chunks(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """A chunk's texts and its rows under one key."""
    blank = rows.withColumn("blob", F.lit(None).cast("binary"))
    return chunks.select("chunk", "blob").unionByName(blank, allowMissingColumns=True)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, group_limit: int = GROUP_LIMIT, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; ``digest`` gives kept_sha256 for kept."""
    chunks = materialize(pack_texts(docs, batches), "texts", partition_by="batch").select("batch", "chunk", "blob")
    index = SuffixIndex()
    for b in range(batches):
        index.add(chunks.where(F.col("batch") == b).select("chunk", "blob").mapInArrow(_entries, _ENTRY))
    met = materialize(index.repeated(), "repeated")
    release(*index.levels.values())
    counted = met.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row", "place"), "row").alias("one"))
    counted = materialize(counted.select("key", "ctx", "n", "one.row", "one.place"), "contexts")
    # contexts that occur again as a whole
    whole = met.join(counted.where("n > 1").select("key", "ctx"), ["key", "ctx"])
    at, side = F.shiftright("place", 2 * _SIDE_BITS), (1 << _SIDE_BITS) - 1
    back, fore = F.shiftright("place", _SIDE_BITS).bitwiseAND(F.lit(side).cast("long")), F.col("place").bitwiseAND(F.lit(side).cast("long"))
    spans = whole.select(F.shiftright("row", _ROW_BITS).alias("chunk"), "row", (at - back).alias("start"), (at + fore).alias("end"))
    # different contexts of one key, one text each
    several = counted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    several = materialize(several.select("key", "m"), "several")
    wanted = counted.join(several, "key").select(
        F.shiftright("row", _ROW_BITS).alias("chunk"), "key", "ctx", (F.col("n") == 1).alias("single"), "row", "place"
    )
    texts = materialize(_with_chunks(chunks, wanted).groupBy("chunk").applyInPandas(_contexts, _CONTEXT), "bytes")
    hot = several.where(F.col("m") > group_limit)
    cold = texts
    if not hot.isEmpty():
        cold = texts.join(hot, "key", "left_anti")
        windows = materialize(texts.join(hot.select("key"), "key", "left_semi").mapInArrow(_windows, _WINDOW), "windows")
        common = windows.groupBy("key", "dist", "win").count().where("count > 1").select("key", "dist", "win")
        shared = windows.where("single").join(common, ["key", "dist", "win"])
        spans = spans.unionByName(
            shared.select(F.shiftright("row", _ROW_BITS).alias("chunk"), "row", (F.col("at") - F.col("dist")).alias("start"), (F.col("at") - F.col("dist") + LENGTH).alias("end"))
        )
    cold = cold.repartition("key").sortWithinPartitions("key")
    spans = spans.unionByName(cold.mapInArrow(_shared_spans, _SPAN))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _RESULT if digest else _RESULT.replace("kept_sha256 string", "kept binary")
    return _with_chunks(chunks, spans).groupBy("chunk").applyInPandas(_cut(digest), f"doc_id {kind}, {out}")
