"""BPE encoding and decoding through a distinct-word table.

1. ``_split``: each task splits the texts of a chunk of documents into pre-tokens and writes, per
   chunk, the word positions (numbers of the chunk's distinct words) and, per hash bucket, the list
   of distinct words.  Words repeat within a chunk far more than they differ, so the moved word lists
   are a fraction of the text.
2. ``_encode``: a bucket holds all occurrences of its words in any chunk; each distinct word of the
   corpus falls in one bucket and is encoded there once.  A chunk lists a word once, so no word is
   hot: a bucket's size is its share of (chunk, distinct word) pairs.
3. ``_assemble``: the ids come back to their chunk; the ids of its distinct words are joined to the
   table (id, piece), which the vocabulary bounds, and the pieces give each word's text; ids and texts
   are then joined to the word positions.  ``decode`` does the same for documents of ids.

Cases: a null or empty text has no ids and decodes to an empty text; very long texts are whole, one
chunk at least each, and a word may have any number of ids; ids of any size are packed; special strings
become their special ids; null ids and repeated rows pass through; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvane.llm.common import shuffle_width, tidied
from corvane.llm.pretokens import splitter
from corvane.plans.scratch import materialize

#: Characters of text in a chunk, one more document at most.
CHUNK_CHARS = 16_000_000
#: Characters decoded, or ids where no text is built, in one batch of results, one document at most over.
SLICE = 2_000_000
#: Ids joined to their pieces at a time, one text at least.
READ_IDS = 1 << 22
#: Numbers or bytes turned into varints and back at a time; their temporaries are twenty times as large.
_BLOCK = 1 << 18
_PARTS = "kind int, chunk long, bucket int, blob binary"


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _varints(a: np.ndarray) -> bytes:
    """Numbers as groups of seven bits, lowest first: frequent words have small numbers and take one byte."""
    return b"".join(_varint_block(a[i : i + _BLOCK].astype(np.uint32)) for i in range(0, len(a), _BLOCK))


def _varint_block(a: np.ndarray) -> bytes:
    cells = np.stack([(a >> np.uint32(7 * k)) & np.uint32(127) for k in range(5)], 1).astype(np.uint8)
    more = np.stack([a >> np.uint32(7 * k) > 0 for k in range(1, 5)] + [np.zeros(len(a), bool)], 1)
    used = np.concatenate([np.ones((len(a), 1), bool), more[:, :-1]], 1)
    return (cells | (more.astype(np.uint8) << 7))[used].tobytes()


def _unvarints(b: bytes) -> np.ndarray:
    raw, parts, at = np.frombuffer(b, np.uint8), [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while raw[end - 1] > 127:  # up to the end of a number
            end += 1
        parts.append(_unvarint_block(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _unvarint_block(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first).astype(np.uint32)


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first: the planes of high bytes compress away."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _bucket(word: str, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % buckets


def _split(vocab_path: str, buckets: int):
    def rows(chunk: int, ids: list, seen: dict[str, int], at: list[np.ndarray]) -> Iterator[tuple]:
        flat = np.concatenate(at) if at else np.zeros(0, np.uint32)
        words = list(seen)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        lists: dict[int, list[str]] = {}
        of_rank = np.empty(len(words), np.int32)
        for r, w in enumerate(order.tolist()):
            b = of_rank[r] = _bucket(words[w], buckets)
            lists.setdefault(b, []).append(words[w])
        yield 0, chunk, -1, _pack((ids, [len(a) for a in at], _varints(rank[flat]), of_rank))
        for b, part in lists.items():
            yield 1, chunk, b, _pack("\n".join(part))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk = splitter(vocab_path).split, TaskContext.get().partitionId() << 32
        ids, seen, at, chars = [], {}, [], 0

        def batch_of(found: Iterator[tuple]) -> pa.RecordBatch:
            kind, chunk, bucket, blob = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())],
                names=["kind", "chunk", "bucket", "blob"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                words = split(text)
                at.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words)))
                ids.append(doc_id.as_py())
                chars += len(text)
                if chars > CHUNK_CHARS:
                    yield batch_of(rows(chunk, ids, seen, at))
                    chunk, ids, seen, at, chars = chunk + 1, [], {}, [], 0
        if ids:
            yield batch_of(rows(chunk, ids, seen, at))

    return run


def _encode(vocab_path: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpack(b).split("\n") for b in part.blob]
        words = list(dict.fromkeys(chain.from_iterable(lists)))
        ids = dict(zip(words, splitter(vocab_path).encode_words(words)))
        blobs = []
        for words in lists:
            found = [ids[w] for w in words]
            blobs.append(_pack((_planes(np.array([len(f) for f in found])), _planes(np.concatenate(found)))))
        return pd.DataFrame({"kind": 1, "chunk": part.chunk, "bucket": part.bucket, "blob": blobs})

    return run


def _assemble(vocab_path: str, digest: bool, decoded: bool):
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"][: 1 + decoded]

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _piece_table(vocab_path)
        part = pd.concat(list(batches), ignore_index=True)
        doc_ids, sizes, numbers_of, of_rank = _unpack(part.blob[part.kind == 0].iloc[0])
        n = len(of_rank)
        count, lists = np.zeros(n, np.int64), []
        for bucket, blob in zip(part.bucket, part.blob):
            if bucket >= 0:
                lens, ids = map(_unplanes, _unpack(blob))
                own = np.flatnonzero(of_rank == bucket)
                count[own] = lens
                lists.append((own, ids))
        # ids of all words side by side, in the order of their numbers
        start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if n else count
        flat = np.zeros(int(count.sum()), np.int32)
        for own, ids in lists:
            flat[_places(start[own], count[own])] = ids
        del lists, part
        ends = start + count
        shown = [" ".join(map(str, flat[a:b].tolist())) for a, b in zip(start, ends)] if digest else []
        read = _read(flat, np.append(start, len(flat)), pieces) if digest or decoded else []
        textual = any(isinstance(x, str) for x in doc_ids)

        def frame(out: list[list]) -> pd.DataFrame:
            found = pd.DataFrame(out, columns=["doc_id", "n_tokens", *names])
            if not textual:
                found["doc_id"] = pd.array(found["doc_id"].tolist(), dtype="Int64")
            return found

        ranks, at, out, held = _unvarints(numbers_of), 0, [], 0
        for doc_id, size in zip(doc_ids, sizes):
            r = ranks[at : at + size]
            at += size
            row: list = [doc_id, int(count[r].sum())]
            if digest:
                own = r.tolist()
                row += [hashlib.sha256(" ".join([x[i] for i in own]).encode()).hexdigest() for x in (shown, read)]
            else:
                row.append(flat[_places(start[r], count[r])])
                if decoded:
                    row.append(" ".join([read[i] for i in r.tolist()]))
                held += max(len(row[-1]), row[1])
            out.append(row)
            if held > SLICE:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    return run


def _places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of ``count`` places."""
    if not len(start):
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def encode(docs: DataFrame, vocab_path: str, digest: bool = False, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row, or their digests as hex SHA-256; ``decoded`` can be left out.

    The digest of ids is that of the decimal ids joined by one space.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text").mapInArrow(_split(vocab_path, 4 * shuffle_width(spark)), _PARTS)
    parts = materialize(parts, "words", partition_by="kind").select("kind", "chunk", "bucket", "blob")
    ids = parts.where("kind = 1").groupBy("bucket").applyInPandas(_encode(vocab_path), _PARTS)
    out = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>" + ", decoded string" * decoded
    both = parts.where("kind = 0").unionByName(ids)
    return both.groupBy("chunk").applyInPandas(_assemble(vocab_path, digest, decoded), f"doc_id {kind}, n_tokens long, {out}")


def _piece_table(vocab_path: str) -> pa.Table:
    """(id, piece), bounded by the vocabulary."""
    pieces = splitter(vocab_path).pieces
    return pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.string())})


def _read(ids: np.ndarray, bounds: np.ndarray, pieces: pa.Table) -> list[str]:
    """The texts of runs of ids: a join of id to piece, in the order of the ids, pieces joined by one space."""
    out: list[str] = []
    first = 0
    while first < len(bounds) - 1:
        # some runs at a time, one at least
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + READ_IDS, "right")) - 1)
        a, b = int(bounds[first]), int(bounds[last])
        tokens = pa.table({"id": pa.array(ids[a:b], pa.int32()), "at": pa.array(np.arange(b - a), pa.int32())})
        joined = tokens.join(pieces, "id", join_type="left outer", use_threads=False).sort_by("at")["piece"]
        found = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], pa.string())
        out += pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds[first : last + 1] - a, pa.int32()), found), " ").to_pylist()
        first = last
    return out


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids), pieces joined by one space; null ids decode to an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _piece_table(vocab_path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            texts = _read(lists.flatten().to_numpy(), bounds, pieces)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
