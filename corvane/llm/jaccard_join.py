"""N-gram Jaccard self-join by chosen paths.

A text is the set of its 5-word shingles (words are runs without white space; a text of fewer words
is one shingle).  Equal sets are one node with a multiplicity, so copies never meet pairwise.

Each node has MinHash values (its sampled tokens) and a one-bit sketch.  A run puts nodes into
buckets by one sampled token; two sets of similarity s stay together with probability s per token.
Runs repeat until 1 - (1 - s)^runs reaches the target recall at s = 0.8.  Buckets of at most
``SMALL`` members are searched by brute force over sketches: from each node reached, the rest of the
bucket is compared, and who is close enough joins; members that are all alike cost one comparison
and one edge each.

A larger bucket first meets its pivots: in a sample of ``SAMPLE`` members, the leaders of the groups
that hold at least ``SHARE`` of it.  Each member is held against these few pivots where it stands, no
pairs.  Members near a pivot (``ALIKE``) get an edge to it and leave the bucket; members less near
(``LOOSE``) get an edge and stay, so whoever is linked to a member that left is tied to the same
pivot.  A bucket without such groups is unlike and is split by further sampled tokens, ``BRANCHES`` of
them.  After ``DEPTH`` such steps, whatever their outcome, what is still large is searched by brute
force in pairs of blocks of ``SMALL`` members, packed into one row each.  So the number of steps does
not depend on the data.

The edges give candidate components.  Inside a component exact similarities are counted from the
shingles themselves: components of up to ``BLOCK`` nodes in one place, larger ones in blocks of about
``BLOCK`` nodes that are packed into one row each; pairs of blocks meet, never rows of pairs, and a
task holds two blocks.  Tasks return each node's number of links and a spanning forest.  Components of
the true links are the classes.

Cases: a null text is empty; an empty text has no shingles, no links and a class of its own; very
long texts are read whole and count by their bytes when blocks are formed; null ids are linked like
others and sort last as class ids (a class of null ids only has a null ``class_id``); repeated rows are
copies of each other; ties between pivots fall by a hash; an empty table gives an empty result; other
columns are not read by ``links`` and pass through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, fresh, sized, tidied, whole_groups, whole_text
from corvane.llm.components import components
from corvane.plans.scratch import materialize, release

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
#: Members of a bucket that is searched by brute force; tokens an unlike bucket is split by; steps at most.
SMALL, BRANCHES, DEPTH = 2048, 3, 4
#: Nodes of a block and bytes of its shingles, one node at least.
BLOCK, BLOCK_BYTES = 1024, 24 << 20
TOKENS, WORDS64 = 32, 4
BITS = 64 * WORDS64
#: Equal sketch bits of a candidate: four deviations below the mean at the threshold.
_MEAN = (1 + SIMILARITY) / 2
CLOSE = math.floor(BITS * _MEAN - 4 * math.sqrt(BITS * _MEAN * (1 - _MEAN)))
#: Estimated similarity to a pivot from which a member leaves the bucket, from which it gets an edge, and
#: the share of the sample that must leave for a pivot to be taken; members of a sample, on average.
ALIKE, LOOSE, SHARE, SAMPLE = 0.65, 0.45, 0.15, 64
MEMORY_WORDS = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
_known: dict[str, int] = {}
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, BITS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BITS, dtype=np.uint32)
_SKETCH = [f"s{i}" for i in range(WORDS64)]


def runs_for(recall: float, similarity: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity) - 1e-9)


def _hash(word: str) -> int:
    n = _known.get(word)
    if n is None:
        if len(_known) > MEMORY_WORDS:
            _known.clear()
        n = _known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return n


def shingles(text: str) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = _WORD(text)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _minima(s: np.ndarray) -> np.ndarray:
    low = np.full(BITS, 0xFFFFFFFF, np.uint32)
    h = ((s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * _A + _B
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sid, size, tokens, sketch words) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "sid", "size", "tokens", *_SKETCH]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, tokens, sketches = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                low = _minima(s)
                sids.append(_set_id(s))
                sizes.append(len(s))
                tokens.append(low[:TOKENS].view(np.int32))
                bits = (low * np.uint32(0x85EBCA6B)) >> np.uint32(31)
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            words = np.array(sketches, np.int64).reshape(-1, WORDS64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int32())),
                 *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS64))],
                names=names,
            )

    slim = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, f"doc_id {kind}, text_hash bigint, sid binary, size int, tokens array<int>, " + ", ".join(f"{c} bigint" for c in _SKETCH))


def _search(sizes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the candidate graph of one bucket, as places."""
    rest, u, v = np.arange(len(sizes)), [], []
    queue: list[int] = []
    root = 0
    while len(rest):
        if not queue:
            root, rest = int(rest[0]), rest[1:]
            queue.append(root)
        pivot = queue.pop()
        if not len(rest):
            continue
        even = BITS - np.bitwise_count(sketches[rest] ^ sketches[pivot]).sum(axis=1, dtype=np.int32)
        small, large = np.minimum(sizes[rest], sizes[pivot]), np.maximum(sizes[rest], sizes[pivot])
        hit = (even >= CLOSE) & (small >= SIMILARITY * large - 1e-9)
        found = rest[hit]
        rest = rest[~hit]
        queue.extend(found.tolist())
        u.append(found)
        v.append(np.full(len(found), root))
    return (np.concatenate(u), np.concatenate(v)) if u else (rest, rest)


@tidied
def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets in rows sorted by key; one bucket and one batch are held."""
    for table, cuts in whole_groups(batches, "key"):
        several = np.flatnonzero(np.diff(cuts) > 1)
        if not len(several):
            continue
        nid, sizes = table.column("nid").to_numpy(), table.column("size").to_numpy()
        sketches = _sketches(table)
        found = []
        for g in several:
            a, b = cuts[g], cuts[g + 1]
            x, y = _search(sizes[a:b], sketches[a:b])
            if len(x):
                found.append((nid[a:b][x], nid[a:b][y]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["u", "v"])


_ROW = ["nid", "size", *_SKETCH]
_PIVOTS = f"key bigint, pivots array<struct<nid: bigint, size: int, {', '.join(f'{c}: bigint' for c in _SKETCH)}>>"


def _bits(similarity: float) -> float:
    """Equal sketch bits that a similarity makes on average."""
    return BITS * (1 + similarity) / 2


def _even(other: Column) -> Column:
    """Equal sketch bits of a row and of a pivot."""
    unlike = F.lit(0)
    for c in _SKETCH:
        unlike = unlike + F.bit_count(F.col(c).bitwiseXOR(other[c]))
    return F.lit(BITS) - unlike


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in _SKETCH], 1)


def _leaders(sizes: np.ndarray, sketches: np.ndarray) -> list[int]:
    """Places of a sample's pivots: who has most of the rest near, as long as that is a share of the sample."""
    even = BITS - np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2, dtype=np.int32)
    ratio = np.minimum(sizes[:, None], sizes[None]) / np.maximum(sizes[:, None], sizes[None])
    near = (even >= _bits(ALIKE)) & (ratio >= LOOSE)
    found: list[int] = []
    while True:
        took = near.sum(axis=1)
        best = int(took.argmax())
        if took[best] < max(2, SHARE * len(sizes)):
            return found
        found.append(best)
        gone = near[best].copy()
        near[gone] = False
        near[:, gone] = False


@tidied
def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots of each bucket that has some, from samples in rows sorted by key."""
    for table, cuts in whole_groups(batches, "key"):
        sizes, sketches, places, ends, keys = table.column("size").to_numpy(), _sketches(table), [], [0], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if found := _leaders(sizes[a:b], sketches[a:b]):
                places.extend(a + x for x in found)
                ends.append(len(places))
                keys.append(a)
        if keys:
            rows = table.select(_ROW).take(places).combine_chunks()
            rows = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in _ROW], names=_ROW)
            key = table.column("key").take(keys).combine_chunks()
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["key", "pivots"])


@tidied
def _pack_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed row for each block of a bucket, in rows sorted by (key, block)."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for table, cuts in whole_groups(batches, "key", "block"):
        nid, sizes, sketches = table.column("nid").to_numpy(), table.column("size").to_numpy(), _sketches(table)
        blobs = [pack(pickle.dumps((nid[a:b], sizes[a:b], sketches[a:b]), protocol=5)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        heads = table.select(["key", "block", "blocks"]).take(cuts[:-1]).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(heads.column(c).combine_chunks() for c in heads.column_names), pa.array(blobs, pa.binary())], names=["key", "block", "blocks", "blob"])


@tidied
def _pair_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within and between two blocks of a bucket, in rows sorted by (key, one, two)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for table, cuts in whole_groups(batches, "key", "one", "two"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            groups = [pickle.loads(unpack(x.as_py())) for x in table.column("blob").slice(a, b - a)]
            nid, sizes, sketches = (np.concatenate(x) for x in zip(*groups))
            x, y = _search(sizes, sketches)
            yield pa.RecordBatch.from_arrays([pa.array(nid[x]), pa.array(nid[y])], names=["u", "v"])


def _by_blocks(large: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(edges (u, v), a table to release) of buckets of ``m`` members each, all members against all."""
    rows = large.withColumn("blocks", F.ceil(F.col("m") / small).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("nid", "key"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.select("key", "block", "blocks", *_ROW).repartition("key", "block").sortWithinPartitions("key", "block")
    packed = materialize(rows.mapInArrow(_pack_sketches, "key bigint, block int, blocks int, blob binary"), "packed")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    pairs = pairs.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "blob")
    pairs = pairs.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return pairs.mapInArrow(_pair_edges, "u bigint, v bigint"), packed


def _candidate_edges(nodes: DataFrame, runs: int, small: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(spanning candidate edges (u, v) over all buckets of all runs, tables to release once they are written)."""
    keys = F.array(*(F.xxhash64(F.lit(r), F.element_at("tokens", r + 1)) for r in range(runs)))
    others = TOKENS - runs
    level = nodes.select(F.posexplode(keys).alias("run", "key"), F.slice("tokens", runs + 1, others).alias("others"), *_ROW)
    cold: list[DataFrame] = []
    edges: list[DataFrame] = []
    held: list[DataFrame] = []
    for step in range(depth + 1):
        hot = materialize(level.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > small), "hot")
        held.append(hot)
        n_hot = hot.count()
        if not n_hot:
            cold.append(level.select("key", *_ROW))
            break
        cold.append(level.join(sized(hot.select("key"), n_hot), "key", "left_anti").select("key", *_ROW))
        large = level.join(sized(hot, n_hot), "key")
        if step == depth:
            found, packed = _by_blocks(large, small)
            edges.append(found)
            held.append(packed)
            break
        sample = large.where(F.pmod(F.xxhash64("nid", "key", F.lit(step)), F.col("m")) < SAMPLE)
        sample = sample.select("key", *_ROW).repartition("key").sortWithinPartitions("key", "nid")
        pivots = materialize(sample.mapInArrow(_pivots, _PIVOTS), "pivots")
        ratio = lambda p: F.least("size", p["size"]) / F.greatest("size", p["size"])
        met = F.transform("pivots", lambda p: F.struct(p["nid"].alias("p"), _even(p).alias("even"), ratio(p).alias("ratio")))
        judged = large.join(sized(pivots, n_hot), "key", "left").withColumn("met", F.filter(met, lambda x: (x["even"] >= _bits(LOOSE)) & (x["ratio"] >= LOOSE)))
        near = F.coalesce(F.exists("met", lambda x: x["even"] >= _bits(ALIKE)), F.lit(False))
        judged = judged.select("key", "run", "others", *_ROW, F.col("met.p").alias("ties"), near.alias("near"), F.col("pivots").isNull().alias("split"))
        judged = materialize(judged, "judged")
        held += [pivots, judged]
        edges.append(judged.select(F.col("nid").alias("u"), F.explode("ties").alias("v")).where("u != v"))
        # unlike buckets fall apart by further tokens, others in each step and in each run
        first = F.pmod((F.col("run") + step) * BRANCHES, F.lit(others))
        place = [(F.pmod(first + j, F.lit(others)) + 1).cast("int") for j in range(min(BRANCHES, others))]
        apart = F.array(*(F.xxhash64("key", x, F.element_at("others", x)) for x in place))
        key = F.explode(F.when(F.col("split"), apart).otherwise(F.array("key"))).alias("key")
        level = judged.where(~F.col("near")).select("run", key, "others", *_ROW)
    every = cold[0]
    for more in cold[1:]:
        every = every.unionByName(more)
    found = every.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges, "u bigint, v bigint")
    for more in edges:
        found = found.unionByName(more)
    return found, held


def _sets(texts: DataFrame) -> DataFrame:
    """(sid, shingles) of texts."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_id, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "shingles"])

    return texts.select("text").mapInArrow(run, "sid binary, shingles binary")


def _overlaps(sets: list[np.ndarray], first: int = 0) -> np.ndarray:
    """Sizes of all intersections, from columns of shared shingles; with ``first``, of the first so many sets with the others."""
    n = len(sets)
    if n == 2 and not first:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, common], [common, 0]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    if first:
        left = np.bincount(number[owner < first], minlength=len(times))
        shared = ((left > 0) & (left < times))[number]
    else:
        shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    column = np.cumsum(np.append(0, number[1:] != number[:-1])) if len(number) else number
    out = np.zeros((first, n - first) if first else (n, n), np.int32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, min(4096, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += ((m[:first] @ m[first:].T) if first else (m @ m.T)).astype(np.int32)
    return out


def _verify(nid: np.ndarray, mult: np.ndarray, sets: list[np.ndarray], first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, smallest node that links lead to, number of links) of the nodes with links.

    With ``first``, only pairs between the first so many nodes and the others count.
    """
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets, first)
    one, two = (slice(0, first), slice(first, None)) if first else (slice(None), slice(None))
    near = both >= SIMILARITY * (size[one, None] + size[None, two] - both) - 1e-9
    if not first:
        np.fill_diagonal(near, False)
    links = np.zeros(len(nid), np.int64)
    links[one] = near @ mult[two]
    if first:
        links[two] = near.T @ mult[one]
    order = np.argsort(nid)
    label = np.empty(len(nid), np.int64)
    label[order] = np.arange(len(nid))  # by node number, so that the smallest label is the smallest node
    while True:
        low = label.copy()
        low[one] = np.where(near, label[None, two], len(nid)).min(axis=1)
        if first:
            low[two] = np.where(near, label[one, None], len(nid)).min(axis=0)
        new = np.minimum(label, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(links)
    return nid[linked], nid[order[label[linked]]], links[linked]


_FOUND = "nid bigint, root bigint, links bigint, label bigint, block int, blob binary"
_FOUND_ARROW = pa.schema([("nid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("block", pa.int32()), ("blob", pa.binary())])


def _results(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    nid, root, links = (np.concatenate(x) for x in zip(*parts))
    none = pa.nulls(len(nid))
    return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(root), pa.array(links), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_FOUND_ARROW)


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("shingles")]
    return table.column("nid").to_numpy(), table.column("mult").to_numpy(), sets


@tidied
def _verify_or_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of whole components; one packed row for each block of the others."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for table, cuts in whole_groups(batches, "label", "block"):
        done = []
        labels, blocks, counts = (table.column(c).to_numpy() for c in ("label", "block", "blocks"))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if counts[a] > 1:
                blob = pack(pickle.dumps(_group(table.slice(a, b - a)), protocol=5))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([None], pa.int64()) for _ in range(3)), pa.array([labels[a]], pa.int64()), pa.array([blocks[a]], pa.int32()), pa.array([blob], pa.binary())], schema=_FOUND_ARROW
                )
            elif b - a > 1:
                done.append(_verify(*_group(table.slice(a, b - a))))
        if done:
            yield _results(done)


@tidied
def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of single blocks and of pairs of blocks, in rows sorted by (label, one, two)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for table, cuts in whole_groups(batches, "label", "one", "two"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            groups = [pickle.loads(unpack(x.as_py())) for x in table.column("blob").slice(a, b - a)]
            nid, mult = (np.concatenate([g[k] for g in groups]) for k in (0, 1))
            yield _results([_verify(nid, mult, [s for g in groups for s in g[2]], len(groups[0][0]) if len(groups) > 1 else 0)])


def _links_of_members(docs: DataFrame, nodes: DataFrame, groups: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """((nid, links), (nid, label)) of the nodes in candidate components: exact links and classes."""
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    member = groups.withColumnRenamed("id", "nid").join(sizes, "label").join(nodes.select("nid", "sid", "size", "one", "mult"), "nid")
    member = materialize(member, "members")
    n = member.count()
    # one row of the table for each node, found by its id and the hash of its text
    wanted = member.select(F.col("one.doc_id").alias("_i"), F.col("one.text_hash").alias("_h"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    texts = texts.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h")))
    weight = materialize(member.groupBy("label").agg(F.sum(F.col("size").cast("long") * 8).alias("bytes")), "weights")
    held = _sets(texts).dropDuplicates(["sid"]).join(member.select("sid", "nid", "label", "m", "mult"), "sid").join(sized(weight), "label")
    count = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    held = held.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks").cast("long")).cast("int"))
    held = held.select("label", "block", "blocks", "nid", "mult", "shingles").repartition("label", "block").sortWithinPartitions("label", "block")
    first = materialize(held.mapInArrow(_verify_or_pack, _FOUND), "verified")
    whole, packed = first.where("blob is null").select("nid", "root", "links"), first.where("blob is not null").select("label", "block", "blob")
    count = materialize(packed.groupBy("label").agg((F.max("block") + 1).alias("n")), "blocks")
    many = count.count()
    if not many:
        return whole.select("nid", "links"), whole.select("nid", F.col("root").alias("label"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    pairs = packed.join(sized(count, many), "label").withColumn("other", other)
    pairs = pairs.select("label", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "blob")
    pairs = pairs.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two")
    second = materialize(pairs.mapInArrow(_verify_blocks, _FOUND).select("nid", "root", "links"), "verified")
    classes = components(second.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    links = whole.select("nid", "links").unionByName(second.groupBy("nid").agg(F.sum("links").alias("links")))
    return links, whole.select("nid", F.col("root").alias("label")).unionByName(classes.withColumnRenamed("id", "nid"))


def links(docs: DataFrame, runs: int | None = None, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, class_size, n_links) of each row.

    ``n_links`` counts the other rows at similarity 0.8 or more, copies included; ``class_id`` is the
    smallest doc_id that links of any length lead to.
    """
    runs = runs or runs_for(RECALL, SIMILARITY)
    rows = materialize(_features(docs), "features")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    nodes = rows.where("size > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("mult"), one, *(F.first(c).alias(c) for c in ("size", "tokens", *_SKETCH)))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    edges, held = _candidate_edges(nodes, runs, small, depth)
    groups = materialize(components(edges), "groups")
    release(*held)
    found, classes = _links_of_members(docs, nodes, groups, block)
    release(groups)
    known = nodes.select("sid", "nid", "one.doc_id", "mult").join(found, "nid", "left").join(classes, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    known = materialize(known.withColumnRenamed("doc_id", "rep"), "known")
    per_class = materialize(known.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("mult").alias("class_size")), "classes")
    known = materialize(known.join(per_class, "label").select("sid", "class_id", "class_size", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    release(nodes, per_class)
    found = rows.select("doc_id", "sid").join(known, "sid", "left")
    alone = F.col("n_links").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows whose id is their class's smallest; rows with a null id stay, whatever their class."""
    found = materialize(links(docs, **options), "links")
    id_ = fresh(docs, "_id")[0]
    gone = found.where("doc_id is not null and doc_id != class_id").select(F.col("doc_id").alias(id_)).distinct()
    stay = found.where("doc_id = class_id").select(F.col("doc_id").alias(id_)).distinct()
    # an id that repeats with different texts stays if one of its rows is its class's
    gone = materialize(gone.join(stay, id_, "left_anti"), "gone")
    return docs.join(sized(gone), docs["doc_id"] == gone[id_], "left_anti")
