"""Tokens counted and listed by chunks of whole documents.

Units come side by side for each document, so that what is counted within a unit or a document is whole in
one chunk and adds up over chunks.  A chunk's words become numbers in the order of the words, its n-grams
numbers in the order of their words; each figure is one sort of such numbers.  Only chunk totals and finished
postings leave, never a row for each token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.tokens import tokenize

#: A chunk ends with the document that fills it to so many tokens; three numbers of a chunk then fit into one of 63 bits.
CHUNK = 1 << 20
_BITS, _ROWS = 21, 1 << 16


def dealt(units: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(document_id, unit_id, t): the tokens of units, each in ``form``, those of a document side by side in one task."""
    own = "document_id" if "document_id" in units.columns else "unit_id"
    rows = units.select(F.col(own).alias("document_id"), "unit_id", "text").repartition("document_id").sortWithinPartitions("document_id", "unit_id")
    t = tokenize(F.col("text"))
    return rows.select("document_id", "unit_id", (F.transform(t, form) if form else t).alias("t"))


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places in the order of (high, low), equal ones as they stand."""
    n = len(high)
    if max(n, int(high.max(initial=0)), int(low.max(initial=0))) >> _BITS:
        return np.lexsort((low, high))
    key = (high.astype(np.int64) << 2 * _BITS) | (low.astype(np.int64) << _BITS) | np.arange(n)
    key.sort()
    return key & ((1 << _BITS) - 1)


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns begin to differ from the row before."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _numbers(column: pa.Array, within: np.ndarray | None = None) -> np.ndarray:
    """Rows numbered so that neighbours with an equal value, and number ``within``, share one."""
    n = len(column)
    new = np.zeros(n, bool)
    if n > 1:
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
        new[1:] = ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
        if within is not None:
            new[1:] |= within[1:] != within[:-1]
    return np.cumsum(new)


class Chunk:
    """The tokens of whole documents, as numbers."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("t").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        known = lists.flatten().dictionary_encode()
        order = pc.sort_indices(known.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = known.dictionary.take(pa.array(order))
        self.code = rank[known.indices.to_numpy(zero_copy_only=False)] if len(rank) else np.empty(0, np.int64)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)  # within the row
        self.left = np.repeat(size, size) - self.at  # tokens of the row from here on
        self.documents, self.units = (rows.column(c).combine_chunks() for c in ("document_id", "unit_id"))
        doc = _numbers(self.documents)
        unit = _numbers(self.units, doc)
        self.twice = len(unit) > 0 and unit[-1] + 1 < len(unit)  # an id of several rows
        self.row, self.unit, self.doc = row, unit[row], doc[row]
        self._grams: dict[int, tuple] = {}

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, starts, number): the first tokens of the n-grams in the order of n-gram and place, where each different
        n-gram starts among them, and the number of the n-gram at each token, -1 where none starts."""
        if n not in self._grams:
            if n == 1:
                at, high, low = np.arange(len(self.code)), self.code, np.zeros(len(self.code), np.int64)
            else:
                at = np.flatnonzero(self.left >= n)
                high, low = self.grams(n - 1)[2][at], self.code[at + n - 1]
            by = _order(high, low)
            places, starts = at[by], _changes(high[by], low[by])
            number = np.full(len(self.code), -1, np.int64)
            number[places] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(places)))
            self._grams[n] = places, starts, number
        return self._grams[n]

    def text(self, places: np.ndarray, n: int, joiner: str) -> pa.Array:
        """The n-grams that start at ``places``."""
        parts = [self.words.take(pa.array(self.code[places + k])) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, joiner)

    def totals(self, n: int, joiner: str) -> pa.Table:
        """(gram, freq, units, docs) of each different n-gram."""
        places, starts, number = self.grams(n)
        unit, g = self.unit[places], number[places]
        of_unit, of_doc = (g[_changes(g, c)] for c in (unit, self.doc[places]))
        k = len(starts)
        columns = [self.text(places[starts], n, joiner), np.diff(starts, append=len(places)), np.bincount(of_unit, minlength=k), np.bincount(of_doc, minlength=k)]
        return pa.table([columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])], ["gram", "freq", "units", "docs"])

    def postings(self, n: int, joiner: str, chosen: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Postings in the order of n-gram, document and unit; with ``chosen`` of these n-grams, by number, only."""
        places, _, number = self.grams(n)
        if chosen is not None:
            places = places[np.isin(number[places], chosen)]
        g, unit = number[places], self.unit[places]
        if self.twice:
            by = np.lexsort((self.at[places], unit, g))
            places, g, unit = places[by], g[by], unit[by]
        starts = np.append(_changes(g, unit), len(places))
        for a in range(0, len(starts) - 1, _ROWS):
            own = starts[a : a + _ROWS + 1]
            first = places[own[:-1]]
            at = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(self.at[places[own[0] : own[-1]]], pa.int32()))
            row = pa.array(self.row[first])
            yield pa.RecordBatch.from_arrays(
                [self.text(first, n, joiner), self.units.take(row), self.documents.take(row), pa.array(np.diff(own), pa.int64()), at], names=["term", "unit_id", "document_id", "tf", "positions"]
            )

    def numbered(self, grams: list[str], n: int, joiner: str) -> np.ndarray:
        """The numbers of those of ``grams`` that the chunk has."""
        places, starts, _ = self.grams(n)
        found = pc.index_in(self.text(places[starts], n, joiner), value_set=pa.array(grams, pa.string()))
        return np.flatnonzero(~np.asarray(pc.is_null(found).to_numpy(zero_copy_only=False), bool))


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of whole documents, one held at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while len(batch):
            length = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            if size + length[-1] < most:
                break
            # the first document that begins after the chunk is full
            doc = batch.column(0)
            last = held[-1].column(0)[-1] if held else None
            begins = np.ones(len(batch), bool)
            begins[1:] = ~np.asarray(pc.fill_null(pc.equal(doc[1:], doc[:-1]), False).to_numpy(zero_copy_only=False), bool)
            begins[0] = bool(held) and doc[0].as_py() != last.as_py()
            full = size + np.append(0, length[:-1]) >= most
            # a chunk that would overflow ends before the document that overflows it
            cut = np.flatnonzero(begins & (full | (size + length >= most)))
            cut = cut if held else cut[cut > 0]
            if not len(cut):
                break
            if cut[0]:
                held.append(batch.slice(0, int(cut[0])))
            yield Chunk(pa.Table.from_batches(held))
            held, size, batch = [], 0, batch.slice(int(cut[0]))
        if len(batch):
            held.append(batch)
            size += int(pc.fill_null(pc.sum(pc.list_value_length(batch.column(2))), 0).as_py() or 0)
    if held:
        yield Chunk(pa.Table.from_batches(held))


def over(units: DataFrame, work: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """What ``work`` gives for each chunk of ``units``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield from work(chunk)

    return dealt(units, form).mapInArrow(run, schema)


def totals(units: DataFrame, sizes: tuple[int, ...] = (1,), joiner: str = " ", form: Callable[[Column], Column] | None = None) -> DataFrame:
    """(gram, freq, units, docs): the n-grams of each chunk, to be summed."""

    def work(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        for n in sizes:
            yield from chunk.totals(n, joiner).to_batches(_ROWS)

    return over(units, work, "gram string, freq bigint, units bigint, docs bigint", form)


POSTING = "term string, unit_id string, document_id string, tf bigint, positions array<int>"


def postings(units: DataFrame) -> DataFrame:
    """Postings of ``units``, each chunk a segment sorted by term, document and unit."""
    return over(units, lambda chunk: chunk.postings(1, " "), POSTING)


def gram_postings(units: DataFrame, grams: list[str], sizes: tuple[int, ...], joiner: str) -> DataFrame:
    """Postings of the n-grams ``grams``."""

    def work(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        for n in sizes:
            yield from chunk.postings(n, joiner, chunk.numbered(grams, n, joiner))

    return over(units, work, POSTING)


# --- n-grams of all sizes from one row for each place

_RUNS = "n bigint, gram string, freq bigint, units bigint, first_unit string"


def _suffixes(chunk: Chunk, most: int, first: int, with_units: bool) -> Iterator[pa.RecordBatch]:
    """Different words, and different runs of up to ``most`` words, which hold all shorter n-grams from ``first`` on as their beginnings.

    ``u2``, ``u3``, ... count the units that have the beginning of so many words here for the first time.
    """
    ids = chunk.units
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    new = np.zeros((most + 1, len(chunk.code)), np.int64)
    for n in range(1, most + 1) if with_units else ():
        places, _, number = chunk.grams(n)
        new[n, places[_changes(number[places], chunk.unit[places])]] = 1
    for k in (*((1,) if first == 1 else ()), *range(max(first, 2), most + 1)):
        places, _, number = chunk.grams(k)
        if 1 < k < most:
            places = places[chunk.left[places] == k]  # shorter ones stand at the end of a line
        if not len(places):
            continue
        starts = _changes(number[places])
        slim = [chunk.text(places[starts], k, " "), pa.array(np.full(len(starts), k, np.int64)), pa.array(np.diff(starts, append=len(places)), pa.int64())]
        if not with_units:
            yield from pa.table(slim, ["gram", "k", "freq"]).to_batches(_ROWS)
            continue
        add = lambda c: pa.array(np.add.reduceat(c, starts), pa.int64())
        units = [add(new[n][places]) for n in range(1, most + 1)]
        unit = ids.take(pa.array(order[np.minimum.reduceat(rank[chunk.row[places]], starts)]))
        out = pa.table([*slim, unit, *units], ["gram", "k", "freq", "first_unit", *(f"u{n}" for n in range(1, most + 1))])
        yield from out.to_batches(_ROWS)


def _beginnings(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(n, gram, freq, units, first_unit) of the n-grams in sorted suffixes; the last one of a batch waits for the next batch."""
    most, waiting = max(sizes), {}
    for batch in batches:
        if not len(batch):
            continue
        gram, k, freq = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        # without units, every n-gram has none of them
        unit = (batch.column(3) if batch.num_columns > 3 else pa.array([""] * len(batch))).dictionary_encode()
        counts = [c.to_numpy() for c in batch.columns[4:]] or [np.zeros(len(batch), np.int64)] * most
        order = pc.sort_indices(unit.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[unit.indices.to_numpy()]
        names = unit.dictionary.take(pa.array(order))
        words = pc.split_pattern(gram, " ")
        begin, flat = words.offsets.to_numpy()[:-1], words.values
        same = np.ones(len(batch), bool)
        same[0] = False
        for n in range(1, most + 1):
            has = k >= n
            word = flat.take(pa.array(np.where(has, begin + n - 1, begin)))
            same[1:] &= has[1:] & has[:-1] & np.asarray(pc.equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False), bool)
            if n not in sizes:
                continue
            rows = np.flatnonzero(k == 1 if n == 1 else k >= n)
            if not len(rows):
                continue
            # a row between two of one n-gram is none of less words: those sort before
            starts = np.flatnonzero(~same[rows]) if n > 1 else np.flatnonzero(~(same & np.append(False, k[:-1] == 1))[rows])
            starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
            head = gram.take(pa.array(rows[starts]))
            text = head if n in (1, most) else pc.binary_join(pc.list_slice(pc.split_pattern(head, " ", max_splits=n), 0, n), " ")
            f, u = np.add.reduceat(freq[rows], starts), np.add.reduceat(counts[n - 1][rows], starts)
            first = names.take(pa.array(np.minimum.reduceat(at[rows], starts)))
            if n in waiting:
                was = waiting.pop(n)
                if was[0] == text[0].as_py():
                    f[0], u[0] = f[0] + was[1], u[0] + was[2]
                    first = pa.concat_arrays([pa.array([min(was[3], first[0].as_py(), key=str.encode)], first.type), first[1:]])
                else:
                    yield n, pa.array([was[0]], text.type), np.array([was[1]]), np.array([was[2]]), pa.array([was[3]], first.type)
            waiting[n] = text[-1].as_py(), int(f[-1]), int(u[-1]), first[-1].as_py()
            yield n, text[:-1], f[:-1], u[:-1], first[:-1]
    for n, was in waiting.items():
        yield n, pa.array([was[0]]), np.array([was[1]]), np.array([was[2]]), pa.array([was[3]])


def _sorted_suffixes(units: DataFrame, sizes: tuple[int, ...], with_units: bool = True) -> DataFrame:
    most, first = max(sizes), min(sizes)
    counts = [f"u{n}" for n in range(1, most + 1)]
    schema = "gram string, k bigint, freq bigint" + (", first_unit string, " + ", ".join(f"{c} bigint" for c in counts) if with_units else "")
    rows = over(units, lambda chunk: _suffixes(chunk, most, first, with_units), schema)
    # by the first two words: a frequent word is many tasks
    return rows.repartition(F.substring_index("gram", " ", 2)).sortWithinPartitions("gram")


def grams(units: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(n, gram, freq, units, first_unit) of the n-grams of all ``sizes``: one row for each place of a text is moved and sorted, for all sizes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, gram, freq, held, first in _beginnings(batches, sizes):
            columns = [pa.array(np.full(len(gram), n, np.int64)), gram.cast(pa.string()), pa.array(freq, pa.int64()), pa.array(held, pa.int64()), first.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "gram", "freq", "units", "first_unit"])

    return _sorted_suffixes(units, sizes).mapInArrow(run, _RUNS)


def gram_summary(units: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(n, total, unique_ngrams, singletons) of the n-grams of all ``sizes``; no n-gram leaves the task that counts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: np.zeros(3, np.int64) for n in sizes}
        for n, _, freq, _, _ in _beginnings(batches, sizes):
            found[n] += (freq.sum(), len(freq), (freq == 1).sum())
        held = [n for n in sizes if found[n][1]]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array([int(found[n][i]) for n in held], pa.int64()) for i in range(3))], names=["n", "total", "unique_ngrams", "singletons"])

    part = _sorted_suffixes(units, sizes, with_units=False).mapInArrow(run, "n bigint, total bigint, unique_ngrams bigint, singletons bigint")
    return part.groupBy("n").agg(*(F.sum(c).alias(c) for c in ("total", "unique_ngrams", "singletons")))
