"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.corpus import table

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

#: A side of a join is broadcast up to so many rows of a few numbers or hashes each; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(col: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have in any case, one for each stem."""
    own, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def sized(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side``, a written table of slim rows, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the bounds of the groups, from batches sorted by the integer columns ``keys``.

    Only the last group of a batch is held until the next batch comes.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held is not None:
            table = pa.concat_tables([held, table])
        cuts = _bounds(table, keys)
        held = table.slice(int(cuts[-2]))
        if len(cuts) > 2:
            yield table.slice(0, int(cuts[-2])), cuts[:-1]
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _bounds(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        a = table.column(k).to_numpy()
        new |= a[1:] != a[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def tidy() -> None:
    """Gives memory that is no longer used back to the system: Python workers wait for later tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(run: Callable) -> Callable:
    """``run``, a function over the batches of a task, that tidies up at the task's end."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole
