"""Connected components by alternating large and small stars, as joins and aggregates.

Up to ``LOCAL_EDGES`` edges, a count checked first, one task finds them in memory (two numbers an edge);
the rounds of joins would cost more to plan and start than to run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import tidied
from corvane.plans.scratch import materialize, release

LOCAL_EDGES = 1_000_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, label) of the nodes of edges: roots hook onto the smaller root, then paths are shortened."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(ids))
    a, b = place[: len(u)], place[len(u) :]
    while len(a):
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


@tidied
def _label_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if parts:
        yield pa.RecordBatch.from_arrays([*map(pa.array, labels(*(np.concatenate(x) for x in zip(*parts))))], names=["id", "label"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, label) of every node of ``edges`` (u, v): ``label`` is the smallest id of its component.

    More than ``local`` edges are settled in rounds.  Each round links nodes to the smallest neighbour they know; it ends when nothing moves, after a
    number of rounds logarithmic in the length of the longest chain.  The smallest neighbours are
    written before they are joined, so both sides of the join come from an exchange and a hub, one
    row on that side, can have its edges split over tasks.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    if now.count() <= local:
        return now.coalesce(1).mapInArrow(_label_all, "id bigint, label bigint")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: below each node, all smaller neighbours go to the smallest
        large = materialize(large, "large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        later = materialize(small.where("u != v").distinct(), "edges")
        release(now, low, large)
        now, before, state = later, state, _state(later)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
