"""The N best items of each group, by a mergeable aggregation that holds at most N rows per group.

``Heaps`` keeps of each group the N best rows met so far, as an ordered table over Arrow batches. Each task builds
them before the shuffle, so of a group with millions of items at most N a task travel; after it they are merged.

Order: score descending, then item ascending as a binary string, so the result is the same at each
run. Rows with a null group, a null item, or a null or NaN score are left out. Repeated rows of one
item must be resolved first (``latest_per_item``). A group with fewer than N items gives what it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.runtime import map_arrow

#: Rows held before all but the best N of each group are let go.
HELD = 1 << 18
_ORDER = [("g", "ascending"), ("s", "descending"), ("i", "ascending")]


def latest_per_item(df: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """(group, item, score): of each item the score of its latest row, null and NaN included.

    A row without a time is the earliest. Among rows of one item and time the highest score stands
    (NaN above all, null below), so copies count once. One shuffle, with the copies of a task met before it.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.struct(F.col(at).cast("timestamp_ntz").alias("t"), F.col(score).alias("s")).alias("r")).where(F.col("g").isNotNull() & F.col("i").isNotNull())
    return rows.groupBy("g", "i").agg(F.max("r").alias("r")).select(F.col("g").alias(group), F.col("i").alias(item), F.col("r.s").alias(score))


class Heaps:
    """The ``n`` best rows (g, i, s) of every group among those put in."""

    def __init__(self, n: int):
        self.n = n
        self.held: list[pa.RecordBatch] = []
        self.size = self.kept = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.size += batch.num_rows
        if self.size > 2 * self.kept + HELD:
            self.prune()

    def prune(self) -> pa.RecordBatch | None:
        """The rows kept, by group and place, whose places are then in ``place``."""
        if not self.held:
            return None
        t = pa.Table.from_batches(self.held)
        t = t.take(pc.sort_indices(t, _ORDER)).combine_chunks()
        g = t.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(g, prepend=-1))
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        kept = place < self.n
        best = t.filter(pa.array(kept)).combine_chunks().to_batches()[0]
        self.held, self.size, self.kept = [best], best.num_rows, best.num_rows
        self.place = place[kept] + 1
        return best

    def placed(self) -> pa.RecordBatch:
        """The rows kept with their place from 1."""
        best = self.prune()
        return pa.RecordBatch.from_arrays([*best.columns, pa.array(self.place, pa.int32())], names=[*best.schema.names, "place"])


def _before(n: int):
    """Heaps of a task; so many groups that their heaps alone fill it are sent on and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(n)
        for b in batches:
            if b.num_rows:
                heaps.add(b)
            if heaps.kept > 4 * HELD:
                yield heaps.prune()
                heaps = Heaps(n)
        if heaps.held:
            yield heaps.prune()

    return run


def _after(n: int):
    """Heaps merged, of rows that come sorted by group: all groups but the last of a batch are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, last = Heaps(n), None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g")
            whole = b.num_rows - int(pc.sum(pc.equal(g, g[-1])).as_py())
            if whole or (last is not None and g[0].as_py() != last):
                if whole:
                    heaps.add(b.slice(0, whole))
                yield heaps.placed()
                heaps = Heaps(n)
            heaps.add(b.slice(whole))
            last = g[-1].as_py()
        if heaps.held:
            yield heaps.placed()

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, place): the first ``n`` items of each group, place from 1."""
    fit = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = fit.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))
    heaps = map_arrow(rows, _before(n), rows.schema).repartition("g").sortWithinPartitions("g")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    best = map_arrow(heaps, _after(n), f"{kinds}, place int")
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
