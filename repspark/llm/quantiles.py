"""Percentiles of very large columns from mergeable buffers of equal size.

A sketch is a set of sorted buffers. A buffer of level l > 0 holds exactly K values of weight 2^l;
values of weight 1 are kept as they are until K of them fill a buffer of level 0. Two full buffers
of one level collapse into one of the next: of their 2K values in order, every second one stays.
Merging sketches puts their buffers together and collapses by level, as a binary tree does, so the
order of merging doesn't matter for the bound.

Error: a collapse into weight W moves no rank by more than W / 2. Each buffer carries the sum of
these for all that went into it, so a sketch knows its own bound; with n values it is at most
n * log2(n / K) / (2 K), i.e. under 0.5 % of n for K = 4096 up to n = 2^52. A percentile is
the first value whose estimated rank reaches ceil(q * n); its true rank range lies within the bound
of that. Groups of under 2K values are exact.

Nulls, NaN and values outside [lowest, highest] are no measurements. A row without a group counts in
the total only, one without a time under a null day. Repeated rows and ties count as they stand. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.runtime import map_arrow

K = 4096
#: Values held per task before they are turned into buffers.
CHUNK = 1 << 20
#: Buffers of one group and day are merged in so many strands first, so that no task meets all of a hot group's.
STRANDS = 16
BUFFERS = "level int, error bigint, vals array<double>"


def collapse(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    """Every second of the values of two sorted buffers, beginning with the first or second."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[odd::2]


class Sketch:
    __slots__ = ("k", "raw", "held", "full", "error")

    def __init__(self, k: int = K):
        self.k, self.raw, self.held = k, [], 0
        self.full: dict[int, np.ndarray] = {}
        self.error = 0

    def add(self, level: int, values: np.ndarray, error: int = 0) -> None:
        """Put a buffer in: full if its level is above 0, else any number of values of weight 1."""
        self.error += error
        if level:
            self._carry(level, values)
            return
        self.raw.append(values)
        self.held += len(values)
        if self.held >= 2 * self.k:
            v = np.sort(np.concatenate(self.raw), kind="stable")
            m = len(v) // self.k
            # striding gives each buffer values from the whole range
            for i in range(m):
                self._carry(0, v[i : m * self.k : m])
            self.raw = [v[m * self.k :]]
            self.held = len(self.raw[0])

    def _carry(self, level: int, values: np.ndarray) -> None:
        while (other := self.full.pop(level, None)) is not None:
            level += 1
            self.error += 1 << (level - 1)  # half of the new weight
            # which one stays alternates with the sum of the levels met, so that errors don't all lean one way
            values = collapse(other, values, (self.error >> (level - 1)) & 1)
        self.full[level] = values

    def buffers(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, error, values); the error stands with the first."""
        error = self.error
        if self.held:
            yield 0, error, np.sort(np.concatenate(self.raw), kind="stable")
            error = 0
        for level, v in self.full.items():
            if level:
                yield level, error, v
            else:
                yield 0, error, v
            error = 0

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(v, 1 << level) for level, _, v in self.buffers()]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w, dtype=np.int64) for v, w in parts])
        order = np.argsort(values, kind="stable")
        return values[order], weights[order]

    def percentiles(self, permille: list[int]) -> tuple[int, list[float]]:
        """(number of values, the value at each q / 1000 by nearest rank)."""
        values, weights = self.weighted()
        cum = np.cumsum(weights)
        n = int(cum[-1])
        ranks = np.array([max(1, -(-q * n // 1000)) for q in permille])
        return n, values[np.searchsorted(cum, ranks, side="left")].tolist()


def _rows(keys: list[pa.Array], of: list[int], buffers: list[tuple[int, int, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Buffers as a batch; ``of`` gives the row of ``keys`` each belongs to."""
    take = pa.array(of, pa.int64())
    offsets = np.concatenate([[0], np.cumsum([len(b[2]) for b in buffers])]).astype(np.int32)
    vals = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([b[2] for b in buffers])))
    cols = [*[k.take(take) for k in keys], pa.array([b[0] for b in buffers], pa.int32()), pa.array([b[1] for b in buffers], pa.int64()), vals]
    return pa.RecordBatch.from_arrays(cols, names=[*names, "level", "error", "vals"])


def _codes(cols: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's key, and a row that has it."""
    code = np.zeros(len(cols[0]), dtype=np.int64)
    for c in cols:
        d = c.dictionary_encode("encode")
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse.reshape(-1), first


def _out(keys: list[pa.Array], of: list[int], buffers: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about a million values."""
    a = size = 0
    for i, b in enumerate(buffers):
        size += len(b[2])
        if size > CHUNK or i == len(buffers) - 1:
            yield _rows(keys, of[a : i + 1], buffers[a : i + 1], names)
            a, size = i + 1, 0


def _build(names: list[str], k: int):
    """Values -> buffers per key: small groups of a chunk leave as they are, large ones as collapsed buffers."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(n).combine_chunks() for n in names]
        values = t.column("v").to_numpy()
        code, first = _codes(keys)
        order = np.lexsort((values, code))
        values, code = values[order], code[order]
        edges = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]])
        of, buffers = [], []
        for g in range(len(edges) - 1):
            v = values[edges[g] : edges[g + 1]]
            if len(v) < 2 * k:
                of.append(int(first[g]))
                buffers.append((0, 0, v))
            else:
                s = Sketch(k)
                s.add(0, v)
                for b in s.buffers():
                    of.append(int(first[g]))
                    buffers.append(b)
        yield from _out(keys, of, buffers, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(names: list[str], k: int, finish=None):
    """Buffers sorted by key -> one sketch per key, as buffers or as what ``finish`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, key = None, None  # of the last group met, which may go on in the next batch
        done: list[tuple[tuple, Sketch]] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            if not done:
                return
            cols = [pa.array([d[0][i] for d in done], types[i]) for i in range(len(names))]
            if finish:
                yield finish(cols, [s for _, s in done])
            else:
                of, buffers = [], []
                for i, (_, s) in enumerate(done):
                    for b in s.buffers():
                        of.append(i)
                        buffers.append(b)
                yield from _out(cols, of, buffers, names)
            done.clear()

        types = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            types = [c.type for c in cols]
            levels, errors = b.column("level").to_numpy(), b.column("error").to_numpy()
            vals = b.column("vals")
            flat, offsets = vals.values.to_numpy(), vals.offsets.to_numpy()
            changed = np.zeros(b.num_rows, dtype=bool)
            for c in cols:
                d = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= d[1:] != d[:-1]
            changed[0] = True
            edges = [*np.flatnonzero(changed).tolist(), b.num_rows]
            for e, (lo, hi) in enumerate(zip(edges, edges[1:])):
                at = tuple(c[lo].as_py() for c in cols)
                if sketch is None or at != key:
                    if sketch is not None:
                        done.append((key, sketch))
                        size += 1 + sketch.held + k * len(sketch.full)
                        if size > CHUNK:
                            yield from emit()
                            size = 0
                    sketch, key = Sketch(k), at
                if not levels[lo:hi].any():
                    sketch.add(0, flat[offsets[lo] : offsets[hi]], int(errors[lo:hi].sum()))
                else:
                    for i in range(lo, hi):
                        sketch.add(int(levels[i]), flat[offsets[i] : offsets[i + 1]], int(errors[i]))
        if sketch is not None:
            done.append((key, sketch))
        yield from emit()

    return run


def _merged(buffers: DataFrame, names: list[str], k: int, finish=None, schema: str = "") -> DataFrame:
    kinds = ", ".join(f"`{n}` {buffers.schema[n].dataType.simpleString()}" for n in names)
    # sorted by content too: in whatever order a shuffle brings the buffers, they are merged in one
    rows = buffers.select(*names, "level", "error", "vals").repartition(*names).sortWithinPartitions(*names, "level", F.xxhash64("vals"))
    return map_arrow(rows, _merge(names, k, finish), f"{kinds}, {schema or BUFFERS}")


def daily_sketches(df: DataFrame, value: str, group: str, at: str, lowest: float, highest: float, k: int = K) -> DataFrame:
    """(grp, day, strand, level, error, vals): the partial results of each load day, in any number of strands.

    Appending another day's rows to those kept, or the same day's late rows, is all it takes to combine them.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(group).alias("grp"), F.to_date(F.col(at)).alias("day"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & v.between(lowest, highest))
    built = map_arrow(rows, _build(["grp", "day"], k), f"grp {rows.schema['grp'].dataType.simpleString()}, day date, {BUFFERS}")
    # small groups come together in strand 0; what a large group's tasks give is spread
    strand = F.when((F.col("level") == 0) & (F.size("vals") * STRANDS < k), F.lit(0)).otherwise(F.pmod(F.spark_partition_id(), F.lit(STRANDS)))
    return _merged(built.withColumn("strand", strand), ["grp", "day", "strand"], k)


def _finisher(permille: list[int], names: list[str]):
    def finish(cols: list[pa.Array], sketches: list[Sketch]) -> pa.RecordBatch:
        got = [s.percentiles(permille) for s in sketches]
        extra = [pa.array([n for n, _ in got], pa.int64()), pa.array([s.error for s in sketches], pa.int64())]
        extra += [pa.array([p[i] for _, p in got], pa.float64()) for i in range(len(permille))]
        return pa.RecordBatch.from_arrays([*cols, *extra], names=[*names, "n_values", "rank_error", *[f"q{q}" for q in permille]])

    return finish


def group_percentiles(sketches: DataFrame, permille: list[int], k: int = K) -> DataFrame:
    """(grp, n_values, rank_error, q50, ...) of each non-null group over all days."""
    schema = "n_values bigint, rank_error bigint, " + ", ".join(f"q{q} double" for q in permille)
    rows = sketches.where(F.col("grp").isNotNull())
    strands = _merged(rows.withColumn("strand", F.when(F.col("level") == 0, 0).otherwise(F.pmod(F.hash("day", "strand"), F.lit(STRANDS)))), ["grp", "strand"], k)
    return _merged(strands, ["grp"], k, _finisher(permille, ["grp"]), schema)


def total_percentiles(sketches: DataFrame, permille: list[int], k: int = K) -> DataFrame:
    """(n_values, rank_error, q50, ...) of all rows, one row, or none if there is no value.

    Each task merges what it reads, then groups of tasks are merged, then those.
    """
    schema = "n_values bigint, rank_error bigint, " + ", ".join(f"q{q} double" for q in permille)
    one = map_arrow(sketches.select(F.lit(0).alias("strand"), "level", "error", "vals"), _merge(["strand"], k), f"strand int, {BUFFERS}")
    few = _merged(one.withColumn("strand", F.pmod(F.spark_partition_id(), F.lit(4 * STRANDS))), ["strand"], k)
    return _merged(few.withColumn("strand", F.lit(0)), ["strand"], k, _finisher(permille, ["strand"]), schema).drop("strand")
