"""References to records that do not exist, were deleted, or arrived later.

Parent keys are range-partitioned together with the references; each task stores the parents of
its range as sorted arrays of fixed-width keys and probes reference batches by binary search.

A reference is an orphan unless some parent row with exactly its key was registered at or before
its time and is not deleted or deleted after it. Nulls: a reference with a null key is none; a
reference without a time, or a parent without a registration time, matches nothing. Repeated
parents and references are harmless (the result is distinct). Empty parents make every reference
an orphan. Keys longer than KEY_BYTES are compared by prefix and SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repspark.operators.heavy_keys import detect_heavy
from repspark.runtime import map_arrow

KEY_BYTES = 96
_NEVER = np.iinfo(np.int64).max


def composite_key(*parts: Column) -> Column:
    """One string for several key parts that no other parts can give; null if any part is null."""
    out = F.lit("")
    for p in parts[:-1]:
        out = F.concat(out, F.length(p).cast("string"), F.lit(":"), p)
    return F.concat(out, parts[-1])


def bounded_key(key: Column) -> Column:
    short = F.octet_length(key) <= KEY_BYTES
    return F.when(short, key).otherwise(F.concat(F.substring(key, 1, 8), F.lit("\u0001"), F.sha2(key, 256)))


def _fixed(keys: pa.Array, times: np.ndarray, width: int) -> np.ndarray:
    """Keys and times as byte strings whose order is that of (padded key, length, time)."""
    n = len(keys)
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + n + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
    lens = np.diff(offsets)
    out = np.zeros((n, width + 10), dtype=np.uint8)
    if n:
        starts = offsets[:-1] - offsets[0]
        out[np.repeat(np.arange(n), lens), np.arange(len(data)) - np.repeat(starts, lens)] = data
        out[:, width : width + 2] = lens.astype(">u2").view(np.uint8).reshape(n, 2)
        out[:, width + 2 :] = (times.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
    return out.reshape(-1).view(f"S{width + 10}")


class _Parents:
    """Sorted arrays of one range: key and registration time, and the latest end seen so far per key."""

    def __init__(self, keys: pa.Array, since: np.ndarray, until: np.ndarray):
        order_key = _fixed(keys, since, KEY_BYTES)
        order = np.argsort(order_key, kind="stable")
        self.at = order_key[order]
        until = until[order]
        raw = self.at.view(np.uint8).reshape(len(order), -1) if len(order) else np.empty((0, KEY_BYTES + 10), np.uint8)
        head = np.ascontiguousarray(raw[:, : KEY_BYTES + 2])
        self.key = head.reshape(-1).view(f"S{KEY_BYTES + 2}")
        # running maximum of the end within each key: run over (key number, end) as a pair
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.until = _running_max(until, new)

    def has(self, keys: pa.Array, times: np.ndarray) -> np.ndarray:
        if not len(self.at) or not len(keys):
            return np.zeros(len(keys), dtype=bool)
        probe = _fixed(keys, times, KEY_BYTES)
        place = np.searchsorted(self.at, probe, side="right") - 1
        safe = np.maximum(place, 0)
        head = np.ascontiguousarray(probe.view(np.uint8).reshape(len(probe), -1)[:, : KEY_BYTES + 2]).reshape(-1).view(f"S{KEY_BYTES + 2}")
        return (place >= 0) & (self.key[safe] == head) & (self.until[safe] > times)


def _running_max(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running maximum that starts again wherever ``new`` is true."""
    if not len(values):
        return values
    ranks = np.unique(values, return_inverse=True)
    group = np.cumsum(new) - 1
    n = len(ranks[0])
    run = np.maximum.accumulate(group * n + ranks[1].reshape(-1))
    return ranks[0][run - group * n]


def _times(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents (tag 0) come first in a partition, then references (tag 1) in any order."""
    held: list[pa.RecordBatch] = []
    parents: _Parents | None = None

    def build() -> _Parents:
        if not held:
            return _Parents(pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64))
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        key = t.column("key").combine_chunks()
        until = t.column("until").combine_chunks()
        return _Parents(key, _times(t.column("since").combine_chunks()), until.cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False))

    for b in batches:
        tags = b.column("tag").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(tags, 1))
        if cut:
            held.append(b.slice(0, cut).select(["key", "since", "until"]))
        refs = b.slice(cut)
        if not refs.num_rows:
            continue
        if parents is None:
            parents = build()
        at = refs.column("since")
        known = at.is_valid().to_numpy(zero_copy_only=False)
        miss = ~(parents.has(refs.column("key"), _times(at)) & known)
        if miss.any():
            out = refs.filter(pa.array(miss))
            yield pa.RecordBatch.from_arrays([out.column(c) for c in ("src_table", "ref_field", "record_id", "since")], names=["src_table", "ref_field", "record_id", "at"])


def find_orphans(refs: DataFrame, parents: DataFrame, share: float = 0.005) -> DataFrame:
    """(src_table, ref_field, record_id, at) of every reference without a valid parent, repeated rows as they come.

    ``refs``: src_table, ref_field, record_id (bigint), key (string), at (timestamp).
    ``parents``: key (string), registered_at, deleted_at (timestamps).
    Keys that at least ``share`` of the references name are spread over several ranges; only their
    own parent rows are repeated there.
    """
    spark = refs.sparkSession
    r = refs.where(F.col("key").isNotNull()).select(
        F.lit(1).cast("byte").alias("tag"), bounded_key(F.col("key")).alias("key"), F.col("at").alias("since"), F.lit(None).cast(refs.schema["at"].dataType).alias("until"), "src_table", "ref_field", "record_id"
    )
    kind = refs.schema["at"].dataType
    p = parents.where(F.col("key").isNotNull() & F.col("registered_at").isNotNull()).select(
        F.lit(0).cast("byte").alias("tag"), bounded_key(F.col("key")).alias("key"), F.col("registered_at").cast(kind).alias("since"), F.col("deleted_at").cast(kind).alias("until"),
        F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("string").alias("ref_field"), F.lit(None).cast("bigint").alias("record_id"),
    )
    hot = [k for k, _ in detect_heavy(r, "key", share)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.lit(0)
    if hot:
        is_hot = F.col("key").isin(*hot)
        r = r.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("record_id", "since"), F.lit(n)).cast("int")).otherwise(salt))
        p = p.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(salt))))
    else:
        r, p = r.withColumn("salt", salt), p.withColumn("salt", salt)
    both = p.unionByName(r).repartitionByRange(n, "key", "salt").sortWithinPartitions("tag")
    return map_arrow(both.drop("salt"), _probe, f"src_table string, ref_field string, record_id bigint, at {kind.simpleString()}")


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """(src_table, ref_field, month, n_refs, n_orphans): distinct references and orphans per table, field and month of the reference."""
    month = F.date_format("at", "yyyy-MM").alias("month")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.select("src_table", "ref_field", "record_id", month).distinct().groupBy("src_table", "ref_field", "month").agg(F.count(F.lit(1)).alias(name))

    both = count(refs.where(F.col("key").isNotNull()), "n_refs").withColumn("n_orphans", F.lit(0).cast("bigint")).unionByName(count(orphans, "n_orphans").withColumn("n_refs", F.lit(0).cast("bigint")))
    return both.groupBy("src_table", "ref_field", "month").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_orphans").alias("n_orphans"))
