"""Byte-level BPE with a public vocabulary, by a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds the rank of the pair that begins at a symbol, each inner node the lower
rank of its children, the left one on a tie, so the root gives the leftmost pair of lowest rank. A
merge changes at most three leaves; a piece of n bytes takes O(n log n) whatever its length.

Null and empty texts give an empty list; no special tokens are added and their strings in a text
are ordinary text. Repeated rows are encoded as they stand.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.runtime import map_arrow

#: Fixed value: how texts are cut into pieces before merging, for vocabularies of this kind.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to CACHE_BYTES are kept per worker, at most CACHE_PIECES of them.
CACHE_BYTES, CACHE_PIECES = 64, 400_000
_NONE = 1 << 60


class SegmentTreeBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PIECES).findall

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        n = len(piece)
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if n < 2:
            return (self.single[piece[0]],) if n else ()
        ranks = self.ranks
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = size.bit_length()
        # a node is rank << shift | position, so the lower is the lower rank, then the one further left
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        # symbol i covers piece[i:end[i]]; before[i] is the symbol to its left; a swallowed symbol has end -1
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        mask = (1 << shift) - 1
        while (best := tree[1]) != _NONE:
            i = best & mask
            j = end[i]  # the right symbol begins where the left one ends
            stop = end[j]
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
            changed = [(j, _NONE)] if j < n - 1 else []
            r = ranks.get(piece[i : end[stop]]) if stop < n else None
            changed.append((i, _NONE if r is None else r << shift | i))
            k = before[i]
            if k >= 0:
                r = ranks.get(piece[k:stop])
                changed.append((k, _NONE if r is None else r << shift | k))
            for at, value in changed:
                at += size
                if tree[at] == value:
                    continue
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    value = a if a < b else b
                    if tree[at] == value:
                        break
                    tree[at] = value
                    at >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = self.merge(raw)
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


#: Largest vocabulary file that is sent to the executors.
VOCABULARY_BYTES = 64 << 20


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> SegmentTreeBPE:
    """The encoder of a vocabulary file's content: lines of a token in base64 and its rank."""
    return SegmentTreeBPE({base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())})


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row; ``path`` is the vocabulary file, read by the driver and broadcast. No shuffle."""
    vocabulary = Path(path).read_bytes()
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for b in batches:
            # lists of one batch go out in slices, so that very long texts don't pile up
            texts, start, held, size = b.column(1), 0, [], 0
            for i in range(b.num_rows):
                held.append(encode(texts[i].as_py()))
                size += len(held[-1])
                if size > 1_000_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(held)), pa.array(held, pa.list_(pa.int32()))], names=[id_col, "ids"])
                    start, held, size = i + 1, [], 0

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(rows, run, f"{id_col} {rows.schema[0].dataType.simpleString()}, ids array<int>")
