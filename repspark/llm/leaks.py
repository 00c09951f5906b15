"""Evaluation texts inside training texts, by Wu-Manber multi-pattern search over words.

Every run of RUN consecutive words of an evaluation text is a pattern. A shift table over blocks of
two words tells how far the search window may jump; where the shift is 0 the block's bucket names
the patterns that end in it, and the words are compared directly. Documents are cut into lanes that
overlap by RUN - 1 words and all lanes of a batch advance together, so a very long text costs no more
than many short ones. The tables are built once, at the driver, and broadcast. The corpus isn't shuffled but for the
distinct pairs found. An evaluation set of more than PASS_WORDS words is searched in passes: the corpus is then cut
into words once, into a written table, and only one pass's tables are alive at a time.

Words are unbroken runs of letters and digits (Unicode L, N) after NFKC, without format characters
(Cf), in lower case. Null, empty and blank texts, and evaluation texts of fewer than RUN words, match
nothing. Repeated documents or items each get their own rows; the result is distinct.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.runtime import map_arrow, written

RUN = 12
BLOCK = 2
LANE = 256
#: Words of evaluation text that are broadcast at once; a larger set is searched in several passes.
PASS_WORDS = 2_000_000
_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower())


class WuManber:
    """Patterns of ``run`` words with their item; words are numbered from 1, 0 is any other word.

    A pattern is a place in the items' words, so the tables take 12 bytes for each of these and the vocabulary.
    """

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        self.number: dict[str, int] = {}
        number = self.number
        long = [(item, ws) for item, ws in items if len(ws) >= run]
        lengths = np.array([len(ws) for _, ws in long], dtype=np.int64)
        self.code = np.fromiter((number.setdefault(w, len(number) + 1) for _, ws in long for w in ws), dtype=np.int32, count=int(lengths.sum()))
        windows = lengths - run + 1
        ids = np.array([item for item, _ in long], dtype=np.int64)
        self.item = np.repeat(ids, windows)
        self.at = (np.arange(windows.sum()) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(windows) + windows, windows)).astype(np.int32)
        # shift table: for each block of the patterns, the distance from its last place to the pattern's end
        size = max(16, len(number) * 4)
        self.bits = int(size - 1).bit_length() + 2
        self.shift = np.full(1 << self.bits, run - BLOCK + 1, dtype=np.int32)
        for k in range(run - BLOCK + 1):
            np.minimum.at(self.shift, self._hash(self.code[self.at + k], self.code[self.at + k + 1]), run - BLOCK - k)
        # buckets by the hash of the last block, patterns in bucket order
        last = self._hash(self.code[self.at + run - 2], self.code[self.at + run - 1])
        order = np.argsort(last, kind="stable")
        self.at, self.item = self.at[order], self.item[order]
        self.start = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """Distinct (number of the text, item) pairs."""
        run, get = self.run, self.number.get
        if not len(self.item):
            return []
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        code = np.fromiter((get(w, 0) for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        # a lane is a stretch of window ends: its windows lie wholly in one text
        ends = np.maximum(lengths - run + 1, 0)
        lanes = -(-ends // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = first[text] + run - 1 + within * LANE
        stop = np.minimum(pos + LANE, first[text] + lengths[text])
        found: set[tuple[int, int]] = set()
        while len(pos):
            h = self._hash(code[pos - 1], code[pos])
            jump = self.shift[h]
            # an unknown word in the block rules out every window that holds it
            jump = np.where(code[pos] == 0, run, np.where(code[pos - 1] == 0, run - 1, jump))
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                lo, hi = self.start[h[hit]], self.start[h[hit] + 1]
                n = hi - lo
                lane = np.repeat(hit, n)
                cand = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(lane), 1 << 17):
                    l, c = lane[a : a + (1 << 17)], cand[a : a + (1 << 17)]
                    same = (code[pos[l][:, None] + np.arange(1 - run, 1)] == self.code[self.at[c][:, None] + np.arange(run)]).all(axis=1)
                    found.update(zip(text[l[same]].tolist(), self.item[c[same]].tolist()))
            pos = pos + np.maximum(jump, 1)
            go = pos < stop
            pos, stop, text = pos[go], stop[go], text[go]
        return sorted(found)


def _passes(items: DataFrame, item_col: str, text_col: str, run: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The evaluation set in parts of at most about PASS_WORDS words; one part is at the driver at a time."""
    part, held = [], 0
    for r in items.select(item_col, text_col).toLocalIterator():
        ws = words(r[1])
        # an overlong item is cut into pieces that share run - 1 words, so every run of it stays whole
        for a in range(0, max(1, len(ws) - run + 1), PASS_WORDS):
            piece = ws[a : a + PASS_WORDS + run - 1]
            if held and held + len(piece) > PASS_WORDS:
                yield part
                part, held = [], 0
            part.append((r[0], piece))
            held += len(piece)
    if part:
        yield part


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, its words joined by spaces), about a million characters a batch."""
    for b in batches:
        for a, texts in _slices(b):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.array([" ".join(words(t)) for t in texts], pa.string())], names=["d", "w"])


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of parts of a batch of about a million characters, or of one longer text."""
    a = 0
    while a < b.num_rows:
        held, size, start = [], 0, a
        while a < b.num_rows and (not held or size < 1_000_000):
            held.append(b.column(1)[a].as_py())
            size += len(held[-1] or "")
            a += 1
        yield start, held


def _search(shared, cut, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in batches:
            for a, texts in _slices(b):
                got = tables.search([cut(t) for t in texts])
                if got:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([a + d for d, _ in got])), pa.array([i for _, i in got], pa.int64())], names=names)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, run: int = RUN, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: the pairs that share a run of at least ``run`` words."""
    spark = docs.sparkSession
    names, schema = [doc_col, item_col], f"{doc_col} bigint, {item_col} bigint"
    corpus, cut = docs.select(F.col(doc_col).cast("bigint"), F.col(text_col).cast("string")), words
    parts = _passes(items, item_col, text_col, run)
    part = next(parts, None)
    if part is None:
        return spark.createDataFrame([], schema)
    then = next(parts, None)
    if then is None:
        return map_arrow(corpus, _search(spark.sparkContext.broadcast(WuManber(part, run)), cut, names), schema).distinct()
    corpus, cut = written(map_arrow(corpus, _tokens, "d bigint, w string"), "words"), str.split
    found = []
    while part is not None:
        tables = spark.sparkContext.broadcast(WuManber(part, run))
        found.append(written(map_arrow(corpus, _search(tables, cut, names), schema), "leaks"))
        tables.destroy()
        part, then = then, next(parts, None)
    return reduce(DataFrame.unionByName, found).distinct()
