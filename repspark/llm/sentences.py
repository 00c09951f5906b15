"""Sentence units of texts in any language, by a hidden-event n-gram language model.

A text is first cut into blocks at blank lines. Lists and pasted records give one sentence per line. In running text
``sentence_places`` tells between which words a boundary token may stand. The model is an n-gram over
words and boundary tokens: P(event | the two words before, and whether a boundary stands before the
last of them) and P(next word | event), each interpolated with word shapes. Forward and backward sums
along each block give each place's posterior, and a boundary stands where it is above one half.

The model is trained here, without labels, on all texts: the ends and beginnings of blocks are known
boundaries, all other places are hidden and filled in by expectation maximisation. Contexts are hashed
into tables of 2^BITS cells, so the model has one size however large the corpus is. Texts are parsed
once into a written table of places; the iterations and the decision read only that.

Null, empty and blank texts have no sentences. Repeated rows give their sentences again. A text of any
length is one row; its places are held as arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.llm.sentence_places import CELLS, COLS, END, HIDDEN, KINDS, L1, L2, R1, R2, START, parse
from repspark.runtime import map_arrow, written

ITERATIONS = 3
#: Texts are parsed together up to about so many characters.
CHARACTERS = 1_000_000
PARSED = "doc_id bigint, seg_start array<int>, seg_end array<int>, " + ", ".join(f"`{c}` array<int>" for c in COLS)


def _lists(doc: np.ndarray, n: int, columns: list[np.ndarray]) -> list[pa.Array]:
    """A list column of each array of values, whose texts ``doc`` (in order) tells."""
    offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in columns]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        a = 0
        while a < b.num_rows:
            held, size, start = [], 0, a
            while a < b.num_rows and (not held or size < CHARACTERS):
                held.append(texts[a].as_py())
                size += len(held[-1] or "")
                a += 1
            seg_doc, lo, hi, doc, cols = parse(held)
            if not len(seg_doc):
                continue
            # only texts that have segments; segments are numbered within their text
            there, number = np.unique(seg_doc, return_inverse=True)
            of = np.searchsorted(there, doc)
            first = np.searchsorted(number, np.arange(len(there)))
            cols["seg"] = cols["seg"] - first[of]
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)).take(pa.array(there)), *_lists(number, len(there), [lo, hi]), *_lists(of, len(there), [cols[c] for c in COLS])], names=["doc_id", "seg_start", "seg_end", *COLS])


class Places:
    """The places of a batch of parsed texts as flat arrays."""

    def __init__(self, b: pa.RecordBatch):
        get = lambda n: b.column(b.schema.get_field_index(n))
        for c in COLS:
            col = get(c)
            setattr(self, c, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.diff(get("seg").offsets.to_numpy())
        self.doc = np.repeat(np.arange(b.num_rows), counts)

    def once(self) -> np.ndarray:
        """The first place of each context in each text: what one text repeats is counted once."""
        key = np.zeros(len(self.doc), dtype=np.uint64)
        for c in (self.doc, self.kind, self.l3, self.l3b, self.l2, self.r3, self.r2):
            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out = np.zeros(len(key), dtype=bool)
        out[np.unique(key, return_index=True)[1]] = True
        return out


class Model:
    """Expected counts of boundaries and of all places, per context cell."""

    def __init__(self, counts: np.ndarray):
        self.b, self.n = counts[:, 0], counts[:, 1]
        known = slice(L1 * CELLS, (L1 + 1) * CELLS)
        self.prior = (self.b[known].sum() + 1) / (self.n[known].sum() + 2)
        r = slice(R1 * CELLS, (R1 + 1) * CELLS)
        self.r_b, self.r_nb = self.b[r].sum() + 1, (self.n[r] - self.b[r]).sum() + 1

    def event(self, l3: np.ndarray, l2: np.ndarray, l1: np.ndarray) -> np.ndarray:
        """P(boundary | words before)."""
        p = (self.b[l1] + 2 * self.prior) / (self.n[l1] + 2)
        p = (self.b[l2] + 3 * p) / (self.n[l2] + 3)
        p = (self.b[l3] + 3 * p) / (self.n[l3] + 3)
        return np.clip(p, 1e-5, 1 - 1e-5)

    def word(self, p: Places) -> tuple[np.ndarray, np.ndarray]:
        """P(next words | boundary), P(next words | none), but for a common factor: shape, word given shape, word after that given shape.

        Both are distributions over what comes next. Neither depends on the word before: pairs of words that stand together
        often would explain themselves, and a sentence that always follows another would be joined to it.
        """
        b1, n1 = self.b[p.r1], self.n[p.r1]
        pb = (b1 + 0.5) / (self.r_b + 1)
        nb = (n1 - b1 + 0.5) / (self.r_nb + 1)
        for r in (p.r2, p.r3):
            share = (self.n[r] + 0.5) / (n1 + 1)
            pb = pb * (self.b[r] + 4 * share) / (b1 + 4)
            nb = nb * (self.n[r] - self.b[r] + 4 * share) / (n1 - b1 + 4)
        return np.maximum(pb, 1e-12), np.maximum(nb, 1e-12)

    def posterior(self, p: Places) -> np.ndarray:
        """P(boundary) at each place, by forward and backward sums along each block, all blocks of the batch at once."""
        q = np.ones(len(p.doc))
        at = np.flatnonzero(p.kind == HIDDEN)
        if not len(at):
            return q
        e0 = self.event(p.l3[at], p.l2[at], p.l1[at])
        e1 = e0.copy()
        linked = np.flatnonzero(p.l3b[at] >= 0)
        e1[linked] = self.event(p.l3b[at[linked]], p.l2[at[linked]], p.l1[at[linked]])
        wb, wn = (w[at] for w in self.word(p))
        # blocks by number of places, most first; the k-th places of all blocks that have so many are one step
        key = np.flatnonzero(np.concatenate([[True], (np.diff(p.doc[at]) != 0) | (np.diff(p.seg[at]) != 0)]))
        size = np.diff(np.append(key, len(at)))
        order = np.argsort(-size, kind="stable")
        heads, size = key[order], size[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
        f = np.empty((len(at), 2))
        f[heads, 0], f[heads, 1] = (1 - e0[heads]) * wn[heads], e0[heads] * wb[heads]
        f[heads] /= f[heads].sum(axis=1, keepdims=True)
        for k in range(1, size[0]):
            i = heads[: alive[k]] + k
            before = f[i - 1]
            f[i, 1] = (before[:, 0] * e0[i] + before[:, 1] * e1[i]) * wb[i]
            f[i, 0] = (before[:, 0] * (1 - e0[i]) + before[:, 1] * (1 - e1[i])) * wn[i]
            f[i] /= f[i].sum(axis=1, keepdims=True)
        back = np.ones((len(at), 2))
        for k in range(size[0] - 1, 0, -1):
            i = heads[: alive[k]] + k
            v1, v0 = back[i, 1] * wb[i], back[i, 0] * wn[i]
            back[i - 1, 0], back[i - 1, 1] = e0[i] * v1 + (1 - e0[i]) * v0, e1[i] * v1 + (1 - e1[i]) * v0
            back[i - 1] /= back[i - 1].sum(axis=1, keepdims=True)
        g = f * back
        q[at] = g[:, 1] / g.sum(axis=1)
        return q


def first_guess(p: Places, ends: Model) -> np.ndarray:
    """Posterior before any iteration: how often blocks end in the word and begin with the next, against how often places show them."""
    q = ends.b[p.l2] / np.maximum(ends.n[p.l2], 1) / max(ends.rate, 1e-6)
    q1 = ends.b[p.l1] / np.maximum(ends.n[p.l1], 1) / max(ends.rate, 1e-6)
    few = 8 / (ends.n[p.l2] + 8)
    q = (1 - few) * np.clip(q, 0, 1) + few * np.clip(q1, 0, 1)
    r = ends.b[p.r2] / np.maximum(ends.n[p.r2], 1) / max(ends.start_rate, 1e-6)
    s = ends.b[p.r1] / np.maximum(ends.n[p.r1], 1) / max(ends.start_rate, 1e-6)
    few = 8 / (ends.n[p.r2] + 8)
    r = (1 - few) * np.clip(r, 0, 1) + few * np.clip(s, 0, 1)
    both = np.clip(q, 0.02, 0.98) * np.clip(r, 0.02, 0.98)
    neither = (1 - np.clip(q, 0.02, 0.98)) * (1 - np.clip(r, 0.02, 0.98))
    out = both / (both + neither)
    out[p.kind != HIDDEN] = 1.0
    return out


def _counter(model, first: bool):
    """Expected counts of a task's places under ``model`` (None: only what is known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.zeros(KINDS * CELLS)
        n = np.zeros(KINDS * CELLS)
        held, m = model.value if model is not None else None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = Places(batch)
            if held is None:
                q = (p.kind != HIDDEN).astype(float)
            else:
                m = m or (_ends(held) if first else Model(held))
                q = first_guess(p, m) if first else m.posterior(p)
            once = p.once()
            left, right = once & (p.kind != START), once & (p.kind != END)
            before = np.concatenate([[0.0], q[:-1]])
            l3 = np.where((p.l3b >= 0) & (p.kind == HIDDEN) & (before > 0.5), p.l3b, p.l3)
            for cells, use in ((l3, left), (p.l2, left), (p.l1, left), (p.r3, right), (p.r2, right), (p.r1, right)):
                b += np.bincount(cells[use], weights=q[use], minlength=KINDS * CELLS)
                n += np.bincount(cells[use], minlength=KINDS * CELLS)
        cell = np.flatnonzero(n)
        for a in range(0, len(cell), 100_000):
            c = cell[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(b[c]), pa.array(n[c])], names=["cell", "b", "n"])

    return run


def _ends(counts: np.ndarray) -> Model:
    """A model of known boundaries only, with the rates at which sure sentences stand at a block's edge."""
    m = Model(counts)
    l2 = slice(L2 * CELLS, (L2 + 1) * CELLS)
    often = (m.n[l2] >= 20) & (m.b[l2] > 0)
    ratio = np.sort(m.b[l2][often] / m.n[l2][often])
    m.rate = float(np.median(ratio)) if len(ratio) else 0.2
    r2 = slice(R2 * CELLS, (R2 + 1) * CELLS)
    often = (m.n[r2] >= 20) & (m.b[r2] > 0)
    ratio = np.sort(m.b[r2][often] / m.n[r2][often])
    m.start_rate = float(np.median(ratio)) if len(ratio) else 0.2
    return m


def train(parsed: DataFrame, iterations: int = ITERATIONS) -> np.ndarray:
    """The model's counts: (cells, 2), from all places. At most 6 * 2^BITS rows reach the driver at a time."""
    spark = parsed.sparkSession

    def count(model, first: bool) -> np.ndarray:
        rows = map_arrow(parsed.select(*COLS), _counter(model, first), "cell int, b double, n double").groupBy("cell").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        t = rows.toArrow()
        out = np.zeros((KINDS * CELLS, 2), dtype=np.float64)
        cell = t.column("cell").to_numpy()
        out[cell, 0], out[cell, 1] = t.column("b").to_numpy(), t.column("n").to_numpy()
        return out

    counts = count(None, False)
    for k in range(iterations):
        counts = count(spark.sparkContext.broadcast(counts), k == 0)
    return counts


def _decide(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            if not b.num_rows:
                continue
            m = m or Model(model.value)
            p = Places(b)
            cut = (p.kind == HIDDEN) & (m.posterior(p) > 0.5)
            starts, ends = b.column(b.schema.get_field_index("seg_start")), b.column(b.schema.get_field_index("seg_end"))
            per_doc = np.diff(starts.offsets.to_numpy())
            doc = np.concatenate([np.repeat(np.arange(b.num_rows), per_doc), p.doc[cut]])
            lo = np.concatenate([starts.flatten().to_numpy(), p.next[cut]])
            hi = np.concatenate([ends.flatten().to_numpy(), p.stop[cut]])
            # in each text the sorted starts and the sorted ends belong together
            by_lo, by_hi = np.lexsort((lo, doc)), np.lexsort((hi, doc))
            ids = b.column(0).take(pa.array(doc[by_lo]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lo[by_lo].astype(np.int64)), pa.array(hi[by_hi].astype(np.int64))], names=["doc_id", "sent_start", "sent_end"])

    return run


def _trained(docs: DataFrame, id_col: str, text_col: str, iterations: int):
    """The written table of places of all texts, and the broadcast model."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parsed = written(map_arrow(rows, _parse_batches, PARSED), "places")
    return parsed, docs.sparkSession.sparkContext.broadcast(train(parsed, iterations))


def find_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, sent_start, sent_end): the sentences of every text, in code points, end exclusive."""
    parsed, model = _trained(docs, id_col, text_col, iterations)
    return map_arrow(parsed, _decide(model), "doc_id bigint, sent_start bigint, sent_end bigint").withColumnRenamed("doc_id", id_col)


def doubtful_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(doc_id, place, posterior): the places that the model neither cuts nor keeps with certainty, at the beginning of what comes next."""
    parsed, model = _trained(docs, id_col, text_col, iterations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            m = m or Model(model.value)
            p = Places(b)
            q = m.posterior(p)
            at = np.flatnonzero((p.kind == HIDDEN) & (q > low) & (q < high))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(p.doc[at])), pa.array(p.next[at]), pa.array(q[at])], names=["doc_id", "place", "posterior"])

    return map_arrow(parsed, run, "doc_id bigint, place bigint, posterior double").withColumnRenamed("doc_id", id_col)
