"""Translation and agreement of many strings at once, as numpy arrays over an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bases in the order of the standard genetic code, and its amino acids.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: 0 to 3 for a base, 64 for any other letter, so a codon with such a letter has a number above 63.
_NUMBER = np.full(256, 64, dtype=np.int16)
for _i, _b in enumerate(BASES):
    _NUMBER[[ord(_b), ord(_b.lower())]] = _i
_RESIDUE = np.full(64 * 21 + 1, ord("X"), dtype=np.uint8)
_RESIDUE[:64] = np.frombuffer(AMINO.encode(), np.uint8)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a string array; a null counts as empty."""
    col = col.cast(pa.string())
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def _strings(data: np.ndarray, lengths: np.ndarray, like: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    plain = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return plain if not like.null_count else pc.if_else(like.is_valid(), plain, pa.scalar(None, pa.string()))


def translate(col: pa.Array) -> pa.Array:
    """Amino acids of the whole codons; an unknown codon is X, a stop is *, null stays null. Letters outside ASCII are X each byte."""
    data, lengths = _flat(col)
    n = lengths // 3
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts, n) + 3 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    b = _NUMBER[data]
    code = b[at].astype(np.int32) * 16 + b[at + 1] * 4 + b[at + 2]
    return _strings(_RESIDUE[code], n, col)


def agreeing(a: pa.Array, b: pa.Array, upto: np.ndarray) -> np.ndarray:
    """Per pair: places among the first ``upto`` at which both agree; a null agrees in none."""
    (x, nx), (y, ny) = _flat(a), _flat(b)
    if len(x) and x.max() > 127 or len(y) and y.max() > 127:
        return np.array([sum(p == q for p, q in zip((s or "")[:n], t or "")) for s, t, n in zip(a.to_pylist(), b.to_pylist(), upto.tolist())], dtype=np.int64)
    n = np.minimum(np.minimum(nx, ny), np.maximum(upto, 0)).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    same = x[(np.cumsum(nx) - nx)[row] + place] == y[(np.cumsum(ny) - ny)[row] + place]
    return np.bincount(row[same], minlength=len(n))


def agreement(seq: pa.Array, germline: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per pair: share of the germline's known bases (not N) that the sequence has, number of N, and the germline with each N replaced.

    Places beyond the end of the sequence agree in nothing and keep their N.
    """
    s, ns = _flat(seq)
    g, ng = _flat(germline)
    row = np.repeat(np.arange(len(ng)), ng)
    place = np.arange(len(g)) - np.repeat(np.cumsum(ng) - ng, ng)
    there = place < ns[row]
    other = np.zeros(len(g), dtype=np.uint8)
    other[there] = s[(np.cumsum(ns) - ns)[row[there]] + place[there]]
    unknown = g == ord("N")
    n_unknown = np.bincount(row, weights=unknown, minlength=len(ng)).astype(np.int64)
    same = np.bincount(row, weights=~unknown & there & (other == g), minlength=len(ng))
    share = same / np.maximum(ng - n_unknown, 1)
    return share, n_unknown, _strings(np.where(unknown & there, other, g), ng, germline)
