"""Where a sentence may end: blocks, quotations, places and their contexts, of many texts at once.

The texts of a batch are one array of code points; every step works on whole arrays (only matched quotations
and brackets are followed one by one). A place is a position in a running block, outside quotations and brackets, where
a boundary token may stand between two words: after a run of stops with what closes after it, if a space, a capital, a letter
of a script without capitals or an opening mark comes next, and, for the script without stops, at a space between two of its letters.

Contexts are words, word pairs and word shapes on either side, whole words of any length, each as a hash: numbers count
as one sign, and the hash of a stretch is taken from running sums (a polynomial modulo 2^64), so no word is cut out. In scripts
that put no spaces between words the last and the next few letters stand for words.
"""

from __future__ import annotations

import unicodedata

import numpy as np

BITS = 17
CELLS = 1 << BITS
STOPS = ".!?…。！？｡؟۔।॥։።"
#: What opens and what closes a quotation or bracket.
PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "“": "”", "„": "“”", "‚": "‘’", "‹": "›"}
CLOSERS = set("".join(PAIRS.values())) | set("\"'’‘")
AFTER = set("\"'”’»」』）)]】")
LEADS = set(PAIRS) | set("\"'¿¡")
INVERTED = "¿¡"
BRACKETS = set(PAIRS) | set("".join(PAIRS.values())) | {'"'}
#: First and last code point of scripts whose words stand without spaces; the last of them is written without stops too.
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x0E00, 0x0E7F))
STOPLESS = (0x0E00, 0x0E7F)
SCRIPTS = ((0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0xDFF), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x3400, 0x9FFF))

# kinds of place
HIDDEN, END, START = 0, 2, 3
# kinds of context: word pair, word, shape before; the same after
L3, L2, L1, R3, R2, R1 = range(6)
KINDS = 6

_BITS = ["known", "space", "newline", "stop", "closer", "after", "lead", "inverted", "bracket", "digit", "alpha", "lower", "upper", "word", "wide", "thai", "sep", "dash", "listmark", "quote_in"]
_B = {n: 1 << i for i, n in enumerate(_BITS)}
_class = np.zeros(0x110000, dtype=np.uint32)
#: Shape of a sign that is no letter: its category and, for a few, the sign itself.
_shape = np.zeros(0x110000, dtype=np.uint16)


def _learn(points: np.ndarray) -> None:
    cats = {c: i for i, c in enumerate(["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn"])}
    for o in points.tolist():
        c = chr(o)
        cat = unicodedata.category(c)
        digit, alpha = c.isdigit(), c.isalpha()
        flags = {
            "known": True, "space": c.isspace(), "newline": c == "\n", "stop": c in STOPS, "closer": c in CLOSERS, "after": c in AFTER, "lead": c in LEADS, "inverted": c in INVERTED, "bracket": c in BRACKETS, "digit": digit, "alpha": alpha,
            "lower": c.islower(), "upper": c.isupper(), "word": c.isalnum() or c == "_" or cat[0] == "M" or c in "'’", "wide": any(a <= o <= b for a, b in UNSPACED), "thai": STOPLESS[0] <= o <= STOPLESS[1], "sep": c in ".,:/-", "dash": c == "-",
            "listmark": c in "-*•", "quote_in": c in "\"'([«“„「『（¿¡‚‹",
        }
        _class[o] = sum(_B[n] for n, on in flags.items() if on)
        script = next((i + 2 for i, (a, b) in enumerate(SCRIPTS) if a <= o <= b), 1 if o < 0x250 else 0)
        if digit:
            _shape[o] = 1
        elif c in STOPS:
            _shape[o] = 2
        elif alpha or cat[0] == "M":
            _shape[o] = 100 + script
        else:
            _shape[o] = 40 + ",;:-–—".index(c) if c in ",;:-–—" else 3 + cats.get(cat, 29)


def classes(u: np.ndarray) -> np.ndarray:
    c = _class[u]
    if (c == 0).any():
        _learn(np.unique(u[c == 0]))
        c = _class[u]
    return c


def mix(*parts) -> np.ndarray:
    """One well-mixed number of several."""
    h = np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in parts:
        h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def cell(kind: int, h: np.ndarray) -> np.ndarray:
    return (kind * CELLS + (h & np.uint64(CELLS - 1)).astype(np.int64)).astype(np.int32)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


class _Hashes:
    """Hashes of stretches of the signs that are kept."""

    def __init__(self, signs: np.ndarray, keep: np.ndarray):
        self.place = np.concatenate([[0], np.cumsum(keep)])
        kept = signs[keep].astype(np.uint64) + np.uint64(1)
        power, self.inverse = _power(len(kept) + 1)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept * power[: len(kept)])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.place[a], self.place[b]
        return mix((self.sum[b] - self.sum[a]) * self.inverse[a], b - a)

    def size(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.place[b] - self.place[a]


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place up to the end, the first place at or after it where ``mask`` holds (or the end)."""
    n = len(mask)
    at = np.where(mask, np.arange(n, dtype=np.int32), np.int32(n))
    return np.concatenate([np.minimum.accumulate(at[::-1])[::-1], np.array([n], np.int32)])


def _last(mask: np.ndarray) -> np.ndarray:
    """For each place i up to the end, the place after the last one before i where ``mask`` holds (or 0)."""
    return np.concatenate([np.zeros(1, np.int32), np.maximum.accumulate(np.where(mask, np.arange(1, len(mask) + 1, dtype=np.int32), np.int32(0)))])


def matched_pairs(signs: list[tuple[int, str]], opens_quote) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a block as (place of opener, place of closer); ``signs`` are its bracket signs in order.

    ``opens_quote`` tells of a plain quotation mark at a place whether it may open, and whether it may close.
    """
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for i, c in signs:
        if c == '"':
            opens, closes = opens_quote(i)
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if at is not None and (not opens or closes):
                pairs.append((stack[at][1], i))
                del stack[at:]
            elif opens:
                if at is not None:
                    del stack[at:]
                stack.append((c, i))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS.get(stack[k][0], "")), None)
        if at is not None:
            pairs.append((stack[at][1], i))
            del stack[at:]
        elif c in PAIRS:
            stack.append((c, i))
    pairs.sort()
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


COLS = ["seg", "stop", "next", "kind", "l3", "l3b", "l2", "l1", "r3", "r2", "r1"]


def parse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of a batch of texts: (text, start, end) of each segment, and the text and COLS of each place, all in order.

    A segment is a line of a list or of pasted records, or a running block. ``seg`` numbers the batch's segments.
    """
    held = [t or "" for t in texts]
    joined = "\n\n".join(held) + "\n\n"
    u = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    n = len(u)
    first = np.concatenate([[0], np.cumsum([len(t) + 2 for t in held])])
    c = classes(u)
    is_ = lambda name: (c & np.uint32(_B[name])) != 0
    space, newline, stop, digit, alpha, word, wide, thai = (is_(x) for x in ("space", "newline", "stop", "digit", "alpha", "word", "wide", "thai"))
    solid = ~space
    next_solid, last_solid = _next(solid), _last(solid)

    # lines that are not blank, and blocks of them
    ends = np.flatnonzero(newline)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lo, hi = next_solid[starts], last_solid[ends]
    full = lo < hi
    block = np.cumsum(np.concatenate([[True], ~full[:-1]]))[full]
    if not full.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, {k: np.zeros(0, np.int32) for k in COLS}
    lo, hi, line_end = lo[full], hi[full], ends[full]
    _, block = np.unique(block, return_inverse=True)
    no_digit = _next(~digit)
    mark = no_digit[lo]
    listed = is_("listmark")[lo] & space[lo + 1] & (lo + 1 < line_end)
    numbered = digit[lo] & np.isin(u[np.minimum(mark, n - 1)], (ord("."), ord(")"))) & space[np.minimum(mark + 1, n - 1)] & (mark + 1 < line_end)
    head = np.flatnonzero(np.diff(block, prepend=-1))
    by_line = np.logical_and.reduceat(listed | numbered, head)
    by_line |= np.isin(u[lo[head]], (ord(">"), ord("[")))
    tail = np.append(head[1:], len(block)) - 1
    lined = by_line[block]
    seg_lo = np.concatenate([lo[lined], lo[head][~by_line]])
    seg_hi = np.concatenate([hi[lined], hi[tail][~by_line]])
    order = np.argsort(seg_lo, kind="stable")
    seg_lo, seg_hi, running = seg_lo[order].astype(np.int64), seg_hi[order].astype(np.int64), np.concatenate([np.zeros(int(lined.sum()), bool), np.ones(int((~by_line).sum()), bool)])[order]
    seg_doc = np.searchsorted(first, seg_lo, side="right") - 1

    # quotations and brackets of running blocks
    at = np.flatnonzero(is_("bracket"))
    of = np.searchsorted(seg_lo, at, side="right") - 1
    inside = (of >= 0) & (at < seg_hi[np.maximum(of, 0)]) & running[np.maximum(of, 0)]
    at, of = at[inside], of[inside]
    pairs: list[tuple[int, int]] = []
    if len(at):
        text_at, blocks = [chr(x) for x in u[at]], np.flatnonzero(np.diff(of, prepend=-1))
        alnum = is_("word") & ~np.isin(u, [ord(x) for x in "'’_"])

        def opens_quote(i: int) -> tuple[bool, bool]:
            begins, stops = seg_lo[seg_of], seg_hi[seg_of]
            can_open = (i == begins or not (alnum[i - 1] or stop[i - 1] or u[i - 1] == 44)) and i + 1 < stops and not space[i + 1]
            return bool(can_open), bool(i > begins and not space[i - 1])

        places = at.tolist()
        for a, b in zip(blocks.tolist(), [*blocks[1:].tolist(), len(at)]):
            if b - a > 1:
                seg_of = of[a]
                pairs += matched_pairs(list(zip(places[a:b], text_at[a:b])), opens_quote)
    open_at = np.array([p[0] for p in pairs], dtype=np.int64)
    close_at = np.array([p[1] for p in pairs], dtype=np.int64)

    def around(p: np.ndarray) -> np.ndarray:
        """Number of the pair that a place lies inside, or -1."""
        if not len(open_at):
            return np.full(len(p), -1)
        k = np.searchsorted(open_at, p, side="left") - 1
        return np.where((k >= 0) & (close_at[np.maximum(k, 0)] > p), k, -1)

    # runs of stops
    i = np.flatnonzero(stop & ~np.concatenate([[False], stop[:-1]]))
    of = np.searchsorted(seg_lo, i, side="right") - 1
    ok = (of >= 0) & (i < seg_hi[np.maximum(of, 0)]) & running[np.maximum(of, 0)]
    i, of = i[ok], of[ok]
    no_stop = _next(~stop)
    closes = is_("closer")
    j = no_stop[i].astype(np.int64)
    k = around(i)
    deep = k >= 0
    rest = _next(~closes)
    at_close = close_at[np.maximum(k, 0)] if len(close_at) else np.zeros(len(k), np.int64)
    fits = ~deep | (rest[np.minimum(next_solid[j], n)] >= at_close)
    j = np.where(deep, at_close + 1, j)
    more = stop | is_("after")
    if len(open_at):
        more[open_at] = False
    j = np.minimum(_next(~more)[j], seg_hi[of]) if len(i) else j
    i, j, of = i[fits], j[fits], of[fits]
    reach = np.concatenate([[0], np.maximum.accumulate(j)[:-1]]) if len(j) else j
    fresh = i >= reach
    i, j, of = i[fresh], j[fresh], of[fresh]
    nxt = next_solid[j].astype(np.int64)
    go = nxt < seg_hi[of]
    i, j, of, nxt = i[go], j[go], of[go], nxt[go]
    upper, lower, lead = is_("upper"), is_("lower"), is_("lead")
    spaced = nxt > j
    mark = u[i]
    begins = upper[nxt] | (alpha[nxt] & ~lower[nxt]) | lead[nxt]
    only_ends = ~np.isin(mark, [ord("."), ord("…")]) | (no_stop[i] - i > 1) & (mark == ord("."))
    glued = np.where(only_ends, begins | alpha[nxt] | digit[nxt], begins & (i > 0) & (word | closes | np.isin(u, [ord("%"), ord("°")]))[np.maximum(i - 1, 0)])
    keep = spaced | glued
    i, j, of, nxt = i[keep], j[keep], of[keep], nxt[keep]

    # spaces of the script without stops
    gap = np.flatnonzero(space[1:] & thai[:-1]) + 1
    after = next_solid[gap].astype(np.int64)
    fit = (after < n) & thai[np.minimum(after, n - 1)]
    gap, after = gap[fit], after[fit]
    gof = np.searchsorted(seg_lo, gap, side="right") - 1
    fit = (gof >= 0) & (after < seg_hi[np.maximum(gof, 0)]) & running[np.maximum(gof, 0)] & (around(gap) < 0)
    gap, after, gof = gap[fit], after[fit], gof[fit]

    # known boundaries: the beginning of each running block, and its end where it has stops or is of the script without
    run = np.flatnonzero(running)
    r_lo, r_hi = seg_lo[run], seg_hi[run]
    bare = np.maximum(_last(~(stop | closes | space))[r_hi], r_lo) if len(run) else r_hi
    has_stop = np.concatenate([[0], np.cumsum(stop)])
    stopped = (has_stop[r_hi] - has_stop[bare]) > 0
    thai_end = ~stopped & thai[np.maximum(r_hi - 1, 0)] if len(run) else stopped
    e_run, t_run = run[stopped], run[thai_end]

    # signs as they are hashed: a number is one sign
    prev_digit, next_digit = np.concatenate([[False], digit[:-1]]), np.concatenate([digit[1:], [False]])
    number = digit | (is_("sep") & prev_digit & next_digit)
    kept = ~number | ~np.concatenate([[False], number[:-1]])
    signs = np.where(number, np.uint32(35), u)
    whole, solid_signs = _Hashes(signs, kept), _Hashes(signs, kept & solid)
    count = lambda m: np.concatenate([[0], np.cumsum(m)])
    letters, capitals, dots = count(alpha), count(upper), count(~number & (u == 46))
    run_start = _last(space)
    no_quote, no_word = _next(~is_("quote_in")), _next(~(word | (is_("dash") & np.concatenate([[False], word[:-1]]) & np.concatenate([word[1:], [False]]))))
    no_sep, no_number = _next(~is_("sep")), _next(~number)
    shape_of = _shape[u]

    def shape(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shape of the word [a, b): script and case of a word, else the kind of its first sign; 0 of an empty one."""
        a0 = np.minimum(a, n - 1)
        s = shape_of[a0].astype(np.int64)
        ls, us = letters[b] - letters[a], capitals[b] - capitals[a]
        case = np.where(lower[a0], 0, np.where(~upper[a0], 4, np.where(ls == 1, 1, np.where(us == ls, 2, 3))))
        return np.where(a >= b, 0, np.where(s >= 100, s * 8 + case, s))

    def left(i: np.ndarray, j: np.ndarray, seg: np.ndarray, sep: np.ndarray):
        """Contexts before: word pair with marks, word with marks, shape with marks, and where the word begins."""
        begin = np.maximum(run_start[i], seg_lo[seg])
        a = np.minimum(no_quote[begin], i)
        tight = wide[np.maximum(i - 1, 0)] & (i > begin)
        a = np.where(tight, np.maximum(i - 2, begin), a)
        p_hi = last_solid[begin]
        p_lo = np.maximum(run_start[np.maximum(p_hi - 1, 0)], seg_lo[seg])
        p_lo = np.minimum(no_quote[np.minimum(p_lo, n)], p_hi)
        has_prev = (p_hi > seg_lo[seg]) & ~tight & (p_lo < p_hi)
        prev = np.where(has_prev, whole(np.where(has_prev, p_lo, 0), np.where(has_prev, p_hi, 0)), np.uint64(7))
        prev = np.where(tight, whole(np.maximum(a - 2, begin), i), prev)
        marks = solid_signs(i, j)
        one = mix(whole(a, i), marks)
        size = whole.size(a, i)
        kind = mix(shape(a, i), np.minimum(size, 2) + (size > 4), (dots[i] - dots[a]) > 0, marks)
        return mix(prev, one, sep), one, mix(kind, sep), a

    def right(p: np.ndarray, seg: np.ndarray):
        """Contexts after: first word's shape with the next word, first word, its shape."""
        stop_at = seg_hi[seg]
        p, leads, lead1 = p.copy(), np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        while True:
            on = (p < stop_at) & lead[np.minimum(p, n - 1)] & ~digit[np.minimum(p, n - 1)]
            if not on.any():
                break
            sign = np.where(is_("inverted")[p[on]], np.uint64(2), np.uint64(1))
            lead1[on] = np.where(lead1[on] == 0, sign, lead1[on])
            leads[on] = leads[on] * np.uint64(3) + sign
            p[on] = np.minimum(next_solid[p[on] + 1], stop_at[on])
        none = p >= stop_at
        q = np.minimum(p, n - 1)
        tight = wide[q]
        e = np.where(word[q], no_word[q], q + 1)
        e = np.where(word[q] & (u[np.minimum(e, n - 1)] == 46), e + 1, e)
        e = np.where(tight, q + 2, e)
        e = np.minimum(e, stop_at)
        f = np.where(tight, e, no_sep[np.minimum(e, n)])
        f = np.where(digit[q], no_number[np.minimum(f, n)], f)
        f = np.minimum(next_solid[np.minimum(f, n)], stop_at)
        g = np.minimum(f, n - 1)
        f2 = np.where(wide[g], f + 2, np.where(word[g], no_word[g], g + 1))
        f2 = np.where(tight, np.minimum(q + 3, stop_at), np.minimum(f2, stop_at))
        f = np.where(tight, q, f)
        e, f2 = np.maximum(e, np.minimum(q, e)), np.maximum(f2, f)
        w = np.where(none, np.uint64(11), whole(np.where(none, 0, q), np.where(none, 0, e)))
        then = np.where(none | (f >= stop_at), np.uint64(13), whole(np.where(none, 0, f), np.where(none, 0, f2)))
        kind = np.where(none, 9, np.where(tight, 50_000 + shape_of[q].astype(np.int64), shape(np.where(none, 0, q), np.where(none, 0, e))))
        r1 = mix(lead1, kind)
        return mix(leads, r1, then), mix(leads, w), r1

    def thai_left(p: np.ndarray, seg: np.ndarray):
        b = seg_lo[seg]
        mark = np.full(len(p), 17, np.uint64)
        return mix(whole(np.maximum(p - 4, b), p), mark), mix(whole(np.maximum(p - 2, b), p), mark), mix(mark), p

    parts = []

    def put(seg, stop_, next_, kind, ls, rs):
        zero = np.zeros(len(seg), np.int32)
        l3, l2, l1, begin = ls if ls is not None else (None, None, None, None)
        cols = {"seg": seg, "stop": stop_, "next": next_, "kind": np.full(len(seg), kind)}
        for name, code, h in (("l3", L3, l3), ("l2", L2, l2), ("l1", L1, l1)):
            cols[name] = zero if h is None else cell(code, h)
        for name, code, h in zip(("r3", "r2", "r1"), (R3, R2, R1), rs if rs is not None else (None,) * 3):
            cols[name] = zero if h is None else cell(code, h)
        both = ls is not None and rs is not None
        cols["begin"] = begin if both else np.full(len(seg), -1)
        cols["l3b"] = cell(L3, mix(np.uint64(23), l2, next_ > stop_)) if both else np.full(len(seg), -1)
        parts.append(cols)

    nothing = lambda m: np.zeros(len(m), np.int64)
    put(run, nothing(run), nothing(run), START, None, right(r_lo, run))
    e_lo, e_hi = bare[stopped], r_hi[stopped]
    put(e_run, nothing(e_run), nothing(e_run), END, left(e_lo, e_hi, e_run, np.ones(len(e_run), np.uint64)), None)
    put(t_run, nothing(t_run), nothing(t_run), END, thai_left(r_hi[thai_end], t_run), None)
    put(of, j, nxt, HIDDEN, left(i, j, of, (nxt > j).astype(np.uint64)), right(nxt, of))
    put(gof, gap, after, HIDDEN, thai_left(gap, gof), right(after, gof))
    cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    # START first, then END, then the places in order; a place's word may begin where the place before it lets the next sentence begin
    rank = np.where(cols["kind"] == HIDDEN, cols["stop"] + 2, np.where(cols["kind"] == START, 0, 1))
    order = np.lexsort((rank, cols["seg"]))
    cols = {k: v[order] for k, v in cols.items()}
    last = np.concatenate([[-1], cols["next"][:-1]])
    same = np.concatenate([[False], cols["seg"][1:] == cols["seg"][:-1]]) & np.concatenate([[False], cols["kind"][:-1] == HIDDEN])
    cols["l3b"] = np.where((cols["kind"] == HIDDEN) & same & (cols["begin"] <= last), cols["l3b"], -1)
    del cols["begin"]
    doc = seg_doc[cols["seg"]]
    for k in ("stop", "next"):
        cols[k] = np.where(cols["kind"] == HIDDEN, cols[k] - first[doc], 0)
    return seg_doc, seg_lo - first[seg_doc], seg_hi - first[seg_doc], doc, {k: cols[k].astype(np.int32) for k in COLS}
