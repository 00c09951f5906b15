"""Which subset labels the CDR3 that a consensus with [classes] stands for can have, without spelling them out."""

from __future__ import annotations

import re
from functools import lru_cache

from repspark.functions.subsets import MAJOR, SATELLITE, Rule

_TOKEN = re.compile(r"\[([^\]]*)\]|(.)")


def _letters(motif: str) -> list[list[frozenset | None]]:
    """The alternatives of a motif, each the set of letters per place; None is any letter."""
    return [[None if b == "." else frozenset(a or b) for a, b in _TOKEN.findall(alt)] for alt in motif.strip("^$").split("|")]


class _Search:
    """One motif in its window; a state is the tuple of how far each alternative's matches have come (bits), or True once found."""

    def __init__(self, motif: str, first: int, last: int, length: int):
        self.first, self.last = (first, min(last, length)) if last else (1, length)
        self.begins, self.ends = motif.startswith("^"), motif.endswith("$")
        self.alternatives = _letters(motif)

    def start(self):
        return (0,) * len(self.alternatives)

    def step(self, state, place: int, letter: str):
        if state is True or not self.first <= place <= self.last:
            return state
        out = []
        for bits, alt in zip(state, self.alternatives):
            if place == self.first or not self.begins:
                bits |= 1
            moved = 0
            for i, want in enumerate(alt):
                if bits >> i & 1 and (want is None or letter in want):
                    moved |= 2 << i
            if moved >> len(alt) & 1 and (place == self.last or not self.ends):
                return True
            out.append(moved)
        return tuple(out)


@lru_cache(maxsize=100_000)
def labels(genes: tuple[str, ...], consensus: str, satellites: bool = True) -> tuple[str, ...]:
    """Sorted labels, of the first rule that fits each CDR3 ('Unassigned' if none does).

    All CDR3 are followed at once, letter by letter: those that have come equally far in every motif are one state.
    """
    tokens = [a or b for a, b in _TOKEN.findall(consensus)]
    n = len(tokens)
    rules: list[Rule] = [r for r in MAJOR + (SATELLITE if satellites else ()) if r.shortest <= n <= r.longest and any(re.search(r.v, g) for g in genes)]
    searches = [[_Search(m, a, b, n) for m, a, b in r.motifs] for r in rules]
    states = {tuple(s.start() for group in searches for s in group)}
    flat = [s for group in searches for s in group]
    for place, token in enumerate(tokens, 1):
        states = {tuple(s.step(x, place, c) for s, x in zip(flat, state)) for state in states for c in token}
    found = set()
    for state in states:
        at = iter(state)
        fits = [all([next(at) is True for _ in group]) for group in searches]
        found.add(next((r.label for r, f in zip(rules, fits) if f), "Unassigned"))
    return tuple(sorted(found))
