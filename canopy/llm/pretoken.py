"""Pre-tokenisation without regular expressions.

Each code point has a class; a class is a function on the states of a small
automaton.  Functions compose associatively, so a doubling scan gives the state
after every code point at once: at each step a position's function is composed
with that of the window before it, by a lookup in the multiplication table of
the functions' monoid.  A constant function is final, and windows of a few code
points are constant, so the scan ends after two or three steps whatever the
length.  Boundaries follow from the states and one code point of lookahead.
"""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata

import numpy as np

# Classes of code points.
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, ONE, RV, E, ELL, RESET = range(11)
# States: what the last code point ended in.
START, WORD, DIGITS, MARKS, BLANK_AT, SPACE_AT, QUOTED, QUOTED_RV, QUOTED_L, CLOSED = range(10)

# The code points that \s matches.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    out = np.full(len(major), OTHER, np.uint8)
    out[major == "L"] = LETTER
    out[major == "N"] = NUMBER
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    out[[ord(c) for c in "stmd"]] = ONE
    out[[ord(c) for c in "rv"]] = RV
    out[ord("e")] = E
    out[ord("l")] = ELL
    return out


def _step(state: int, kind: int) -> int:
    """The automaton: a quote that opens a token may close a contraction."""
    if kind == RESET:
        return START
    if kind in (LETTER, ONE, RV, E, ELL):
        closes = {(QUOTED, ONE): CLOSED, (QUOTED, RV): QUOTED_RV, (QUOTED, ELL): QUOTED_L, (QUOTED_RV, E): CLOSED, (QUOTED_L, ELL): CLOSED}
        return closes.get((state, kind), WORD)
    if kind == QUOTE:
        return MARKS if state in (MARKS, BLANK_AT, QUOTED) else QUOTED
    return {NUMBER: DIGITS, BLANK: BLANK_AT, SPACE: SPACE_AT, OTHER: MARKS}[kind]


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, product table, whether a function is constant, its value at START)."""
    known: dict[tuple[int, ...], int] = {}
    made = [tuple(_step(s, k) for s in range(CLOSED + 1)) for k in range(RESET + 1)]
    for f in made:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        new = []
        for f, g in itertools.chain(itertools.product(todo, list(known)), itertools.product(list(known), todo)):
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                new.append(h)
        todo = new
    functions = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    constant = np.array([len(set(f)) == 1 for f in functions])
    return np.array([known[f] for f in made], np.uint16), table, constant, np.array([f[START] for f in functions], np.uint8)


def states(kinds: np.ndarray) -> np.ndarray:
    """The state after each position, by an associative scan; kinds[0] must be RESET."""
    of_class, table, constant, value = monoid()
    f = of_class[kinds]
    open_at = np.flatnonzero(~constant[f])
    width = 1
    while len(open_at):
        f[open_at] = table[f[open_at - width], f[open_at]]
        open_at = open_at[~constant[f[open_at]]]
        width *= 2
    return value[f]


def cuts(kinds: np.ndarray) -> np.ndarray:
    """Positions where a token starts; a RESET is a token of its own, and kinds[0] must be one."""
    state = states(kinds)
    before = np.empty_like(state)
    before[0], before[1:] = START, state[:-1]
    white = (kinds == BLANK) | (kinds == SPACE)
    letter = (kinds == LETTER) | (kinds == ONE) | (kinds == RV) | (kinds == E) | (kinds == ELL)
    start = np.ones(len(kinds), bool)
    start[letter & ((before == WORD) | (before == QUOTED_RV) | (before == QUOTED_L) | (before == BLANK_AT) | (state == CLOSED))] = False
    # A contraction of two letters takes back the start that its first letter had.
    start[np.flatnonzero((state == CLOSED) & (before != QUOTED)) - 1] = False
    start[(kinds == NUMBER) & ((before == DIGITS) | (before == BLANK_AT))] = False
    start[((kinds == OTHER) | (kinds == QUOTE)) & ((before == MARKS) | (before == BLANK_AT) | (before == QUOTED))] = False
    # Of a run of white space the last one goes by itself or with what follows, unless the text ends there.
    last = np.zeros(len(kinds), bool)
    last[:-1] = white[:-1] & ~white[1:] & (kinds[1:] != RESET)
    start[white & ((before == BLANK_AT) | (before == SPACE_AT)) & ~last] = False
    return np.flatnonzero(start)


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All tokens of the texts in order, and for each text the index of its first (one more at the end)."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = code_point_classes()[points]
    resets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=resets[1:])
    kinds[resets] = RESET
    at = cuts(kinds)
    real = kinds[at[:-1]] != RESET
    starts, ends = at[:-1][real], at[1:][real]
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.searchsorted(starts, resets)
