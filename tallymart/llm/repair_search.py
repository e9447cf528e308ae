"""Cheapest repair of a conversation's roles, by depth-first branch and bound.

A conversation is a string of one code for each row (see ``codes`` below), its edits
a string of K (keep, 0), R (other role, 2), D (delete, 3) and I (insert, 2); a truncated row
that stays adds 1. Kept, changed and inserted rows must read ``(s?(ua)+)?``. Of the
cheapest audits the ASCII-least is wanted.

The search holds a stack of its own. A node is a row and what may follow there (a
state). A prefix is cut off if its cost and the lower bound of the rows behind it
exceed the incumbent, or if the node was reached by a prefix that is no worse.
Bounds that count rows one by one, without the state, were tried first: on random roles
the search then took exponential time. Two
prefixes of equal cost at a node are never the beginning of one another, since what is
longer has inserted more, so the less of two stays the less whatever follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}

#: What the rows so far read: nothing; only the system's row; an open user's turn; whole pairs.
START, SYSTEM, ASKED, ANSWERED = STATES = range(4)
_AFTER = {
    (START, "s"): SYSTEM,
    (START, "u"): ASKED,
    (SYSTEM, "u"): ASKED,
    (ANSWERED, "u"): ASKED,
    (ASKED, "a"): ANSWERED,
}
#: The state after a user's or assistant's row, whichever fits: one of them always does.
_NEXT = {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED, ASKED: ANSWERED}
_ROLES = {ASKED: "user", ANSWERED: "assistant"}
ENDS = (START, ANSWERED)

#: Codes of rows: the role's initial in lower case, in upper case if the text is truncated,
#: ``x`` for any other initial, ``d`` for a row that must go.
MUST_GO, OTHER = "d", "x"

Best = tuple[int, str] | None


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, state after`` of what may be done to a row where a state holds."""
    if code == MUST_GO:
        return [(DELETE, _COSTS[DELETE], state)]
    more = int(code.isupper())
    found = [(DELETE, _COSTS[DELETE], state), (REROLE, _COSTS[REROLE] + more, _NEXT[state])]
    after = _AFTER.get((state, code.lower()))
    if after is not None:
        found.append((KEEP, more, after))
    return found


def lower_bounds(codes: str, ends: tuple[int, ...]) -> list[list[float]]:
    """For each row and state, what it costs at least from there to one of ``ends``.

    The bounds are tight: they leave out which of the cheapest audits is wanted, nothing else.
    """
    bounds = [_with_inserts([0 if state in ends else math.inf for state in STATES])]
    for code in reversed(codes):
        behind = bounds[-1]
        bounds.append(
            _with_inserts([min(cost + behind[after] for _, cost, after in edits(code, state)) for state in STATES])
        )
    return bounds[::-1]


def _with_inserts(costs: list[float]) -> list[float]:
    for _ in STATES:
        costs = [min(costs[state], _COSTS[INSERT] + costs[_NEXT[state]]) for state in STATES]
    return costs


def search(codes: str, entry: int = START, ends: tuple[int, ...] = ENDS) -> Best:
    """The least ``cost, audit`` that leads from a state to one of ``ends``; None if none does."""
    bounds, n = lower_bounds(codes, ends), len(codes)
    best: Best = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if least == math.inf:
            continue
        if best is not None and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)])):
            continue
        if (at, state) in reached and reached[at, state] <= (cost, audit):
            continue
        reached[at, state] = cost, audit
        if at == n and state in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        ways = [(INSERT, _COSTS[INSERT], _NEXT[state], at)]
        if at < n:
            ways += [(*edit, at + 1) for edit in edits(codes[at], state)]
        # the most promising comes off the stack first, of equal ones the ASCII-least
        ways.sort(key=lambda way: (way[1] + bounds[way[3]][way[2]], way[0]), reverse=True)
        stack += [(to, after, cost + more, audit + letter) for letter, more, after, to in ways]
    return best


def table(codes: str) -> list[Best]:
    """The best of each entry and end, entry by entry: what joins a stretch of rows to others."""
    return [search(codes, entry, (end,)) for entry in STATES for end in STATES]


def joined(first: list[Best], second: list[Best]) -> list[Best]:
    """The table of two stretches, one behind the other."""
    k, out = len(STATES), []
    for entry in STATES:
        for end in STATES:
            ways = [(first[entry * k + mid], second[mid * k + end]) for mid in STATES]
            out.append(min(((a[0] + b[0], a[1] + b[1]) for a, b in ways if a and b), default=None))
    return out


class Replay:
    """An audit applied to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        """The roles of the rows to insert here."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            self.state = _NEXT[self.state]
            yield _ROLES[self.state]

    def edit(self, role: str) -> tuple[str, str | None]:
        """What is done to the next row: its letter and its role afterwards, None if it goes."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == DELETE:
            return letter, None
        self.state = _NEXT[self.state] if letter == REROLE else _AFTER[self.state, role[:1]]
        return letter, _ROLES[self.state] if letter == REROLE else role
