"""What a pattern needs: literals of which each match of it holds at least one, read off its parse tree."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

MOST, SHORTEST = 16, 2


def _times(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets of which either would do: that with the longer shortest literal, then the smaller, then the first."""
    if a is None or b is None:
        return b if a is None else a
    rank = lambda s: (-min(map(len, s)), len(s))
    return b if rank(b) < rank(a) else a


def _one(op, av) -> tuple[set[str] | None, set[str] | None]:
    """Of an element: all that it can match, if that is a small set of texts; and a set of which each of its matches holds one."""
    if op is C.LITERAL:
        return {chr(av)}, None
    if op is C.IN and all(x[0] is C.LITERAL for x in av) and len(av) <= MOST:
        return {chr(x[1]) for x in av}, None
    if op is C.SUBPATTERN:
        _, add, _, inner = av
        return (None, None) if add & re.IGNORECASE else _sequence(inner)
    if op is C.ATOMIC_GROUP:
        return _sequence(av)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, None  # no text of its own
    if op is C.BRANCH:
        each = [_sequence(x) for x in av[1]]
        every = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
        if every is not None and len(every) <= MOST:
            return every, None
        needs = [n if e is None else (e if "" not in e else None) for e, n in each]
        return None, set().union(*needs) if all(needs) and len(set().union(*needs)) <= MOST else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = av
        if low == 0:
            return None, None
        exact, need = _sequence(inner)
        if exact is None:
            return None, need
        whole: set[str] | None = {""}
        for _ in range(min(low, MOST)):
            whole = whole and _times(whole, exact)
        if whole is None:
            return None, exact if "" not in exact else None
        return (whole, None) if low == high <= MOST else (None, whole if "" not in whole else None)
    return None, None


def _sequence(items) -> tuple[set[str] | None, set[str] | None]:
    run, best, exact = {""}, None, True
    for op, av in items:
        own, need = _one(op, av)
        longer = _times(run, own) if own is not None else None
        if longer is not None:
            run = longer
            continue
        best, exact = _better(best, run if "" not in run else None), False
        best, run = _better(best, need), own if own is not None else {""}
    return (run, None) if exact else (None, _better(best, run if "" not in run else None))


def compiled(pattern: str | None) -> re.Pattern | None:
    """The pattern, or None if it isn't one."""
    try:
        return re.compile(pattern) if pattern is not None else None
    except (re.error, OverflowError, RecursionError):
        return None


def needed(pattern: str) -> list[str] | None:
    """Literals of SHORTEST characters or more of which each match holds one, sorted; None where the pattern needs none (or folds case), so that every text has to be tried."""
    own = compiled(pattern)
    if own is None or own.flags & re.IGNORECASE:
        return None
    exact, need = _sequence(parser.parse(pattern))
    found = need if exact is None else exact
    return sorted(found) if found and min(map(len, found)) >= SHORTEST else None
