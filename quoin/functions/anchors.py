"""Locating anchors: their grammar, and how one resolves in a folded text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.patterns import compiled, needed
from quoin.functions.text import count_of, dehyphenate, norm, once

MARKER = "array<struct<phrase:string,regex:boolean,before:string,after:string,nth:int>>"
# The keys of an anchor, the suffix of one that is a pattern, its pins, and what parts further phrases.
KEYS, PATTERN, SIDES, PARTS = ("grep", "search"), "-re", ("before", "after"), ";|"


class _Scanner:
    """Reads a text for anchors. Every reader takes a place and returns what it read with the place after it, or None where it can't read."""

    def __init__(self, text: str) -> None:
        self.text, self.end = text, len(text)

    def char(self, at: int) -> str:
        return self.text[at] if 0 <= at < self.end else ""

    def past_space(self, at: int) -> int:
        while self.char(at).isspace():
            at += 1
        return at

    def quoted(self, at: int) -> tuple[str, int] | None:
        """A phrase between two backticks or two double quotes that isn't empty."""
        mark = self.char(at)
        close = self.text.find(mark, at + 1) if mark and mark in "`\"" else -1
        return (self.text[at + 1 : close], close + 1) if close > at + 1 else None

    def key(self, at: int) -> tuple[bool, int] | None:
        """A key with its colon: whether a pattern follows."""
        for word in KEYS:
            if self.text.startswith(word, at):
                after = at + len(word)
                pattern = self.text.startswith(PATTERN, after)
                after += len(PATTERN) * pattern
                return (pattern, after + 1) if self.char(after) == ":" else None
        return None

    def head(self, at: int) -> tuple[bool, str, int] | None:
        """A key and its phrase. A backtick after the colon may close one before the key, or open the phrase."""
        if not (found := self.key(at)):
            return None
        pattern, colon = found
        for start in (colon + 1, colon) if self.char(colon) == "`" else (colon,):
            if phrase := self.quoted(self.past_space(start)):
                return pattern, *phrase
        return None

    def pin(self, at: int) -> tuple[str, str | int, int] | None:
        """before or after and a phrase, or # and a number."""
        at = self.past_space(at)
        if self.char(at) == "#":
            stop = at + 1
            while self.char(stop).isdecimal():
                stop += 1
            return ("nth", min(int(self.text[at + 1 : stop]), 2**31 - 1), stop) if stop > at + 1 else None
        for side in SIDES:
            start = at + len(side)
            if self.text.startswith(side, at) and self.char(start).isspace() and (phrase := self.quoted(self.past_space(start))):
                return side, *phrase
        return None

    def further(self, at: int) -> tuple[str, int] | None:
        """A phrase without a key of its own, after a semicolon or a bar."""
        at = self.past_space(at)
        if self.char(at) == "`":
            at = self.past_space(at + 1)
        if not self.char(at) or self.char(at) not in PARTS:
            return None
        at = self.past_space(at + 1)
        inner = at + 2 if self.text.startswith("``", at) else at + 1
        return None if self.key(inner) or self.key(at + 1) else self.quoted(at)

    def anchors(self) -> list[dict]:
        found: list[dict] = []
        at = 0
        while at < self.end:
            places = [i for i in (self.text.find(k, at) for k in KEYS) if i >= 0]
            if not places:
                break
            at = min(places)
            before = self.char(at - 1) if at else ""
            if before.isascii() and before.isalpha() or not (head := self.head(at)):
                at += 1
                continue
            pattern, phrase, at = head
            own = {"phrase": phrase, "regex": pattern, "before": None, "after": None, "nth": None}
            found.append(own)
            after = at
            while pin := self.pin(after):
                own[pin[0]], after = pin[1], pin[2]
            while more := self.further(after):
                found.append({"phrase": more[0], "regex": pattern, "before": None, "after": None, "nth": None})
                after = more[1]
        return found


def markers_of(text: str | None) -> list[dict]:
    """All anchors of a text in order: each keyed phrase with the pins that touch it, then the bare phrases that share its marker."""
    return _Scanner(text).anchors() if text else []


def _parsed(texts: pd.Series) -> pd.Series:
    return texts.map(markers_of)


def parse_markers(c: Column) -> Column:
    """The anchors of a text, as an array of markers."""
    return F.pandas_udf(_parsed, MARKER)(c)


class _Patterns:
    """The patterns of a batch, each compiled and asked for its literals once."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[re.Pattern | None, list[str] | None]] = {}

    def of(self, p: str) -> tuple[re.Pattern | None, list[str] | None]:
        if p not in self.known:
            self.known[p] = (compiled(p), needed(p))
        return self.known[p]

    def hits(self, hay: str | None, p: str | None, b: str | None, a: str | None) -> int:
        """Matches of an intentional pattern whose neighbours fit. A pattern that doesn't compile has none; nor has one in a text without any of the literals that it needs."""
        own, literals = self.of(p) if hay is not None and p is not None else (None, None)
        if own is None or literals is not None and not any(x in hay for x in literals):
            return 0
        if not b and not a:
            return sum(1 for _ in own.finditer(hay))
        fits = lambda s, e: (not b or hay.endswith((b, b + " "), 0, s)) and (not a or hay.startswith((a, " " + a), e))
        return sum(fits(*m.span()) for m in own.finditer(hay))


def _pattern_hits(flat: pd.Series, phrase: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Rows without a text aren't for patterns."""
    own = _Patterns()
    return pd.Series([own.hits(*r) for r in zip(flat, phrase, before, after, strict=True)], dtype="int32")


def _pattern_lines(text: pd.Series, phrase: pd.Series, before: pd.Series, after: pd.Series, nth: pd.Series) -> pd.Series:
    """Lines (from 1) of a pattern's matches as the text stands, its pins and #n honoured."""

    def one(raw: str | None, p: str | None, b: str | None, a: str | None, n: float | None) -> list[int]:
        own = compiled(p) if raw is not None and p is not None else None
        if own is None:
            return []
        hits = [(i, line, m) for i, line in enumerate(raw.splitlines(), 1) for m in own.finditer(line)]
        hits = [i for i, line, m in hits if (not b or line[: m.start()].rstrip().endswith(b)) and (not a or line[m.end() :].lstrip().startswith(a))]
        if n is not None and n == n:
            hits = hits[int(n) - 1 : int(n)] if n >= 1 else []
        return list(dict.fromkeys(hits))

    return pd.Series([one(*r) for r in zip(text, phrase, before, after, nth, strict=True)])


def pattern_lines(marker: Column, text: Column) -> Column:
    """Lines of a pattern's matches; the texts of literal anchors aren't sent to Python."""
    return F.pandas_udf(_pattern_lines, "array<int>")(F.when(marker["regex"], text), marker["phrase"], marker["before"], marker["after"], marker["nth"])


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _pinned(phrase: Column, before: Column, after: Column) -> Column:
    """A pattern of all places of a phrase, with a group at those that follow before and precede after, one space allowed between; null pins hold. So a text is read once, and not from its start for each place."""
    left = F.coalesce(F.concat(F.lit("(?<="), _quoted(before), F.lit("|"), _quoted(before), F.lit(" )")), F.lit(""))
    right = F.coalesce(F.concat(F.lit("(?="), _quoted(after), F.lit("| "), _quoted(after), F.lit(")")), F.lit(""))
    return F.concat(left, F.lit("("), _quoted(phrase), F.lit(")"), right, F.lit("|"), _quoted(phrase))


def _literal_count(marker: Column, flat: Column, nohy: Column) -> Column:
    """Places of a literal phrase in the folded text, else in the one without hyphens; with pins, those in the latter whose neighbours fit."""
    before, after = (F.nullif(norm(marker[s]), F.lit("")) for s in SIDES)

    def counted(phrase: Column, bare: Column) -> Column:
        literal = F.when(F.contains(flat, phrase), count_of(phrase, flat)).otherwise(count_of(bare, nohy))
        held = F.size(F.array_remove(F.regexp_extract_all(nohy, _pinned(bare, dehyphenate(before), dehyphenate(after)), F.lit(1)), ""))
        return F.when(before.isNotNull() | after.isNotNull(), F.when(bare == "", F.lit(0)).otherwise(held)).otherwise(literal)

    return once(norm(marker["phrase"]), lambda phrase: once(dehyphenate(phrase), lambda bare: counted(phrase, bare)))


def _outcome(marker: Column, places: Column) -> Column:
    """struct<found, count, ambiguous> of a marker that fits so many places: #n selects; without it several are ambiguous. Empty phrases and #0 are found nowhere."""
    nth = marker["nth"]
    n = F.when((norm(marker["phrase"]) == "") | (nth < 1), F.lit(0)).otherwise(places)
    found = F.when(nth.isNotNull(), (n >= nth) & (nth >= 1)).otherwise(n > 0)
    return F.struct(F.coalesce(found, F.lit(False)).alias("found"), F.coalesce(n, F.lit(0)).cast("int").alias("count"), F.coalesce(nth.isNull() & (n > 1), F.lit(False)).alias("ambiguous"))


def _pattern_of(marker: Column) -> Column:
    return F.struct(norm(marker["phrase"]).alias("phrase"), *[F.nullif(norm(marker[s]), F.lit("")).alias(s) for s in SIDES])


def resolve(marker: Column, flat: Column, nohy: Column, patterns: bool = True) -> Column:
    """How a marker resolves in the folds of a text. Only the texts of patterns are sent to Python; patterns=False keeps it out of the plan where no anchor is one."""
    n = _literal_count(marker, flat, nohy)
    if patterns:
        own = _pattern_of(marker)
        n = F.when(marker["regex"], F.pandas_udf(_pattern_hits, "int")(F.when(marker["regex"], flat), own["phrase"], own["before"], own["after"])).otherwise(n)
    return once(n, lambda x: _outcome(marker, x))


def _many_hits(flat: pd.Series, patterns: pd.Series) -> pd.Series:
    known = _Patterns()

    def one(hay: str | None, own: list) -> list[int]:
        """Of equal patterns the text is asked once."""
        asked = [None if p is None else (p["phrase"], p["before"], p["after"]) for p in own]
        n = {p: known.hits(hay, *p) for p in set(asked) if p is not None}
        return [n.get(p, 0) for p in asked]

    return pd.Series([one(*r) for r in zip(flat, patterns, strict=True)])


def resolve_all(rows: DataFrame, marks: str = "marks", flat: str = "flat", nohy: str = "nohy") -> DataFrame:
    """rows with an array of markers and the folds of one text, and how each marker resolves in it (column resolved, in order). The text is folded once, and goes to Python once if any is a pattern."""
    m = F.col(marks)
    patterns = F.transform(m, lambda x: F.when(x["regex"], _pattern_of(x)))
    hits = F.pandas_udf(_many_hits, "array<int>")(F.when(F.exists(m, lambda x: x["regex"]), F.col(flat)), patterns)
    out = rows.withColumn("pattern hits", hits)
    places = F.transform(m, lambda x, i: F.when(x["regex"], F.get("pattern hits", i)).otherwise(_literal_count(x, F.col(flat), F.col(nohy))))
    return out.withColumn("resolved", F.zip_with(m, places, _outcome)).drop("pattern hits")
