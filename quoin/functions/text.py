"""Text folds, tokens and predicates as functions from columns to columns. All run in the JVM; null in, null out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are folded, and their replacements.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "…": "..."}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# OCR words that lost a ligature, and what they stand for.
LOST_LIGATURES = {
    "affne": "affine", "artifcial": "artificial", "defne": "define", "defned": "defined", "defnition": "definition", "fltration": "filtration", "fnal": "final",
    "fnancial": "financial", "fnely": "finely", "fner": "finer", "fnite": "finite", "frst": "first", "fssion": "fission", "fxed": "fixed", "modifcation": "modification",
    "nullifcation": "nullification", "refned": "refined", "refning": "refining", "scientifc": "scientific", "suffcient": "sufficient", "suffce": "suffice",
    "suffces": "suffices", "identifcation": "identification", "deflnitely": "definitely", "fllm": "film",
}
# Words of questions that carry no evidence.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her hers him his how i if in into is it its may me might my of on or our ours she "
    "should so than that the their them there these they this those to us was we were what when where which who why will with would you your yours"
).split()
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LINE_BREAKS = r"[\n-\r\x1c-\x1e\x85\u2028-\u2029](?:(?<=\r)\n)?"
# White space beyond ASCII, and with it what norm() and split_words() take for space: a letter is told from them by two comparisons, while (?U)\s asks properties.
WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
BLANKS, SPACES = rf"[\x00-\x20\x7f\x85\xa0{WIDE}]", rf"[\t-\r\x1c-\x20\x85\xa0{WIDE}]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for uses that name the value several times or in a function of elements: it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm(c: Column) -> Column:
    """Control bytes and white space runs as one space, typographic quotes, dashes and ellipses as ASCII, ends trimmed."""
    single = {k: v for k, v in TYPOGRAPHY.items() if len(v) == 1}
    plain = F.replace(F.translate(c, "".join(single), "".join(single.values())), F.lit("…"), F.lit("..."))
    typed = F.when(F.regexp_like(c, F.lit(r"[\u2010-\u2026]")), plain).otherwise(c)
    return F.trim(F.regexp_replace(typed, rf"{BLANKS}(?:{BLANKS}+|(?<! ))", " "))  # a single space stays as it is


def dehyphenate(c: Column) -> Column:
    """Without hyphens and the white space after them."""
    return F.when(F.contains(c, F.lit("-")), F.regexp_replace(c, r"(?U)-\s*", "")).otherwise(c)


def count_of(needle: Column, hay: Column) -> Column:
    """Non-overlapping occurrences; an empty needle has none."""
    size = F.octet_length
    return F.when(size(needle) > 0, ((size(hay) - size(F.replace(hay, needle, F.lit("")))) / size(needle)).cast("int")).otherwise(F.lit(0))


def places_of(needle: Column, hay: Column) -> Column:
    """Positions (from 1) of the non-overlapping occurrences of a needle that isn't empty."""
    parts = F.split(hay, F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x) + F.length(needle)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(x))).alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["out"])


def split_words(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.array_remove(F.split(c, f"{SPACES}+"), "")


def split_lines(c: Column) -> Column:
    """Lines by any line break, without an empty one at the end."""
    return once(F.split(c, LINE_BREAKS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def case_folded(c: Column) -> Column:
    """Lower case with the two foldings that occur in running text: sharp s and final sigma."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, hyphens joined, case folded. For compatibility forms see exact_tokens."""
    between = r"[[\x00-\x2f\x3a-\x60\x7b-\x7f][\x{80}-\x{10ffff}&&[^\p{L}\p{N}]]]+"  # of folded texts; ASCII by ranges, which are quicker than properties
    return F.array_remove(F.split(case_folded(dehyphenate(c)), between), "")


def _plain_ranges() -> list[list[int]]:
    """Ranges of code points that NFKC leaves alone next to any others of them, that fold as lower case does, and that are letters or digits for Python and the JVM alike (so none that either may not know yet): below the first of those that compose by twos."""
    def plain(c: str) -> bool:
        kind = unicodedata.category(c)
        if kind in ("Mn", "Mc", "Me", "Cn", "Co", "Cs") or unicodedata.ucd_3_2_0.category(c) == "Cn" or c in "\x1c\x1d\x1e\x1f\u0130" or not unicodedata.is_normalized("NFKC", c):
            return False
        return c in "ßς" or c.casefold() == c.lower() and len(c.lower()) == 1 and c.isalnum() == (kind[0] == "L" or kind[0] == "N")

    codes, out = [i for i in range(0x1100) if plain(chr(i))], []
    for i in codes:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


def _others(ranges: list[list[int]], low: int, high: int) -> str:
    """A class of the code points from low to high that are in no range, halved down to single gaps: a character is looked up in the halves that it is in, while a flat class asks all of its ranges for each."""
    if len(ranges) < 2:
        gaps = [(low, high)] if not ranges else [(low, ranges[0][0] - 1), (ranges[0][1] + 1, high)]
        own = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in gaps if a <= b)
        return f"[{own}]" if own else ""
    middle = len(ranges) // 2
    cut = ranges[middle][0]
    halves = (low, cut - 1, _others(ranges[:middle], low, cut - 1)), (cut, high, _others(ranges[middle:], cut, high))
    return "[" + "".join(f"[[\\x{{{a:x}}}-\\x{{{b:x}}}]&&{own}]" for a, b, own in halves if own) + "]"


# What isn't plain: most characters of most texts are below 0x80 and need one comparison.
_PLAIN = _plain_ranges()
NOT_PLAIN = rf"[[\x1c-\x1f\x{{80}}-\x{{10ffff}}]&&{_others(_PLAIN, 0, 0x10FFFF)}]"


def is_plain(c: Column) -> Column:
    """Whether tokens() and exact_tokens() of a text are the same by the class of its characters."""
    return ~F.regexp_like(c, F.lit(NOT_PLAIN))


def all_tokens(c: Column) -> Column:
    """exact_tokens, of plain texts in the JVM: only the others are sent to Python."""
    return F.when(is_plain(c), tokens(c)).otherwise(exact_tokens(F.when(~is_plain(c), c)))


def exact_tokens(c: Column) -> Column:
    """The same after NFKC and with full case folding; Arrow batches, for texts in which those matter."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            folded = re.sub(r"-\s*", "", unicodedata.normalize("NFKC", t)).casefold()
            return "".join(ch if ch.isalnum() else " " for ch in folded).split(" ")

        return texts.map(lambda t: None if t is None else [w for w in one(t) if w])

    return F.pandas_udf(run, "array<string>")(c)


def terms(c: Column) -> Column:
    """Distinct words of a question in order, of two characters or more, without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.!?])(?U)\s+")


def fold_ligatures(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)


def ligature_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "".join(LIGATURES), ""))


def restore_lost_ligatures(c: Column) -> Column:
    """Whole words only, in lower, capitalised or upper case."""
    for k, v in LOST_LIGATURES.items():
        for f in (str.lower, str.capitalize, str.upper):
            c = F.regexp_replace(c, rf"\b{f(k)}\b", f(v))
    return c


# What a bad text layer looks like.
TILDES, CAPITALS = "[A-Za-z]+~[A-Za-z]+", r"\b[a-z]{2,}[A-Z]{2}[a-z]*\b"


def corruption_markers(c: Column) -> Column:
    """Tildes within words, and runs of capitals within lower-case words."""
    return F.regexp_count(c, F.lit(TILDES)) + F.regexp_count(c, F.lit(CAPITALS))


def corruption_score(c: Column) -> Column:
    return corruption_markers(c) * 10000.0 / F.greatest(F.size(split_words(c)), F.lit(1))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, half to even."""
    return F.bround(F.length(c) / 4.0).cast("long")


def is_table_line(c: Column) -> Column:
    s = F.trim(c)
    return s.startswith("|") & s.endswith("|") & (F.regexp_count(s, F.lit(r"\|")) >= 2)


def is_page_number(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t[](){}.·*|:—–-")).rlike(r"^\d{1,3}$")


def is_roman_folio(c: Column) -> Column:
    """Of one case, two to seven numerals, and a well-formed number."""
    form = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    return (c.rlike("^[ivxl]{2,7}$") | c.rlike("^[IVX]{2,6}$")) & F.upper(c).rlike(form)


def is_ocr_noise(c: Column) -> Column:
    """Short, without a run of three letters or a digit, and at least half punctuation."""
    core = F.regexp_replace(c, r"(?U)\s", "")
    odd = F.length(F.regexp_replace(core, r"[\p{L}\p{N}]", ""))
    return (F.length(c) <= 12) & ~c.rlike("[A-Za-z]{3,}") & ~c.rlike(r"[\p{Nd}]") & (F.length(core) > 0) & (odd * 2 >= F.length(core))


def may_be_running_head(c: Column) -> Column:
    """A short line with a letter that doesn't end a sentence; it is one where a document repeats it five times."""
    return (F.length(c) <= 40) & (F.size(split_words(c)) <= 6) & c.rlike(r"\p{L}") & ~c.rlike(r"[.!?:;,—\-”']$")


def is_wrapped(c: Column) -> Column:
    """No line of 400 characters or more, and an upper median below 90; null without lines."""
    sizes = F.array_sort(F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.length))
    return F.when(F.size(sizes) == 0, F.lit(False)).otherwise((F.element_at(sizes, -1) < 400) & (F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")) < 90))


def split_pages(c: Column) -> Column:
    """Pages between form feeds, without one empty page at the end."""
    parts = F.split(c, "\f", -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def front_matter(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?s:---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$))", 1)


def field(front: Column, key: str) -> Column:
    """A trimmed front-matter value, null if absent."""
    return F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^\Q{key}\E:\s*(.+)$", 1)), F.lit(""))


def title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def section(c: Column, name: str) -> Column:
    """Body of the last section of a name (case ignored), null if absent."""
    parts = F.filter(F.slice(F.split(c, r"(?m)^##\s+", -1), F.lit(2), F.greatest(F.size(F.split(c, r"(?m)^##\s+", -1)) - 1, F.lit(0))), lambda s: F.lower(F.trim(F.substring_index(s, "\n", 1))) == name)
    last = F.try_element_at(parts, F.lit(-1))
    return F.trim(F.regexp_replace(last, r"^[^\n]*\n?", ""), F.lit(" \n\t"))


def sections(c: Column) -> Column:
    """All sections by their heading in lower case; of equal ones the last counts."""
    parts = F.split(c, r"(?m)^##\s+", -1)
    own = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.struct(F.lower(F.trim(F.substring_index(s, "\n", 1))).alias("k"), F.trim(F.regexp_replace(s, r"^[^\n]*\n?", ""), F.lit(" \n\t")).alias("v")))
    last = F.filter(own, lambda x, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)
