"""The integrity checks of a knowledge base as rows (severity, code, subject, detail). Severity unmeasured is no pass: a check that couldn't run says so.

  A  a card without source, or with a path that is none of a shelf's texts; files that an enumeration missed
  B  a source without card
  C  a source that the bibliography doesn't cover
  D  an index that isn't what the cards are
  F  anchors that their sources no longer hold: of cards and frameworks an error, of syntheses a warning; with strict, ambiguous ones are warned of
  G  a card whose copy of its bibliography line is outdated
  H  a card that is superseded, due for review, or older than its source
  N  an anchor whose window supports the card's claim less than a threshold, by an injected model
  U  what couldn't be checked because a source isn't installed
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.anchors import parse_markers
from quoin.operators import bibliography, entailment
from quoin.operators.grounding import resolved
from quoin.operators.matching import containing
from quoin.runtime import durable

# A fixed value: what a synthesis writes for references across bases instead of cards.
NO_NAMES = ("cross", "ref")


def finding(rows: DataFrame, severity: str | Column, code: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return rows.select((severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def source_path(shelves: list[str], root: str = "library") -> str:
    """The pattern of a source's path: a plain text of a shelf, and nothing that goes on to the left or leaves the shelf."""
    own = "|".join(rf"\Q{s}\E" for s in shelves)
    return rf"(?<![A-Za-z0-9._/-]){'' if root in ('', '.') else rf'\Q{root}\E/'}(?:{own})/[A-Za-z0-9._-]+\.txt"


def is_source_path(rel: Column, pattern: str) -> Column:
    return F.coalesce(rel.rlike(f"^(?:{pattern})$") & ~F.contains(rel, F.lit("\n")), F.lit(False))


def card_path(card: Column) -> Column:
    """Whether an id is the bare name of a card: no separators, nothing empty."""
    return F.coalesce(card.rlike(r"^[^/\\]+$"), F.lit(False))


def card_findings(cards: DataFrame, sources: DataFrame, pattern: str | None = None) -> list[DataFrame]:
    """A, B and U over cards (id, rel) and sources (rel, and id where they have one)."""
    valid = F.lit(True) if pattern is None else is_source_path(F.trim("rel"), pattern)
    blank = F.coalesce(F.trim(F.col("rel").cast("string")) == "", F.lit(True))
    counts = cards.agg(F.count("*").alias("cards")).crossJoin(sources.agg(F.count("*").alias("sources")))
    absent = cards.where(~blank & valid).select("id", "rel").join(sources.select("rel"), "rel", "left_anti")
    some = sources.select(F.lit(1).alias("one")).limit(1)
    orphans = sources.select("rel", "id").join(cards.select("id"), "id", "left_anti") if "id" in sources.columns else sources.select("rel").join(cards.select("rel"), "rel", "left_anti")
    return [
        finding(cards.where(blank), "error", "A", F.col("id"), F.lit("no source")),
        finding(cards.where(~blank & ~valid), "error", "A", F.col("id"), F.col("rel")),
        finding(orphans, "error", "B", F.col("rel")),
        finding(counts.where("cards > 0 and sources = 0"), "unmeasured", "U", F.lit("corpus"), F.col("cards")),
        finding(absent.crossJoin(F.broadcast(some)), "unmeasured", "U", F.col("id"), F.col("rel")),
    ]


def rot_findings(anchors: DataFrame, cards: DataFrame, sources: DataFrame, strict: bool = False) -> list[DataFrame]:
    """F over the anchors (id, marker) of cards."""
    own = anchors.select("id", "marker").join(cards.select("id", "rel").where("rel is not null"), "id")
    done = resolved(own.select("rel", F.col("id").cast("string").alias("owner"), F.lit(0).alias("ord"), "marker"), sources)
    told = done.where(~F.col("found") | (F.lit(strict) & F.col("ambiguous")))  # both severities of one resolution
    detail = F.when(F.col("found"), F.concat_ws(" x ", F.col("count").cast("string"), "phrase")).otherwise(F.col("phrase"))
    return [finding(told, F.when(F.col("found"), "warn").otherwise("error"), "F", F.col("owner"), detail)]


def lens_findings(lenses: DataFrame, rels: DataFrame, sources: DataFrame, severity: str, missing: str) -> list[DataFrame]:
    """F over lenses (name, text) and the sources (name, rel) that each may quote: an anchor holds if any of them has it. missing: the severity of a lens whose sources aren't there."""
    marks = durable(lenses.select("name", F.posexplode(parse_markers(F.col("text"))).alias("ord", "marker")), "marks")  # parsed once for both findings
    there = rels.distinct().join(sources.select("rel"), "rel", "left_semi")
    unread = marks.select("name").distinct().join(there.select("name").distinct(), "name", "left_anti")
    asked = marks.join(there, "name").select("rel", F.col("name").alias("owner"), "ord", "marker")
    done = resolved(asked, sources).groupBy("owner", "ord", "phrase").agg(F.max("found").alias("found"))
    code = "U" if missing == "unmeasured" else "F"
    return [finding(done.where("not found"), severity, "F", F.col("owner"), F.col("phrase")), finding(unread, missing, code, F.col("name"), F.lit("no source of its anchors is there"))]


def named_paths(lenses: DataFrame, pattern: str) -> DataFrame:
    """(name, rel) of the source paths in the texts of lenses (name, text)."""
    return lenses.select("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)))).alias("rel"))


def synthesis_sources(syntheses: DataFrame, cards: DataFrame, frameworks: DataFrame | None, pattern: str) -> DataFrame:
    """(name, rel): the sources of the cards and frameworks that a synthesis lists in its front matter (by names, or beginnings or parts of them), and the paths that it names."""
    listed = F.regexp_extract_all(T.field(T.front_matter(F.col("text")), "cards"), F.lit("([A-Za-z0-9][A-Za-z0-9-]{2,})"), F.lit(1))
    asked = syntheses.select("name", F.explode(F.filter(listed, lambda n: ~n.isin(*NO_NAMES))).alias("part"))
    known = cards.select("id", "rel").where("rel is not null")
    if frameworks is not None:
        known = known.unionAll(named_paths(frameworks, pattern).select("name", "rel"))
    return containing(known, asked, "id", "part").select("name", "rel").unionAll(named_paths(syntheses, pattern))


def index_findings(index: DataFrame | None, cards: DataFrame) -> list[DataFrame]:
    """D over the cards that an index lists (id); None is an index that isn't there."""
    if index is None:
        return [finding(cards.agg(F.count("*").alias("n")), "error", "D", F.lit("index"), F.lit("missing"))]
    both = index.select("id", F.lit(1).alias("listed")).distinct().join(cards.select("id", F.lit(1).alias("present")), "id", "full_outer")
    return [finding(both.where("listed is null or present is null"), "error", "D", F.col("id"), F.when(F.col("listed").isNull(), "not listed").otherwise("not there"))]


def index_entries(texts: DataFrame) -> DataFrame:
    """(id) of the cards that boards (column text) link to under their own name."""
    links = F.regexp_extract_all("text", F.lit(r"\[([^\]\[]+)\]\(\1\.md\)"), F.lit(1))
    return texts.select(F.explode(links).alias("id")).distinct()


def freshness(cards: DataFrame, today: str) -> Column:
    """Reasons why a card (superseded_by, review_by, stored_sha, sha of its source) isn't fresh, in order."""
    due, set_ = F.try_to_date(F.trim("review_by"), "yyyy-MM-dd"), lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    why = [
        F.when(set_("superseded_by"), "superseded"),
        F.when(set_("review_by") & due.isNull(), "review-date-invalid").when(due < F.lit(today).cast("date"), "review-expired"),
        F.when(set_("stored_sha") & (F.trim("stored_sha") != F.col("sha")), "source-changed"),
    ]
    return F.filter(F.array(*why), lambda x: x.isNotNull())


def freshness_findings(cards: DataFrame, sources: DataFrame, today: str) -> list[DataFrame]:
    """H over cards (id, rel, stored_sha, review_by, superseded_by) and sources (rel, text)."""
    rows = cards.join(sources.select("rel", F.sha2("text", 256).alias("sha")), "rel", "left")
    return [finding(rows.select("id", F.explode(freshness(rows, today)).alias("why")), "warn", "H", F.col("id"), F.col("why"))]


def bibliography_findings(sources: DataFrame, cards: DataFrame, rows: DataFrame | None) -> list[DataFrame]:
    """C and G over sources (id), cards (id, card) and the bibliography's lines (at, line); None is one that isn't there."""
    if rows is None:
        return [finding(sources.agg(F.count("*").alias("n")), "error", "C", F.lit("bibliography"), F.lit("missing"))]
    out = [finding(bibliography.uncovered(sources, rows), "warn", "C", F.col("id"))]
    return [*out, finding(bibliography.outdated(cards, rows), "warn", "G", F.col("id"), F.col("copied"))] if "card" in cards.columns else out


def entailment_findings(cards: DataFrame, sources: DataFrame, backend: entailment.Backend, threshold: float) -> list[DataFrame]:
    """N over cards (id, rel, body) and sources (rel, text)."""
    held = cards.select("id", "rel", "body").join(sources.select("rel", "text"), "rel")
    low = entailment.entailed(held, backend).where(F.col("support") < threshold)
    return [finding(low, "warn", "N", F.col("id"), F.col("phrase"))]


def check(
    cards: DataFrame, sources: DataFrame, anchors: DataFrame, today: str, *, index: DataFrame | None = None, indexed: bool = True, pattern: str | None = None, strict: bool = False, frameworks: DataFrame | None = None, syntheses: DataFrame | None = None,
    bibliography_lines: DataFrame | None = None, catalogued: bool = False, missed: DataFrame | None = None, backend: entailment.Backend | None = None, threshold: float = 0.5,
) -> DataFrame:
    """All findings. cards (id, rel, stored_sha, review_by, superseded_by; body for N, card for G), sources (rel, text; id for B and C), anchors (id, marker).

    pattern fences the paths of sources; with it frameworks and syntheses (name, text) are checked too. indexed and catalogued say that an index and a bibliography belong to the base, so
    that None is a finding. missed (name): files on disk that the enumeration lacks. backend adds N.
    """
    parts = [*card_findings(cards, sources, pattern), *rot_findings(anchors, cards.where(is_source_path(F.trim("rel"), pattern)) if pattern else cards, sources, strict), *freshness_findings(cards, sources, today)]
    if indexed or index is not None:
        parts += index_findings(index, cards)
    if catalogued or bibliography_lines is not None:
        parts += bibliography_findings(sources, cards, bibliography_lines)
    if frameworks is not None and pattern:
        parts += lens_findings(frameworks, named_paths(frameworks, pattern), sources, "error", "unmeasured")
    if syntheses is not None and pattern:
        parts += lens_findings(syntheses, synthesis_sources(syntheses, cards, frameworks, pattern), sources, "warn", "warn")
    if missed is not None:
        parts.append(finding(missed, "error", "A", F.col("name"), F.lit("not enumerated")))
    if backend is not None:
        parts += entailment_findings(cards, sources, backend, threshold)
    return reduce(DataFrame.unionByName, parts)
