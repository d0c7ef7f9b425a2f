"""From files to verified sources, and from sources to scaffolded cards and a board."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import agreement, bibliography, normalize
from quoin.operators.services import quality_gate
from quoin.runtime import durable
from quoin.sources import formats, library

MARK = "<!-- scaffold: managed by quoin — edit Thin/Full below the marker by hand -->"


def compare(pairs: DataFrame, width: int = agreement.WINDOW, least: int = agreement.ANCHORS, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """pairs (id, control, candidate): one row of measurements for each id, and its windows. The counts of tokens are written once and shared by both."""
    bag = durable(agreement.bags(agreement.positions(pairs, "control", exact), agreement.positions(pairs, "candidate", exact)), "bag")
    sizes = agreement.containment(bag)
    windows = agreement.window_orders(bag, sizes, width, least)
    return sizes.join(agreement.order_summary(windows), "id"), windows


def verify_extractions(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """rows (id, control, candidate, declared, pages, accepted) with state, reasons and measurements. A null control abstains, unless page provenance speaks for the candidate.

    Texts without any token aren't in the measurements, so their rows have nulls, which abstain as well.
    """
    measured, _ = compare(rows.where("control is not null and candidate is not null").select("id", "control", "candidate"))
    return agreement.decide(rows.select("id", "declared", "pages", "accepted").join(measured, "id", "left"), limits)


def coverage(pages: DataFrame, least_words: int = 5) -> DataFrame:
    """pages (id, text with form feeds; declared where it is known): pages, those with fewer words as numbers from 1, and whether the control itself has another number of pages than declared."""
    p = T.split_pages(F.col("text"))
    few = F.filter(F.transform(p, lambda t, i: F.when(F.size(T.split_words(t)) < least_words, i + 1)), lambda n: n.isNotNull())
    declared = F.col("declared") if "declared" in pages.columns else F.lit(None).cast("int")
    return pages.select("id", F.size(p).alias("pages"), few.alias("empty"), F.coalesce((declared > 0) & (F.size(p) != declared), F.lit(False)).alias("control_mismatch"))


def ingest_files(files: DataFrame, words: frozenset[str] = frozenset()) -> DataFrame:
    """(path, content) to (path, format, text, sha256, source_sha256, refused): extraction, guards, normalisation, guards again. What is refused keeps its reason and has no text.

    files are read once: those of a stream may come under other paths when they are read again, which a join of two readings would lose.
    """
    got = formats.extract(files.select("path", "content", F.sha2("content", 256).alias("source_sha256")), "source_sha256")
    first = quality_gate(got).withColumn("refused", F.coalesce("error", "refused"))
    clean = first.withColumn("text", F.when(F.col("refused").isNull(), normalize.normalize(F.col("text"), words))).withColumnRenamed("refused", "why")
    again = quality_gate(clean).withColumn("refused", F.coalesce("why", "refused"))
    text = F.when(F.col("refused").isNull(), F.col("text"))
    return again.select("path", "format", text.alias("text"), F.sha2(text, 256).alias("sha256"), "source_sha256", "refused")


def provenance(ingested: DataFrame, at: str, limits: dict | None = None, tool: str = "") -> DataFrame:
    """A log row for each accepted file, bound to what was written by its digest, with the limits and the tool it was judged by."""
    told = json.dumps(agreement.LIMITS | (limits or {}), sort_keys=True)
    return ingested.where("refused is null").select("path", "format", "source_sha256", F.col("sha256").alias("output_sha256"), F.lit(at).cast("timestamp").alias("ingested_at"), F.lit(told).alias("limits"), F.lit(tool).alias("tool"))


def scaffold(sources: DataFrame, existing: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """A card text for each source (id, shelf, rel, sha256): what the tool manages, then what was written by hand below the mark of the existing card (id, card), or stubs.

    Running it again changes nothing. A source's line of the bibliography (line, where sources have one) gives its title and is copied. frameworks (rel, framework) point sources to the framework that represents them; of several the last by name counts.
    """
    own = existing.select("id", library.body_below_mark(F.col("card")).alias("body"))
    rows = sources.join(own, "id", "left")
    if frameworks is not None:
        rows = rows.join(frameworks.groupBy("rel").agg(F.max("framework").alias("framework")), "rel", "left")
    else:
        rows = rows.withColumn("framework", F.lit(None).cast("string"))
    stub = F.lit("\n\n## Thin\n_(to be written)_\n\n## Full\n_(to be written)_\n")
    framed = F.when(F.col("framework").isNotNull(), F.concat(F.lit("framework: "), "framework", F.lit("\n"))).otherwise("")
    zoom = F.when(F.contains(F.coalesce("body", F.lit("_(to be written)_")), F.lit("_(to be written)_")), "stub").otherwise("full")
    line = F.col("line") if "line" in rows.columns else F.lit(None).cast("string")
    name = bibliography.source_title(F.col("id"), line)
    copied = F.when(line.isNotNull(), F.concat(F.lit("\n\n**Bibliography.** "), line)).otherwise("")
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\nfile: "), "rel", F.lit("\nshelf: "), "shelf", F.lit("\nzoom: "), zoom, F.lit("\nsource_sha256: "), "sha256", F.lit("\n"), framed, F.lit("---\n# "), name, copied, F.lit(f"\n\n{MARK}"))
    return rows.select("id", F.concat(head, F.coalesce("body", stub)).alias("card"))


def board(cards: DataFrame) -> DataFrame:
    """(shelf, line) of the board: each shelf's cards by id, and how many of them are stubs."""
    own = F.array_sort(F.collect_list("id"))
    g = cards.groupBy("shelf").agg(F.count("*").alias("n"), F.count_if(F.coalesce("zoom", F.lit("stub")) == "stub").alias("stubs"), own.alias("ids"))
    return g.select("shelf", F.concat(F.lit("## "), "shelf", F.lit(" ("), F.col("n").cast("string"), F.lit(", stubs "), F.col("stubs").cast("string"), F.lit(")\n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- "), i)), "\n")).alias("line"))


# A fixed value: a line that no text has, to keep page ends through normalisation.
PAGE_END = "\ue000" * 16


def normalized_pages(pages, words: frozenset[str] = frozenset()):
    """An array of pages, normalised as one document, so that running heads are seen and paragraphs go on over a page's end; as many pages as before, null if a mark was lost."""
    whole = normalize.normalize(F.array_join(pages, f"\n\n{PAGE_END}\n\n"), words)
    parts = F.transform(F.split(whole, rf"\n*{PAGE_END}\n*", -1), lambda p: F.trim(p, F.lit("\n")))
    return F.when(F.size(pages) == 0, pages).when(F.size(parts) == F.size(pages), parts)
