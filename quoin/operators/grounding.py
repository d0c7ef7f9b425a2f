"""Where quoted phrases stand in a corpus, which evidence grounds, and what the integrity checks find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quoin.functions import text as T
from quoin.functions.text import places_of
from quoin.functions.anchors import pattern_lines, resolve, resolve_all
from quoin.functions.patterns import compiled, needed
from quoin.runtime import arrow_limits

PHRASES_MB, ANCHORS = 32, 2048


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every phrase against every document: (phrase_id, id, times) of those that occur, not counting overlaps of a phrase with itself.

    phrases (phrase_id, phrase) are measured first. Up to PHRASES_MB of them become one automaton, which goes through each text once; more are dealt
    over as many automata by a hash, each in a pass of its own. Documents are read, not shuffled. Empty and null phrases occur nowhere.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    wanted = phrases.where("phrase is not null and phrase != ''").select("phrase_id", "phrase")
    size = wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = 1 + size // (PHRASES_MB << 20)
    out = None
    for part in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()
        table: dict[str, list] = {}
        for r in rows:
            table.setdefault(r["phrase"], []).append(r["phrase_id"])
        kind = docs.schema["id"].dataType
        found = docs.select("id", "text").mapInArrow(_matches(table, to_arrow_type(kind)), f"phrase_id long, id {kind.simpleString()}, times int")
        out = found if out is None else out.unionAll(found)
    return out


def _matches(table: dict[str, list], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in table:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            phrase, ids, times = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last: dict[str, tuple[int, int]] = {}
                for end, p in machine.iter(text) if text and table else ():
                    n, until = last.get(p, (0, -1))
                    if end - len(p) + 1 > until:
                        last[p] = n + 1, end
                for p, (n, _) in last.items():
                    for i in table[p]:
                        phrase.append(i), ids.append(doc), times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.int64()), pa.array(ids, kind), pa.array(times, pa.int32())], names=["phrase_id", "id", "times"])

    return run


def pattern_kinds(patterns: DataFrame) -> DataFrame:
    """patterns (pattern_id, pattern) with kind (literal, scan or invalid) and the literals of which each match holds one: patterns of kind scan have to be tried on every text."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = [needed(p) if p is not None else None for p in batch.column(1).to_pylist()]
            kinds = ["invalid" if compiled(p) is None else "scan" if n is None else "literal" for p, n in zip(batch.column(1).to_pylist(), need, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(need, pa.list_(pa.string()))], names=["pattern_id", "pattern", "kind", "literals"])

    return patterns.select("pattern_id", "pattern").mapInArrow(told, "pattern_id long, pattern string, kind string, literals array<string>")


def pattern_hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every pattern against every document (id, text): (pattern_id, id, times) of the pairs that were tried, times 0 where the pattern isn't there; pairs that aren't tried can't match.

    The literals of all patterns are one automaton, which goes through each text once; a pattern is tried only on texts with a literal of its own, or on all if it has none. patterns are measured first: beyond
    PHRASES_MB they are dealt over several passes. Patterns that don't compile are nowhere, as is everything in null texts. Documents are read, not shuffled.
    """
    arrow_limits(docs.sparkSession)
    known = pattern_kinds(patterns).where("kind != 'invalid'")
    size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    parts, out, kind = 1 + size // (PHRASES_MB << 20), None, docs.schema["id"].dataType
    for part in range(parts):
        own = [(r["pattern_id"], r["pattern"], r["literals"]) for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()]
        found = docs.select("id", "text").mapInArrow(_tried(own, to_arrow_type(kind)), f"pattern_id long, id {kind.simpleString()}, times int")
        out = found if out is None else out.unionAll(found)
    return out


def _tried(patterns: list[tuple[int, str, list[str] | None]], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by: dict[str, list[int]] = {}
        for i, (_, _, literals) in enumerate(patterns):
            for x in literals or ():
                by.setdefault(x, []).append(i)
        machine = ahocorasick.Automaton()
        for x in by:
            machine.add_word(x, x)
        machine.make_automaton()
        scans, own = [i for i, p in enumerate(patterns) if p[2] is None], [compiled(p[1]) for p in patterns]
        for batch in batches:
            which, ids, times = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                seen = {x for _, x in machine.iter(text)} if by and text else set()
                for i in sorted({*scans, *(i for x in seen for i in by[x])}):
                    which.append(patterns[i][0]), ids.append(doc), times.append(sum(1 for _ in own[i].finditer(text)))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(ids, kind), pa.array(times, pa.int32())], names=["pattern_id", "id", "times"])

    return run


def folded(sources: DataFrame, text: str = "text") -> DataFrame:
    """Sources with their folds, flat and nohy; materialise them where several operators share them."""
    return sources.withColumn("flat", T.norm(F.col(text))).withColumn("nohy", T.dehyphenate(F.col("flat")))


def resolved(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """asked (rel, owner, ord, marker) over sources (rel, text): (rel, owner, ord, phrase, found, count, ambiguous) of those whose source is there.

    Anchors are gathered by source, so that a source that any quotes is read and folded once; those of a hot source in blocks of ANCHORS or so, each a row with a copy of its text.
    """
    blocks = asked.groupBy("rel").agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    dealt = asked.join(blocks, "rel").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("owner", "ord", "marker.phrase"), F.col("blocks"))).otherwise(F.lit(0)))
    marks = dealt.groupBy("rel", "block").agg(F.collect_list(F.struct("owner", "ord", "marker")).alias("own"))
    rows = folded(marks.join(sources.select("rel", "text"), "rel").withColumn("marks", F.col("own.marker")))
    done = resolve_all(rows).select("rel", F.explode(F.arrays_zip("own", "resolved")).alias("x"))
    return done.select("rel", "x.own.owner", "x.own.ord", F.col("x.own.marker.phrase").alias("phrase"), "x.resolved.found", "x.resolved.count", "x.resolved.ambiguous")


def marker(phrase: Column, regex: Column | None = None, before: Column | None = None, after: Column | None = None, nth: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        phrase.alias("phrase"), (F.lit(False) if regex is None else regex).alias("regex"), (text if before is None else before).alias("before"),
        (text if after is None else after).alias("after"), (F.lit(None).cast("int") if nth is None else nth).alias("nth"),
    )


def by_source(asked: DataFrame, sources: DataFrame, key: str = "card") -> DataFrame:
    """asked (key, marker and more) beside its source of sources (key, text, stored_sha, review_by), with the source's folds and digest, for evidence_status and evidence_context: each is made once for all markers of a source.

    Of a hot source, once for ANCHORS of them or so. Markers of absent sources, or of none, stay, without a text.
    """
    own = [c for c in asked.columns if c != key]
    blocks = asked.groupBy(key).agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    mixed = F.xxhash64(*own)
    block = F.when(F.col(key).isNull(), mixed).when(F.col("blocks") > 1, F.pmod(mixed, F.col("blocks"))).otherwise(F.lit(0))
    marks = asked.join(blocks, key, "left").groupBy(key, block.alias("block")).agg(F.collect_list(F.struct(*own)).alias("own"))
    rows = folded(marks.join(sources.select(key, "text", "stored_sha", "review_by"), key, "left"))
    stamped = F.trim("stored_sha") != ""  # others are compared with nothing
    return rows.withColumn("sha", F.when(stamped, F.sha2("text", 256))).withColumn("x", F.explode("own")).select(key, "x.*", "text", "stored_sha", "review_by", "sha", "flat", "nohy")


def located(mark: Column, text: Column, most: int = 10, patterns: bool = True) -> Column:
    """Numbers of the lines on which a marker stands as it is, its pins and #n honoured; at most so many. Empty where it stands only across folds."""
    phrase = mark["phrase"]
    before, after = F.nullif(mark["before"], F.lit("")), F.nullif(mark["after"], F.lit(""))
    numbered = F.filter(F.transform(T.split_lines(text), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda x: F.contains(x["line"], phrase))

    def own(x: Column) -> Column:
        left = lambda at: F.coalesce(F.endswith(F.rtrim(F.substring(x["line"], F.lit(1), at - 1)), before), F.lit(True))
        right = lambda at: F.coalesce(F.startswith(F.ltrim(F.substring(x["line"], at + F.length(phrase), F.length(x["line"]))), after), F.lit(True))
        return F.transform(F.filter(places_of(phrase, x["line"]), lambda at: left(at) & right(at)), lambda _: x["n"])

    none = F.array().cast("array<int>")
    chosen = lambda every: F.when(mark["nth"].isNull(), every).when(F.size(every) >= mark["nth"], F.slice(every, mark["nth"], F.lit(1))).otherwise(none)
    plain = before.isNull() & after.isNull() & mark["nth"].isNull()  # then places within a line don't matter
    every = F.when(plain, F.transform(numbered, lambda x: x["n"])).otherwise(T.once(F.flatten(F.transform(numbered, own)), chosen))
    out = F.when(F.length(phrase) == 0, none)
    if patterns:
        out = out.when(mark["regex"], F.slice(pattern_lines(mark, text), 1, most))
    return out.when(F.contains(text, phrase), F.slice(F.array_distinct(every), 1, most)).otherwise(none)


def folded_span(mark: Column, text: Column, count: Column) -> Column:
    """struct<lo, hi> of the lines of a phrase that stands only across lines: its words with any white space between. Null unless it can be placed once and without doubt."""
    words = F.transform(T.split_words(mark["phrase"]), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(words, r"(?U:\s+)")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    sure = ~mark["regex"] & mark["before"].isNull() & mark["after"].isNull() & (F.size(words) > 0) & (count == 1) & F.coalesce(mark["nth"] == 1, F.lit(True))

    def span(lines: Column) -> Column:
        first = breaks(F.substring(lines, F.lit(1), F.regexp_instr(lines, pattern) - 1)) + 1
        both = T.once(first, lambda lo: F.struct(lo.alias("lo"), (lo + breaks(F.regexp_substr(lines, pattern))).alias("hi")))
        return F.when(F.regexp_count(lines, pattern) == 1, both)

    return F.when(sure, T.once(F.array_join(T.split_lines(text), "\n"), span))


def evidence_context(rows: DataFrame, today: str, around: int = 3, most: int = 40, require_stamp: bool = False) -> DataFrame:
    """rows with status, and where it grounds and can be placed: usable, line_start, line_end and the lines between as context. What grounds but can't be placed isn't usable."""
    if around < 0 or most < 1:
        raise ValueError("around must be 0 or more, most 1 or more")
    done = evidence_status(rows, today, require_stamp)
    span = F.when(F.col("status") == "found", F.struct(F.array_min("lines").alias("lo"), F.array_max("lines").alias("hi"))).when(F.col("status") == "folded-only", folded_span(F.col("marker"), F.col("text"), F.col("count")))
    lines = T.split_lines(F.col("text"))
    window = F.when(F.col("span").isNotNull(), context_window(F.col("span.lo"), F.col("span.hi"), F.size(lines), around, most))
    out = done.withColumn("span", span).withColumn("w", window)
    text = F.array_join(F.slice(lines, F.col("w.lo"), F.col("w.hi") - F.col("w.lo") + 1), "\n")
    return out.select("*", F.col("w").isNotNull().alias("usable"), F.col("w.lo").alias("line_start"), F.col("w.hi").alias("line_end"), F.when(F.col("w").isNotNull(), text).alias("context")).drop("span", "w")


def evidence_status(rows: DataFrame, today: str, require_stamp: bool = False, patterns: bool = True) -> DataFrame:
    """rows with marker, text (null: not installed), stored_sha, review_by, alone or as by_source gives them: status in the order that is the contract, count and lines. patterns=False where no marker is one.

    source-not-installed, source-stale, not-found (also empty phrases and #0), ambiguous, review-date-invalid, review-expired, source-unstamped, then found, or folded-only where
    no single line holds the phrase.
    """
    own = rows if "flat" in rows.columns else folded(rows).withColumn("sha", F.sha2("text", 256))
    out = own.withColumn("r", resolve(F.col("marker"), F.col("flat"), F.col("nohy"), patterns))
    due = F.try_to_date(F.trim("review_by"), "yyyy-MM-dd")
    stamped = F.nullif(F.trim("stored_sha"), F.lit(""))
    failure = (
        F.when(F.col("text").isNull(), "source-not-installed")
        .when(stamped != F.col("sha"), "source-stale")
        .when((F.trim("marker.phrase") == "") | F.coalesce(F.col("marker.nth") < 1, F.lit(False)) | ~F.col("r.found"), "not-found")
        .when(F.col("r.ambiguous"), "ambiguous")
        .when((F.trim("review_by") != "") & due.isNull(), "review-date-invalid")
        .when(due < F.lit(today).cast("date"), "review-expired")
        .when(F.lit(require_stamp) & stamped.isNull(), "source-unstamped")
    )
    # Lines are looked for only where all else holds, and once.
    out = out.withColumn("failure ", failure).withColumn("at ", F.when(F.col("failure ").isNull(), located(F.col("marker"), F.col("text"), patterns=patterns)))
    held = F.coalesce(F.size("at ") > 0, F.lit(False))
    out = out.withColumn("status", F.coalesce("failure ", F.when(held, "found").otherwise("folded-only")))
    return out.withColumn("count", F.coalesce("r.count", F.lit(0))).withColumn("lines", F.when(held, F.col("at "))).drop("flat", "nohy", "r", "failure ", "at ")


def context_bundle(rows: DataFrame, today: str, around: int = 3, most: int = 40, require_stamp: bool = False) -> DataFrame:
    """rows (bundle, ord, marker, text, stored_sha, review_by): each request of a bundle with its context where it is usable; grounded says whether it counts as evidence, status why not."""
    done = evidence_context(rows, today, around, most, require_stamp)
    return done.withColumn("grounded", F.col("status").isin("found", "folded-only"))


def occurrence_status(rows: DataFrame, most: int = 10) -> DataFrame:
    """rows (phrase, text, stored_sha) with the status of a bare phrase, without review dates, and the lines that hold it, case ignored: source-not-installed, source-stale, not-found,
    ambiguous, then found, or folded-only where no single line holds it."""
    out = folded(rows).withColumn("r", resolve(marker(F.col("phrase")), F.col("flat"), F.col("nohy"), False))
    held = F.filter(F.transform(T.split_lines(F.col("text")), lambda x, i: F.when(F.contains(F.lower(x), F.lower("phrase")), i + 1)), lambda n: n.isNotNull())
    stale = F.nullif(F.trim("stored_sha"), F.lit("")) != F.sha2("text", 256)
    status = F.when(F.col("text").isNull(), "source-not-installed").when(stale, "source-stale").when(~F.col("r.found"), "not-found").when(F.col("r.ambiguous"), "ambiguous").when(F.size(held) > 0, "found").otherwise("folded-only")
    return out.withColumn("status", status).withColumn("lines", F.when(F.col("status") == "found", F.slice(held, 1, most))).drop("flat", "nohy", "r")


def context_window(first: Column, last: Column, lines: Column, around: int = 3, most: int = 40) -> Column:
    """struct<lo, hi>: the match with so many lines on either side, at most `most` lines; of a longer match its beginning."""
    lo, hi, span = F.greatest(F.lit(1), first - around), F.least(lines, last + around), last - first + 1
    lead = F.greatest(F.lit(1), first - F.least(F.lit(around), F.lit(most) - span))
    cut = F.when(span >= most, F.struct(first.alias("lo"), F.least(lines, first + most - 1).alias("hi"))).otherwise(F.struct(lead.alias("lo"), F.least(lines, lead + most - 1).alias("hi")))
    return F.when(hi - lo + 1 <= most, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(cut)


def matching_lines(docs: DataFrame, phrase: str, most: int = 10) -> DataFrame:
    """The first lines of each document that hold the phrase, case ignored: id, line_no, line."""
    lines = docs.select("id", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line")).where(F.contains(F.lower("line"), F.lit(phrase.lower())))
    ranked = lines.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("r") <= most)
    return ranked.select("id", (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("line"))


def report(findings: DataFrame) -> DataFrame:
    """Counts of each severity, and ok: no error and nothing unmeasured."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n("error").alias("errors"), n("warn").alias("warns"), n("unmeasured").alias("unmeasured")).withColumn("ok", (F.col("errors") == 0) & (F.col("unmeasured") == 0))
