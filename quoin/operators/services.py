"""The public verbs over corpus tables, by id, with scope as a filter on kb; and the small operators that they share."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.anchors import parse_markers
from quoin.operators import grounding, retrieval
from quoin.operators.matching import containing
from quoin.runtime import durable

LEVELS = ("meta", "thin", "full", "content")


def zoom(cards: DataFrame, level: str) -> DataFrame:
    """One level of cards: (id, body). content is what a source is, not its text."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    told = {"meta": ("id", "title", "aliases", "zoom"), "content": ("rel", "size", "sha256")}
    return cards.select("id", (F.to_json(F.struct(*told[level])) if level in told else F.col(level)).alias("body"))


def project(sections: Column, projection: str, wanted: Column | None = None) -> Column:
    """A dimension's sections for a reader: writer has craft, engine also what is for machines, sections those that contain a wanted name, full all."""
    if projection == "writer":
        return F.map_filter(sections, lambda k, _: k == "craft")
    if projection == "engine":
        return F.map_filter(sections, lambda k, _: (k == "craft") | k.contains("engine") | k.contains("operational spec") | k.contains("scorer"))
    if projection == "sections":
        return F.map_filter(sections, lambda k, _: F.exists(wanted, lambda w: F.contains(k, F.lower(F.trim(w)))))
    if projection == "full":
        return sections
    raise ValueError(f"unknown projection {projection!r}")


def gist(thin: Column) -> Column:
    """The first line of a thin section that says something."""
    return F.trim(F.try_element_at(F.filter(F.split(thin, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("_("))), F.lit(1)))


def window_of(sentences: Column, folds: Column, fold: Column, around: int = 1) -> Column:
    """The first of a text's sentences whose fold holds that of a phrase, with its neighbours; null if none does."""

    def own(at: Column) -> Column:
        lo = F.greatest(F.lit(1), at - around)
        return F.when(at > 0, F.array_join(F.slice(sentences, lo, F.least(F.size(sentences), at + around) - lo + 1), " "))

    return T.once(F.array_position(F.transform(folds, lambda x: F.contains(x, fold)), True).cast("int"), own)


def sentence_window(text: Column, phrase: Column, around: int = 1) -> Column:
    """The first sentence that holds the folded phrase, with its neighbours; null if none does."""
    return T.once(T.sentences(text), lambda s: T.once(T.norm(phrase), lambda p: window_of(s, F.transform(s, T.norm), p, around)))


def claim_of(text: Column, phrase: Column) -> Column:
    """The sentence of a card that an anchor stands in, without its markers."""
    bare = F.regexp_replace(text, r"\s*\((?:`?(?:grep|search)(?:-re)?:)[^)]*\)", "")
    marked = F.filter(T.sentences(text), lambda x: F.contains(x, phrase))
    return F.coalesce(F.regexp_replace(F.try_element_at(marked, F.lit(1)), r"\s*\((?:`?(?:grep|search)(?:-re)?:)[^)]*\)", ""), F.try_element_at(T.sentences(bare), F.lit(1)))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n(?:[ \t]*\n){2,}", "\n\n")


def safe(text: Column) -> Column:
    """Without control characters, for terminals."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def untrusted(text: Column, label: str = "source") -> Column:
    """Corpus text between marks that it can't close itself."""
    close = f"</untrusted-{label}>"
    return F.concat(F.lit(f"<untrusted-{label}>\n"), F.replace(text, F.lit(close), F.lit(f"<\u200b/untrusted-{label}>")), F.lit(f"\n{close}"))


def visible(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cf}\p{Cc}\p{Zs}\p{Zl}\p{Zp}]", "")


def deadline(size: Column, floor: int = 300, rate: int = 24_000, most: int = 3 * 3600) -> Column:
    """Seconds that a conversion of so many bytes may take."""
    return F.least(F.greatest(F.floor(size / rate), F.lit(floor)), F.lit(most))


def any_of(anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """anchors (owner, marker, rels) that hold in any of the sources (rel, text) they name: found, and how many of the sources aren't there."""
    each = anchors.withColumn("a", F.col("a") if "a" in anchors.columns else F.xxhash64("owner", "marker", "rels")).select("a", "owner", "marker", F.explode_outer("rels").alias("rel"))
    held = grounding.resolved(each.where("rel is not null").select("rel", F.struct("a", "owner").alias("owner"), F.lit(0).alias("ord"), "marker"), sources).groupBy("owner").agg(F.max("found").alias("found"), F.count("*").alias("there"))
    n = each.groupBy("a", "owner").agg(F.count("*").alias("n"))
    done = n.join(held.select("owner.a", "found", "there"), "a", "left")
    return done.select("a", "owner", F.coalesce("found", F.lit(False)).alias("found"), (F.col("n") - F.coalesce("there", F.lit(0))).alias("absent"))


def panel_names(synthesis: DataFrame, cards: DataFrame) -> DataFrame:
    """synthesis (owner, name) to cards (id): the same name, one that goes on with a hyphen, or one that contains it; the best kind only."""
    quality = F.when(F.col("id") == F.col("name"), 0).when(F.startswith("id", F.concat("name", F.lit("-"))), 1).otherwise(2)
    pairs = containing(cards, synthesis, "id", "name").withColumn("kind", quality)
    best = pairs.groupBy("owner", "name").agg(F.min("kind").alias("kind"))
    return synthesis.join(pairs.join(best, ["owner", "name", "kind"]).select("owner", "name", "kind", "id"), ["owner", "name"], "left")


# How telling a failure is; of equal ones the later card's counts.
REASONS = {"not-found": 1, "source-not-installed": 2, "ambiguous": 3, "source-unstamped": 4, "source-stale": 5, "review-expired": 5, "review-date-invalid": 5}


def worst_reason(rows: DataFrame, by: str = "anchor") -> DataFrame:
    """rows (anchor, ord, status) of one anchor over a panel: found if one card holds it, ambiguous-panel if several do, else the most telling failure, the later of equal ones."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("status")], F.lit(0))
    good = F.col("status").isin("found", "folded-only")
    g = rows.groupBy(by).agg(F.count_if(good).alias("n"), F.max_by("status", F.when(~good, F.struct(rank, "ord"))).alias("why"))
    return g.select(by, F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous-panel").otherwise(F.col("why")).alias("status"))


def balanced_scores(runs: DataFrame) -> DataFrame:
    """runs (draft, criterion, score) of one judge in several orders: the mean, half up, and the spread."""
    return runs.groupBy("draft", "criterion").agg(F.round(F.avg(F.col("score").cast("decimal(18,6)"))).cast("int").alias("score"), (F.max("score") - F.min("score")).alias("spread"))


def better_tier(tiers: Column, keep: float = 0.5) -> Column:
    """Of candidate extractions (tier, words, score) in the order they are tried: the next replaces the one held only if it keeps half its words or more and has less corruption."""

    def step(cur: Column, new: Column) -> Column:
        ok = (new["words"] > 0) & ((cur["words"] == 0) | ((new["words"] >= cur["words"] * keep) & (new["score"] < cur["score"])))
        return F.when(ok, new).otherwise(cur)

    first = F.element_at(tiers, 1)
    return F.aggregate(F.slice(tiers, F.lit(2), F.greatest(F.size(tiers) - 1, F.lit(0))), first, step)


def quality_gate(texts: DataFrame) -> DataFrame:
    """Reasons to refuse an extraction before it is written: no words, more than a tenth control characters; null if none."""
    c = F.col("text")
    control = (F.length(c) - F.length(F.regexp_replace(c, T.CONTROL, ""))) / F.greatest(F.length(c), F.lit(1))
    words = F.size(T.split_words(F.regexp_replace(c, T.CONTROL, " ")))
    return texts.withColumn("refused", F.when(c.isNull() | (F.size(T.split_words(c)) == 0), "no words").when(control > 0.1, "control characters").when(words == 0, "no words left"))


def zoom_counts(cards: DataFrame) -> DataFrame:
    """cards (zoom, aliases): how many there are of each zoom (stub where none is set), and how many of them have aliases."""
    zoom = F.coalesce(F.nullif(F.trim("zoom"), F.lit("")), F.lit("stub"))
    return cards.groupBy(zoom.alias("zoom")).agg(F.count("*").alias("cards"), F.count_if(F.coalesce(F.trim("aliases"), F.lit("")) != "").alias("aliased"))


def duplicates(sources: DataFrame) -> DataFrame:
    """sources (id, text) that stand in the corpus more than once: their digest, how often, and the smallest id."""
    return sources.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def composition(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """One row on a base of cards (body) and sources (size): how many there are, megabytes of sources, and anchors of cards."""
    n = cards.agg(F.count("*").alias("cards"), F.coalesce(F.sum(F.size(parse_markers(F.col("body")))), F.lit(0)).alias("anchors"))
    return n.crossJoin(sources.agg(F.count("*").alias("sources"), F.coalesce(F.round(F.sum("size") / 1e6, 6), F.lit(0.0)).alias("megabytes")))


def _kept_words(shown: Column, extracted: Column, least: int) -> Column:
    """(recall, order) of two arrays of words: sorted together, equal words are runs, so that no shuffle brings together what one row holds."""
    word = lambda side: lambda t, i: F.struct(t.alias("t"), F.lit(side).alias("side"), i.alias("i"))

    def rank_order(own: Column) -> Column:
        """Of (pa, pb), words that both sides have once: their ranks have no ties, so the closed form is exact."""
        far = F.transform(F.array_sort(F.transform(F.array_sort(own), lambda w, x: F.struct(w["pb"].alias("pb"), x.alias("x")))), lambda w, y: F.pow((w["x"] - y).cast("double"), 2))
        n = F.size(own).cast("double")
        return F.when(F.size(own) >= max(2, least), 1 - 6 * F.aggregate(far, F.lit(0.0), lambda s, d: s + d) / (n * (n * n - 1)))

    def told(own: Column) -> Column:
        first = F.filter(F.transform(own, lambda w, i: F.when((i == 0) | (w["t"] != F.get(own, i - 1)["t"]), i)), lambda i: i.isNotNull())
        runs = T.once(first, lambda at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i)))
        twos = lambda r: F.filter(r, lambda w: (F.size(w) == 2) & (w[0]["side"] == 0) & (w[1]["side"] == 1))
        n = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + x["side"])
        both = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda s, w: s + T.once(n(w), lambda b: F.least(b, F.size(w) - b)))
        order = lambda r: T.once(F.transform(twos(r), lambda w: F.struct(w[0]["i"].alias("pa"), w[1]["i"].alias("pb"))), rank_order)
        return T.once(runs, lambda r: F.struct(both(r).alias("both"), order(r).alias("order")))

    measured = lambda s, e: T.once(F.array_sort(F.concat(F.transform(s, word(0)), F.transform(e, word(1)))), told)
    recall = lambda s, m: F.struct(F.try_divide(m["both"], F.nullif(F.size(s), F.lit(0))).alias("recall"), m["order"].alias("order"))
    return T.once(shown, lambda s: T.once(measured(s, extracted), lambda m: recall(s, m)))


def page_recall(pages: DataFrame, least: int = 4) -> DataFrame:
    """pages (doc, page, shown, extracted), a row each: the share of the shown page's words, with their number, that the extraction has, and the rank correlation of words that both have once.

    recall is null where the page shows no word or there is no extraction of it (error); order is null below `least` such words.
    """
    words = lambda c: F.coalesce(T.tokens(F.col(c)), F.array().cast("array<string>"))
    rows = pages.select("doc", "page", F.when(F.col("extracted").isNull(), "no text of this page").alias("error"), _kept_words(words("shown"), words("extracted"), least).alias("m"))
    return rows.select("doc", "page", F.when(F.col("error").isNull(), F.col("m.recall")).alias("recall"), F.when(F.col("error").isNull(), F.col("m.order")).alias("order"), "error")


def card_passages(cards: DataFrame, question: str, today: str, k: int = 5, around: int = 2) -> tuple[DataFrame, DataFrame]:
    """The first route of evidence: anchors of cards (id, body, text, stored_sha, review_by) in paragraphs that bear on a question, each with the lines around it.

    (id, rank, start, end, score, passage), the best k of each card by twice the marker's score and the paragraph's, passages of the same lines once; and (id, issue): why other anchors
    of such paragraphs aren't usable.
    """
    terms = T.terms(F.lit(question))
    paras = cards.select("id", F.posexplode(F.split("body", r"\n\s*\n")).alias("place", "para"))
    scored = paras.withColumn("para_score", retrieval.passage_score(F.col("para"), terms, F.lit(question))).where("para_score > 0")
    marks = scored.select("*", F.posexplode(parse_markers(F.col("para"))).alias("ord", "marker"))
    rows = marks.withColumn("score", 2 * retrieval.passage_score(F.col("marker.phrase"), terms, F.lit(question)) + F.col("para_score")).drop("para")
    beside = grounding.by_source(rows.select("id", "place", "ord", "score", "marker"), cards, "id")
    done = durable(grounding.evidence_context(beside, today, around, 40).select("id", "place", "ord", "score", "status", "usable", "line_start", "line_end", "context"), "passages")
    once = done.where("usable").groupBy("id", "line_start", "line_end").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), (-F.col("ord")).alias("o"))).alias("best"), F.first("context").alias("context"))
    order = Window.partitionBy("id").orderBy(F.desc("best.score"), F.desc("best.p"), F.desc("best.o"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    passages = ranked.select("id", "rank", F.col("line_start").cast("long").alias("start"), F.col("line_end").cast("long").alias("end"), F.col("best.score").alias("score"), retrieval.excerpt(F.col("context"), terms).alias("passage"))
    return passages, done.where("not usable").select("id", F.col("status").alias("issue")).distinct()


def retrieve_evidence(cards: DataFrame, question: str, today: str = "0001-01-01", k: int = 5, full_text: bool = False, around: int = 2) -> DataFrame:
    """(id, status, route, rank, start, end, score, passage, full_text, issues): citable passages for a question, of cards (id, title, body, text, stored_sha, review_by).

    Anchors of cards come first; where a card has no usable one, or full_text is asked for, the blocks of its whole source are searched, without its title's words. Sources that
    aren't installed, or are stale, give none. insufficient where there is none; evidence-found says that the passages stand there, not that they answer.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be 1 or more, not {k!r}")
    if isinstance(around, bool) or not isinstance(around, int) or around < 0:
        raise ValueError(f"around must be 0 or more, not {around!r}")
    question = question.strip()
    none = F.lit(None).cast("string")
    rows = cards.select("id", "body", "text", *[(F.col(c) if c in cards.columns else none).alias(c) for c in ("title", "stored_sha", "review_by")])
    stale = F.coalesce(F.nullif(F.trim("stored_sha"), F.lit("")) != F.sha2("text", 256), F.lit(False))
    issue = F.when(F.col("text").isNull(), "source-not-installed").when(stale, "source-stale")
    found, asked = None, F.size(T.terms(F.lit(question))) > 0
    rest, issues = rows, rows.select("id", issue.alias("issue")).where("issue is not null")
    if not full_text:
        anchors, unusable = card_passages(rows.where(asked), question, today, k, around)
        found = durable(anchors.select("id", F.lit("card-anchor").alias("route"), "rank", "start", "end", "score", "passage"), "anchors")
        rest, issues = rows.join(found.select("id").distinct(), "id", "left_anti"), issues.unionAll(unusable).distinct()
    read = rest.where(issue.isNull() & asked)
    blocks = retrieval.evidence(read.select(F.col("id").alias("doc_id"), "text", "title"), question, k)
    blocks = blocks.select("id", F.lit("full-text"), "rank", F.col("start").cast("long"), F.col("end").cast("long"), "score", "excerpt")
    all_ = blocks.toDF("id", "route", "rank", "start", "end", "score", "passage") if found is None else found.unionAll(blocks)
    why = issues.groupBy("id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    out = rows.select("id").join(all_, "id", "left").join(why, "id", "left").join(read.select("id", F.lit(True).alias("full_text")), "id", "left")
    status = F.when(F.col("route").isNull(), "insufficient").otherwise("evidence-found")
    return out.select("id", status.alias("status"), "route", "rank", "start", "end", "score", "passage", F.coalesce("full_text", F.lit(False)).alias("full_text"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


@dataclass(frozen=True)
class Service:
    """A verb: its id, whether it runs over several knowledge bases, and what it computes from tables and parameters."""

    id: str
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    fanout: bool = False
    needs: tuple[str, ...] = field(default=())


def _bounded(params: dict, key: str, low: int, high: int, default: int) -> int:
    """A whole number of the parameters within bounds; true is none."""
    v = params.get(key, default)
    return max(low, min(high, v)) if isinstance(v, int) and not isinstance(v, bool) else default


def _search(t: dict, q: dict) -> DataFrame:
    asked = t["cards"].sparkSession.createDataFrame([(0, list(q["terms"]))], "question int, terms array<string>")
    parts = ["id", *[F.coalesce(c, F.lit("")) for c in ("title", "aliases", "thin")], *([F.coalesce("full", F.lit(""))] if q.get("full") else [])]
    blobs = t["cards"].select("id", F.lower(F.concat_ws(" ", *parts)).alias("blob"))
    return retrieval.top_k(retrieval.bm25(blobs, asked), _bounded(q, "limit", 1, 1000, 20)).drop("question")


def _consult(t: dict, q: dict) -> DataFrame:
    return retrieval.consult(t["lenses"].sparkSession.createDataFrame([(0, q["name"])], "query_id int, name string"), retrieval.folded_lenses(t["lenses"], t.get("framework_sources")))


def _diagnose(t: dict, q: dict) -> DataFrame:
    return retrieval.diagnose(t["diagnostics"].sparkSession.createDataFrame([(0, q["symptom"])], "symptom_id int, symptom string"), t["diagnostics"], t.get("dimensions"))


def _verify(t: dict, q: dict) -> DataFrame:
    if q.get("occurrence"):
        return grounding.occurrence_status(t["evidence"].withColumn("phrase", F.lit(q["phrase"])), _bounded(q, "max_lines", 1, 1000, 10)).select("id", "status", "lines")
    asked = parse_markers(F.lit(q["phrase"]))
    bare = grounding.marker(F.lit(q["phrase"]))
    return grounding.evidence_status(t["evidence"].withColumn("marker", F.coalesce(F.try_element_at(asked, F.lit(1)), bare)), q["today"], q.get("require_stamp", False)).select("id", "status", "lines")


def _check(t: dict, q: dict) -> DataFrame:
    from quoin.operators import linter

    return linter.check(
        t["cards"], t["sources"], t["anchors"], q["today"], index=t.get("index"), indexed=q.get("indexed", "index" in t), pattern=q.get("pattern"), strict=bool(q.get("strict")), frameworks=t.get("frameworks"), syntheses=t.get("syntheses"),
        bibliography_lines=t.get("bibliography"), catalogued=bool(q.get("catalogued")), missed=t.get("missed"), backend=q.get("backend"), threshold=q.get("threshold", 0.5),
    )


def _build(t: dict, q: dict) -> DataFrame:
    """(path, text) of the cards, new or as they should be."""
    from quoin.operators import bibliography, ingestion

    sources = t["sources"].select("id", "shelf", "rel", "sha256")
    if "bibliography" in t:
        sources = sources.join(bibliography.lookup(sources, t["bibliography"]), "id")
    made = ingestion.scaffold(sources, t["existing"], t.get("framework_sources"))
    return made.select(F.concat(F.lit(q.get("cards", "cards") + "/"), "id", F.lit(".md")).alias("path"), F.col("card").alias("text"))


def _normalize(t: dict, q: dict) -> DataFrame:
    """(rel, text, normal) of the sources that would change."""
    from quoin.operators import normalize

    return normalize.changed(t["sources"], frozenset(q.get("words", ()))).select("rel", "text", "normal")


def _ingest(t: dict, q: dict) -> DataFrame:
    from quoin.operators import ingestion

    return ingestion.ingest_files(t["files"], frozenset(q.get("words", ())))


def _review(t: dict, q: dict) -> DataFrame:
    from quoin.operators import gate

    return gate.review(t["rubrics"], t["panel_cards"], t["pinned"], t["scores"], q["today"], q.get("hurdle", 60), q.get("require_stamp", True))


def _settings(t: dict, q: dict) -> DataFrame:
    from quoin.sources import settings

    rows = [(s.name, None if s.value is None else str(s.value), s.source) for s in settings.resolve(q.get("arguments"), q.get("file")).values()]
    return q["spark"].createDataFrame(rows, "name string, value string, source string")


def _init(t: dict, q: dict) -> DataFrame:
    """(path, text) of a new base."""
    from quoin.sources import library

    shelves = list(q.get("shelves") or ["books"])
    toml = f"id = {json.dumps(q['id'])}\nshelves = {json.dumps(shelves)}\n"
    library.manifest(toml, ".")
    rows = [("library.toml", toml), ("cards/README.md", "# Cards\n"), *[(f"{s}/.keep", "") for s in shelves]]
    return q["spark"].createDataFrame(rows, "path string, text string")


def _services() -> dict[str, Service]:
    every = (
        Service("search", _search, True, ("cards",)),
        Service("zoom", lambda t, q: zoom(t["cards"].where(F.col("id") == q["id"]), q.get("level", "thin")), False, ("cards",)),
        Service("cards", lambda t, q: t["cards"].select("id", "title", "shelf", "zoom"), True, ("cards",)),
        Service("lenses", lambda t, q: t["lenses"].select("kind", "name", "title"), True, ("lenses",)),
        Service("kbs", lambda t, q: t["kbs"], False, ("kbs",)),
        Service("consult", _consult, True, ("lenses",)),
        Service("diagnose", _diagnose, True, ("diagnostics",)),
        Service("verify", _verify, False, ("evidence",)),
        Service("evidence", lambda t, q: retrieve_evidence(t["evidence"], q["question"], q["today"], _bounded(q, "limit", 1, 100, 5), bool(q.get("full_text"))), False, ("evidence",)),
        Service("check", _check, True, ("cards", "sources", "anchors")),
        Service("build", _build, False, ("sources", "existing")),
        Service("normalize", _normalize, False, ("sources",)),
        Service("ingest", _ingest, False, ("files",)),
        Service("review", _review, False, ("rubrics", "panel_cards", "pinned", "scores")),
        Service("settings", _settings),
        Service("init", _init),
    )
    if len({s.id for s in every}) < len(every):
        raise ValueError("two operations share an id")
    return {s.id: s for s in every}


SERVICES = _services()
FANOUT = 10


def scope(op: str, kbs: list[str] | None) -> tuple[list[str] | None, int]:
    """The bases that an operation runs over, the first ten by id, and how many are left out."""
    if op not in SERVICES:
        raise ValueError(f"unknown operation {op!r}")
    if kbs is not None and len(set(kbs)) > 1 and not SERVICES[op].fanout:
        raise ValueError(f"{op} is for one knowledge base")
    chosen = None if kbs is None else sorted(set(kbs))
    return (None, 0) if chosen is None else (chosen[:FANOUT], max(0, len(chosen) - FANOUT))


def execute(op: str, tables: dict[str, DataFrame], params: dict, kbs: list[str] | None = None) -> DataFrame:
    """Run a verb over tables whose column kb, where they have one, is its scope; several bases for a verb that fans out, the first ten by id. Bases that can't be read are rows of kbs, not here."""
    chosen, _ = scope(op, kbs)
    service = SERVICES[op]
    if missing := [n for n in service.needs if n not in tables]:
        raise ValueError(f"{op} needs the tables {missing}")
    held = {k: t.where(F.col("kb").isin(*chosen)) if chosen is not None and "kb" in t.columns else t for k, t in tables.items()}
    return service.run(held, params)


def framework_default(sections: Column) -> Column:
    """What is shown of a framework unless more is asked for: engine, practices, disagreement; all of it if it has none of them."""
    some = F.map_filter(sections, lambda k, _: k.isin("engine", "practices", "disagreement"))
    return F.when(F.size(some) > 0, some).otherwise(sections)


def source_of_framework(frameworks: DataFrame, shelves: list[str], root: str = "library") -> DataFrame:
    """frameworks (name, text): the first source path that each names, as (rel, framework); of several frameworks of a source the last by name."""
    quoted = "|".join(rf"\Q{s}\E" for s in shelves)
    path = rf"(?<![A-Za-z0-9._/-])\Q{root}\E/(?:{quoted})/[A-Za-z0-9._-]+\.txt"
    named = frameworks.select(F.nullif(F.regexp_extract("text", path, 0), F.lit("")).alias("rel"), "name").where("rel is not null")
    return named.groupBy("rel").agg(F.max("name").alias("framework"))


def triage_row(texts: DataFrame, name: str) -> DataFrame:
    """The row of a triage table (column text, in parts in the order of place where there is one) for a dimension: its bold name first, else the first row that has the name's first part anywhere."""
    place = F.col("place") if "place" in texts.columns else F.lit(0)
    rows = texts.select(place.alias("place"), F.posexplode(T.split_lines(F.col("text"))).alias("at", "line")).where(F.startswith("line", F.lit("|")))
    bold = F.contains(F.lower("line"), F.lit("**" + name.replace("-", "/").lower()))
    loose = F.contains(F.lower("line"), F.lit(name.split("-")[0].lower()))
    best = F.min_by("line", F.struct(F.when(bold, 0).otherwise(1), "place", "at"))
    return rows.where(bold | loose).agg(F.trim(best).alias("row")).where("row is not null")
