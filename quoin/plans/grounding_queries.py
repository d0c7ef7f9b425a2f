"""Phrases of benchmark in documents: occurrences, resolution, taxonomy, windows, and the integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.anchors import parse_markers, resolve_all
from quoin.operators import grounding as G
from quoin.operators import linter as L
from quoin.plans.registry import query
from quoin.plans.text_queries import docs, sql_norm
from quoin.runtime import durable, table

TODAY = "2026-01-01"
FLAT = sql_norm("text")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


@query("SELECT item_id AS phrase_id, doc_id AS id, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::INT AS times FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def f5_occurrence_counts(spark, sf_dir):
    return G.phrase_hits(texts(spark, sf_dir), phrases(spark, sf_dir))


def _flat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in folded documents; where the flat fold has none of a phrase, the one without hyphens decides."""
    own = durable(G.folded(texts(spark, sf_dir)).select("id", "flat", "nohy"), "folded")
    marks = phrases(spark, sf_dir).withColumn("phrase", T.norm(F.col("phrase")))
    flat = G.phrase_hits(own.select("id", F.col("flat").alias("text")), marks)
    bare = G.phrase_hits(own.select("id", F.col("nohy").alias("text")), marks.withColumn("phrase", T.dehyphenate(F.col("phrase"))))
    return flat.unionAll(bare.join(flat, ["phrase_id", "id"], "left_anti"))


_J7 = f"""f AS (SELECT doc_id AS id, {FLAT} AS flat FROM documents), n AS (SELECT id, flat, regexp_replace(flat, '-\\s*', '', 'g') AS nohy FROM f), p AS (SELECT item_id, {FLAT} AS p FROM benchmark), q AS (SELECT *, regexp_replace(p, '-\\s*', '', 'g') AS pd FROM p),
  h AS (SELECT item_id AS phrase_id, id, CASE WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) ELSE (length(nohy) - length(replace(nohy, pd, ''))) // length(pd) END AS times FROM n, q WHERE contains(flat, p) OR contains(nohy, pd))"""


@query(f"WITH {_J7} SELECT item_id AS phrase_id, count(id)::BIGINT AS documents, coalesce(sum(times), 0)::BIGINT AS times, CASE WHEN count(id) = 0 THEN 'not-found' WHEN count(id) > 1 THEN 'ambiguous-panel' WHEN sum(times) > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM q LEFT JOIN h ON h.phrase_id = item_id GROUP BY item_id")
def j7_anchor_corpus_join(spark, sf_dir):
    """Every anchor against every document: several documents that hold it make the panel ambiguous."""
    hits = _flat_hits(spark, sf_dir).groupBy("phrase_id").agg(F.count("*").alias("documents"), F.sum("times").alias("times"))
    n, t = F.coalesce("documents", F.lit(0)), F.coalesce("times", F.lit(0))
    status = F.when(n == 0, "not-found").when(n > 1, "ambiguous-panel").when(t > 1, "ambiguous").otherwise("found")
    return phrases(spark, sf_dir).select("phrase_id").join(hits, "phrase_id", "left").select("phrase_id", n.alias("documents"), t.alias("times"), status.alias("status"))


# Each document's own anchors: a word of its first line, plain, pinned by what stands before it, numbered; one that no text has; the word as a pattern, numbered too; a broken pattern.
_OWN_SQL = """w AS (SELECT doc_id AS id, text, string_split(split_part(text, E'\\n', 1), ' ') AS l FROM documents), k AS (SELECT id, text, l[2] AS phrase, l[1] AS first, regexp_replace(l[2], '[^a-z]', '.', 'g') AS pattern FROM w WHERE len(l) > 2),
  a AS (SELECT id, text, 'plain' AS kind, phrase, NULL AS before, NULL::INT AS nth FROM k UNION ALL SELECT id, text, 'pinned', phrase, first, NULL FROM k UNION ALL SELECT id, text, 'second', phrase, NULL, 2 FROM k UNION ALL SELECT id, text, 'absent', 'no such phrase', NULL, NULL FROM k
    UNION ALL SELECT id, text, 'pattern', pattern, NULL, NULL FROM k UNION ALL SELECT id, text, 'pattern second', pattern, NULL, 2 FROM k UNION ALL SELECT id, text, 'broken', '(' || phrase, NULL, NULL FROM k)"""
_BARE = "regexp_replace(%s, '-\\s*', '', 'g')"


def own_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, kinds, marks): the anchors of each document with a first line of three words or more."""
    words = F.split(F.substring_index("text", "\n", 1), " ")
    second, pattern, yes = F.element_at("l", 2), F.regexp_replace(F.element_at("l", 2), "[^a-z]", "."), F.lit(True)
    marks = {
        "plain": G.marker(second), "pinned": G.marker(second, before=F.element_at("l", 1)), "second": G.marker(second, nth=F.lit(2)), "absent": G.marker(F.lit("no such phrase")),
        "pattern": G.marker(pattern, yes), "pattern second": G.marker(pattern, yes, nth=F.lit(2)), "broken": G.marker(F.concat(F.lit("("), second), yes),
    }
    rows = texts(spark, sf_dir).withColumn("l", words).where(F.size("l") > 2)
    return rows.select("id", "text", F.array(*map(F.lit, marks)).alias("kinds"), F.array(*marks.values()).alias("marks"))


@query(f"""WITH {_OWN_SQL}, n AS (SELECT *, {FLAT} AS flat, trim(phrase) AS p FROM a), o AS (SELECT *, {_BARE % 'flat'} AS nohy, {_BARE % 'p'} AS pd, {_BARE % 'before'} AS bd FROM n),
  s AS (SELECT id, kind, nth, CASE WHEN p = '' OR kind = 'broken' THEN 0 WHEN kind IN ('pattern', 'pattern second') THEN len(regexp_extract_all(flat, p)) WHEN kind = 'pinned' THEN (CASE WHEN pd = '' THEN 0 ELSE len(list_filter(range(2, len(x) + 1), lambda i: ends_with(list_reduce(x[:i - 1], lambda u, v: u || pd || v), bd) OR ends_with(list_reduce(x[:i - 1], lambda u, v: u || pd || v), bd || ' '))) END)
    WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) WHEN pd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, pd, ''))) // length(pd) END AS n FROM (SELECT *, string_split(nohy, pd) AS x FROM o))
  SELECT id, kind, CASE WHEN nth IS NULL THEN n > 0 ELSE n >= nth END AS found, n::INT AS count, nth IS NULL AND n > 1 AS ambiguous FROM s""")
def f7_resolution_status(spark, sf_dir):
    """How each document's own anchors resolve: literal, pinned by context, numbered, patterns."""
    rows = resolve_all(G.folded(own_anchors(spark, sf_dir))).select("id", F.explode(F.arrays_zip("kinds", "resolved")).alias("k"))
    return rows.select("id", F.col("k.kinds").alias("kind"), "k.resolved.found", "k.resolved.count", "k.resolved.ambiguous")


_CARD_SQL = """b AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS rel, CASE doc_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN '' ELSE sha256(text) END AS stored, CASE doc_id % 7 WHEN 0 THEN '2025-06-30' WHEN 1 THEN 'soon' WHEN 2 THEN '2030-01-01' ELSE NULL END AS review_by,
  split_part(split_part(text, E'\\n', 1), ' ', 2) || CASE WHEN doc_id % 3 = 0 THEN ' ' || split_part(split_part(text, E'\\n', 1), ' ', 3) WHEN doc_id % 3 = 1 THEN ' ' || split_part(replace(text, E'\\n', ' '), ' ', 3) || ' ' || split_part(replace(text, E'\\n', ' '), ' ', 4) ELSE '' END AS plain FROM documents),
  c AS (SELECT *, id % 17 = 5 AS is_re, CASE WHEN id % 17 = 5 THEN regexp_replace(plain, '[^a-z ]', '.', 'g') ELSE plain END AS phrase,
    CASE WHEN id % 11 = 0 THEN NULL WHEN id % 23 = 7 THEN 'library/../' || id || '.txt' WHEN id % 19 = 4 THEN 'library/src0/none-' || id || '.txt' ELSE 'library/' || source || '/' || id || '.txt' END AS path FROM b)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each document, some without source, stale, unstamped or due for review, with an anchor from its first words, some of them patterns; path is where its source should be."""
    d, c = F.col("doc_id"), F.col("text")
    first, all_ = F.substring_index(c, "\n", 1), F.replace(c, F.lit("\n"), F.lit(" "))
    word = lambda t, i: F.split_part(t, F.lit(" "), F.lit(i))
    more = F.when(d % 3 == 0, F.concat(F.lit(" "), word(first, 3))).when(d % 3 == 1, F.concat(F.lit(" "), word(all_, 3), F.lit(" "), word(all_, 4))).otherwise("")
    stored = F.when(d % 5 == 0, "stale").when(d % 5 == 1, "").otherwise(F.sha2(c, 256))
    review = F.when(d % 7 == 0, "2025-06-30").when(d % 7 == 1, "soon").when(d % 7 == 2, "2030-01-01")
    at = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    path = F.when(d % 23 == 7, at("library/../", d, ".txt")).when(d % 19 == 4, at("library/src0/none-", d, ".txt")).otherwise(at("library/", F.col("source"), "/", d, ".txt"))
    rows = docs(spark, sf_dir).select(d.alias("id"), F.when(d % 11 != 0, d).alias("rel"), stored.alias("stored_sha"), review.alias("review_by"), F.when(d % 13 == 0, "newer").alias("superseded_by"), F.concat(word(first, 2), more).alias("plain"), F.when(d % 11 != 0, path).alias("path"), at("library/", F.col("source"), "/", d, ".txt").alias("own_path"), "text")
    pattern = F.col("id") % 17 == 5
    return rows.withColumn("regex", pattern).withColumn("phrase", F.when(pattern, F.regexp_replace("plain", "[^a-z ]", ".")).otherwise(F.col("plain")))


_RES_SQL = f"""{_CARD_SQL}, e AS (SELECT c.*, d.text, {FLAT.replace('text', 'd.text')} AS flat, {sql_norm('phrase')} AS p FROM c LEFT JOIN documents d ON d.doc_id = c.rel), g AS (SELECT *, {_BARE % 'flat'} AS nohy, {_BARE % 'p'} AS pd FROM e),
  x AS (SELECT *, CASE WHEN p = '' THEN 0 WHEN is_re THEN len(regexp_extract_all(flat, p)) WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) WHEN pd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, pd, ''))) // length(pd) END AS n,
    CASE WHEN is_re THEN len(list_filter(string_split(text, E'\\n'), lambda l: regexp_matches(l, phrase))) > 0 ELSE contains(text, phrase) AND len(list_filter(string_split(text, E'\\n'), lambda l: contains(l, phrase))) > 0 END AS on_line FROM g)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir)
    rows = c.drop("text").join(c.select(F.col("id").alias("rel"), "text"), "rel", "left")
    return rows.withColumn("marker", G.marker(F.col("phrase"), F.col("regex")))


@query(f"""WITH {_RES_SQL} SELECT id, CASE WHEN text IS NULL THEN 'source-not-installed' WHEN stored <> '' AND stored <> sha256(text) THEN 'source-stale' WHEN trim(phrase) = '' OR n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous'
  WHEN review_by = 'soon' THEN 'review-date-invalid' WHEN review_by < '{TODAY}' THEN 'review-expired' WHEN on_line THEN 'found' ELSE 'folded-only' END AS status FROM x""")
def r3_verify_evidence(spark, sf_dir):
    """The strict verifier's status of each card's anchor, patterns included; the order of its cases is the contract."""
    return G.evidence_status(_evidence(spark, sf_dir), TODAY).select("id", "status")


_PLAIN_SQL = _RES_SQL.replace("is_re, CASE WHEN id % 17 = 5 THEN regexp_replace(plain, '[^a-z ]', '.', 'g') ELSE plain END AS phrase", "is_re0, false AS is_re, plain AS phrase")


@query(f"""WITH {_PLAIN_SQL} SELECT id, CASE WHEN text IS NULL THEN 'source-not-installed' WHEN stored <> '' AND stored <> sha256(text) THEN 'source-stale' WHEN n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous'
  WHEN len(list_filter(string_split(text, E'\\n'), lambda l: contains(lower(l), lower(phrase)))) > 0 THEN 'found' ELSE 'folded-only' END AS status FROM x""")
def r2_verify_taxonomy(spark, sf_dir):
    """A bare phrase in its source, without review dates; lines are looked up whatever their case."""
    return G.occurrence_status(_evidence(spark, sf_dir).withColumn("phrase", F.col("plain"))).select("id", "status")


@query(f"""WITH {_RES_SQL}, r AS (SELECT id, CASE WHEN text IS NULL THEN 'source-not-installed' WHEN stored <> '' AND stored <> sha256(text) THEN 'source-stale' WHEN trim(phrase) = '' OR n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous' WHEN review_by = 'soon' THEN 'review-date-invalid' WHEN review_by < '{TODAY}' THEN 'review-expired'
    WHEN stored = '' THEN 'source-unstamped' WHEN on_line THEN 'found' ELSE 'folded-only' END AS status FROM x)
  SELECT id, id % 10 AS bundle, (id // 10)::BIGINT AS ord, status, status IN ('found', 'folded-only') AS grounded FROM r""")
def r5_context_bundle(spark, sf_dir):
    """Bundles of requests in their order, each grounded or rejected with its reason; unstamped sources are refused."""
    rows = _evidence(spark, sf_dir).withColumn("bundle", F.col("id") % 10).withColumn("ord", F.expr("id DIV 10"))
    return G.context_bundle(rows, TODAY, require_stamp=True).select("id", "bundle", "ord", "status", "grounded")


@query("""SELECT id, line_no, line FROM (SELECT id, line_no, trim(line) AS line, row_number() OVER (PARTITION BY id ORDER BY line_no) AS r FROM (SELECT doc_id AS id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents)) WHERE contains(lower(line), 'tion')) WHERE r <= 10""")
def k4_matching_lines(spark, sf_dir):
    return G.matching_lines(texts(spark, sf_dir), "tion", 10).select("id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""WITH l AS (SELECT doc_id AS id, string_split(text, E'\\n') AS l FROM documents), m AS (SELECT id, len(l) AS n, l, list_position(list_transform(l, lambda x: contains(x, 'on')), true) AS f FROM l), w AS (SELECT id, greatest(1, f - 3) AS lo, least(n, f + 3) AS hi, l FROM m WHERE f > 0)
  SELECT id, lo::BIGINT AS lo, hi::BIGINT AS hi, sha256(array_to_string(l[lo:hi], E'\\n')) AS window_sha FROM w""")
def w4_context_window(spark, sf_dir):
    """Three lines on either side of the first line that holds a phrase."""
    lines = texts(spark, sf_dir).select("id", F.split("text", "\n").alias("l"))
    first = F.array_position(F.transform("l", lambda x: F.contains(x, F.lit("on"))), True).cast("int")
    rows = lines.withColumn("f", first).where("f > 0").withColumn("w", G.context_window(F.col("f"), F.col("f"), F.size("l"), 3, 40))
    text = F.array_join(F.slice("l", F.col("w.lo"), F.col("w.hi") - F.col("w.lo") + 1), "\n")
    return rows.select("id", F.col("w.lo").cast("long").alias("lo"), F.col("w.hi").cast("long").alias("hi"), F.sha2(text, 256).alias("window_sha"))


@query("SELECT doc_id AS id, (length(array_to_string(x[:3], 'the')) + 1)::BIGINT AS place FROM (SELECT doc_id, string_split(text, 'the') AS x FROM documents) WHERE len(x) > 3")
def w6_nth_occurrence(spark, sf_dir):
    """Where a phrase occurs the third time."""
    place = F.try_element_at(T.places_of(F.lit("the"), F.col("text")), F.lit(3))
    return texts(spark, sf_dir).select("id", place.cast("long").alias("place")).where("place is not null")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 11 = 0")
def j2_orphan_anti(spark, sf_dir):
    """Sources without a card."""
    c = cards(spark, sf_dir)
    return c.select("id").join(c.where("rel is not null").select(F.col("rel").alias("id")), "id", "left_anti")


@query("SELECT coalesce(i.id, c.id) AS id, CASE WHEN i.id IS NULL THEN 'not-listed' ELSE 'not-there' END AS problem FROM (SELECT doc_id + 5 AS id FROM documents WHERE doc_id % 3 > 0) i FULL JOIN (SELECT doc_id AS id FROM documents) c ON i.id = c.id WHERE i.id IS NULL OR c.id IS NULL")
def j3_index_fullouter(spark, sf_dir):
    """An index that is out of date against the cards, both ways."""
    d = docs(spark, sf_dir)
    listed = d.where(F.col("doc_id") % 3 > 0).select((F.col("doc_id") + 5).alias("id"), F.lit(1).alias("i"))
    both = listed.join(d.select(F.col("doc_id").alias("id"), F.lit(1).alias("c")), "id", "full_outer").where("i is null or c is null")
    return both.select("id", F.when(F.col("i").isNull(), "not-listed").otherwise("not-there").alias("problem"))


SHELVES = [f"src{i}" for i in range(64)]


@query(f"""WITH {_RES_SQL}, v AS (SELECT *, path IS NOT NULL AND NOT contains(path, '..') AS valid, path = 'library/' || source || '/' || id || '.txt' AS there FROM x), f AS (
  SELECT 'error' AS severity, 'A' AS code, id::VARCHAR AS subject FROM v WHERE NOT valid UNION ALL SELECT 'unmeasured', 'U', id::VARCHAR FROM v WHERE valid AND NOT there UNION ALL SELECT 'error', 'B', 'library/' || source || '/' || doc_id || '.txt' FROM documents WHERE doc_id % 29 = 3
  UNION ALL SELECT 'error', 'D', doc_id::VARCHAR FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'error', 'F', id::VARCHAR FROM v WHERE there AND n = 0 UNION ALL SELECT 'warn', 'F', id::VARCHAR FROM v WHERE there AND n > 1
  UNION ALL SELECT 'warn', 'H', id::VARCHAR FROM v WHERE there AND stored <> '' AND stored <> sha256(text) UNION ALL SELECT 'warn', 'H', id::VARCHAR FROM v WHERE review_by = 'soon' OR review_by < '{TODAY}' UNION ALL SELECT 'warn', 'H', id::VARCHAR FROM v WHERE id % 13 = 0)
  SELECT severity, code, subject, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
def c_integrity_findings(spark, sf_dir):
    """The linter over cards whose paths are missing, outside the shelves or not installed, with literal anchors and patterns; strict, so ambiguous anchors are told."""
    c = cards(spark, sf_dir).withColumn("rel", F.col("path")).withColumn("id", F.col("id").cast("string"))
    d = F.col("id").cast("long")
    sources = c.select(F.col("own_path").alias("rel"), F.when(d % 29 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), "text")
    anchors = c.select("id", G.marker(F.col("phrase"), F.col("regex")).alias("marker"))
    found = L.check(c.drop("text"), sources, anchors, TODAY, index=c.where(d % 3 > 0).select("id"), pattern=L.source_path(SHELVES), strict=True)
    return found.groupBy("severity", "code", "subject").agg(F.count("*").alias("n"))


@query(f"""WITH {_RES_SQL} SELECT id, n::INT AS count, CASE WHEN n = 0 THEN 'error' ELSE 'warn' END AS severity FROM x WHERE text IS NOT NULL AND n <> 1""")
def c_f_citation_rot(spark, sf_dir):
    """Anchors, patterns too, that their own source no longer holds, or holds in several places."""
    c = cards(spark, sf_dir)
    asked = c.where("rel is not null").select("rel", F.col("id").alias("owner"), F.lit(0).alias("ord"), G.marker(F.col("phrase"), F.col("regex")).alias("marker"))
    rows = G.resolved(asked, c.select(F.col("id").alias("rel"), "text")).where("count != 1")
    return rows.select(F.col("owner").alias("id"), "count", F.when(F.col("count") == 0, "error").otherwise("warn").alias("severity"))


_LENS_SQL = """l AS (SELECT doc_id AS id, source, text, split_part(split_part(text, E'\\n', 1), ' ', 2) AS word FROM documents WHERE trim(split_part(split_part(text, E'\\n', 1), ' ', 2)) <> ''),
  z AS (SELECT id, 'lens-' || id AS name, CASE WHEN id % 4 = 0 THEN 'zzz ' || word ELSE word END AS phrase, id % 6 AS kind FROM l WHERE NOT contains(word, '`') AND NOT contains(word, '"'))"""


def _lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, phrase, kind) of a lens for each document: a sixth name no source, a sixth one that isn't there."""
    word = F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))
    rows = docs(spark, sf_dir).where((F.trim(word) != "") & ~F.contains(word, F.lit("`")) & ~F.contains(word, F.lit('"')))
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("lens-"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("zzz "), word)).otherwise(word).alias("phrase"), (F.col("doc_id") % 6).alias("kind"), "source")


_HELD = f"""{_LENS_SQL}, h AS (SELECT z.*, d.text IS NOT NULL AS there, {FLAT.replace('text', 'd.text')} AS flat FROM z LEFT JOIN documents d ON d.doc_id = z.id), r AS (SELECT *, contains(flat, trim(phrase)) OR (replace(trim(phrase), '-', '') <> '' AND contains({_BARE % 'flat'}, {_BARE % 'trim(phrase)'})) AS held FROM h)"""


@query(f"""WITH {_HELD} SELECT 'error' AS severity, 'F' AS code, name AS subject FROM r WHERE kind > 1 AND NOT held UNION ALL SELECT 'unmeasured', 'U', name FROM r WHERE kind <= 1""")
def c_f_frameworks(spark, sf_dir):
    """Anchors of frameworks in any source that these name; without one that is there, nothing was measured."""
    f = _lenses(spark, sf_dir)
    path = F.when(F.col("kind") == 0, "none").when(F.col("kind") == 1, "mylibrary/src0/x.txt, library/src1/gone.txt").otherwise(F.concat(F.lit("library/"), "source", F.lit("/"), F.col("id").cast("string"), F.lit(".txt")))
    texts_ = f.select("name", F.concat(F.lit("**Source:** `"), path, F.lit("`\n(grep: `"), "phrase", F.lit("`)")).alias("text"))
    sources = docs(spark, sf_dir).select(F.concat(F.lit("library/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), "text")
    pattern = L.source_path(SHELVES)
    parts = L.lens_findings(texts_, L.named_paths(texts_, pattern), sources, "error", "unmeasured")
    return parts[0].unionByName(parts[1]).select("severity", "code", "subject")


@query(f"""WITH {_HELD} SELECT 'warn' AS severity, 'F' AS code, name AS subject FROM r WHERE kind <= 1 OR NOT held""")
def c_f_syntheses(spark, sf_dir):
    """Anchors of syntheses in the sources of the cards that they list by name: both a lost anchor and a synthesis without sources are warnings."""
    f = _lenses(spark, sf_dir)
    named = F.when(F.col("kind") == 0, "cross, ref").when(F.col("kind") == 1, "no-such-card").otherwise(F.concat(F.lit("cards-"), F.col("id").cast("string"), F.lit("-end (cross-ref)")))
    texts_ = f.select("name", F.concat(F.lit("---\ncards: ["), named, F.lit("]\n---\n(grep: `"), "phrase", F.lit("`)")).alias("text"))
    d = docs(spark, sf_dir)
    rel = F.concat(F.lit("library/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    own = d.select(F.concat(F.lit("cards-"), F.col("doc_id").cast("string"), F.lit("-end")).alias("id"), rel.alias("rel"))
    pattern = L.source_path(SHELVES)
    parts = L.lens_findings(texts_, L.synthesis_sources(texts_, own, None, pattern), d.select(rel.alias("rel"), "text"), "warn", "warn")
    return parts[0].unionByName(parts[1]).select("severity", "code", "subject")


@query(f"""WITH {_CARD_SQL} SELECT id, CASE WHEN id % 13 = 0 THEN 'superseded' WHEN review_by = 'soon' THEN 'review-date-invalid' WHEN review_by < '{TODAY}' THEN 'review-expired' WHEN stored <> '' AND stored <> sha256(d.text) THEN 'source-changed' END AS why FROM c LEFT JOIN documents d ON d.doc_id = c.rel
  WHERE id % 13 = 0 OR review_by = 'soon' OR review_by < '{TODAY}' OR (stored <> '' AND stored <> sha256(d.text))""")
def c_h_freshness(spark, sf_dir):
    """The first reason why a card isn't fresh."""
    rows = _evidence(spark, sf_dir).withColumn("sha", F.sha2("text", 256))
    return rows.select("id", F.try_element_at(L.freshness(rows, TODAY), F.lit(1)).alias("why")).where("why is not null")


@query(f"""WITH {_RES_SQL}, s AS (SELECT *, CASE WHEN text IS NULL THEN 'source-not-installed' WHEN stored <> '' AND stored <> sha256(text) THEN 'source-stale' WHEN trim(phrase) = '' OR n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous' WHEN review_by = 'soon' THEN 'review-date-invalid' WHEN review_by < '{TODAY}' THEN 'review-expired' WHEN on_line THEN 'found' ELSE 'folded-only' END AS status,
    CASE WHEN ends_with(text, E'\\n') THEN text[:-2] ELSE text END AS t, array_to_string(list_transform(list_filter(string_split(p, ' '), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+') AS pat FROM x),
  l AS (SELECT *, string_split(t, E'\\n') AS l FROM s), m AS (SELECT *, CASE WHEN status = 'found' THEN list_position(list_transform(l, lambda y: CASE WHEN is_re THEN regexp_matches(y, phrase) ELSE contains(y, phrase) END), true) WHEN status = 'folded-only' AND NOT is_re AND len(regexp_extract_all(t, pat)) = 1 THEN length(string_split_regex(t, pat)[1]) - length(replace(string_split_regex(t, pat)[1], E'\\n', '')) + 1 END AS lo FROM l),
  h AS (SELECT *, CASE WHEN status = 'folded-only' THEN lo + length(regexp_extract(t, pat, 0)) - length(replace(regexp_extract(t, pat, 0), E'\\n', '')) ELSE lo END AS hi FROM m)
  SELECT id, status, lo IS NOT NULL AS usable, CASE WHEN lo > 0 THEN greatest(1, lo - 3) END::INT AS line_start, CASE WHEN lo > 0 THEN least(len(l), hi + 3) END::INT AS line_end, CASE WHEN lo > 0 THEN sha256(array_to_string(l[greatest(1, lo - 3):least(len(l), hi + 3)], E'\\n')) END AS context_sha FROM h""")
def r4_verify_context(spark, sf_dir):
    """Each card's anchor with the lines around it, where it grounds and can be placed."""
    rows = G.evidence_context(_evidence(spark, sf_dir), TODAY)
    return rows.select("id", "status", "usable", "line_start", "line_end", F.sha2("context", 256).alias("context_sha"))


@query("""SELECT item_id, ord::INT AS ord, CASE WHEN ord = 0 THEN regexp_replace(text, '[`"\\n]', ' ', 'g') ELSE phrase END AS phrase, ord = 3 AS regex, CASE WHEN ord = 0 THEN 'a b' END AS before, NULL::VARCHAR AS after, CASE WHEN ord = 0 THEN 2 END::INT AS nth
  FROM benchmark, (VALUES (0, ''), (1, 'q r'), (2, 'other'), (3, 'z.*'), (4, 'lone')) t(ord, phrase)""")
def f4_parse_markers(spark, sf_dir):
    """Anchors in every spelling, parsed from a card text built around each benchmark passage."""
    t = F.regexp_replace("text", "[`\"\n]", " ")
    card = F.concat(F.lit("x (grep: `"), t, F.lit("` before `a b` #2) y (`search: \"q r\"`; `other`) research: `no` (grep-re: `z.*`) (`grep:` `lone`)"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parse_markers(card)).alias("ord", "m")).select("item_id", "ord", "m.*")


_PATTERNS = [(1, "qu[a-z]+ing", ["ing"]), (2, "(?:the|and) [a-z]+tion", ["tion"]), (3, "[0-9]+", None), (4, "lo+rem|ips(?:u|o)m", ["ipsom", "ipsum", "rem"]), (5, "colou?r", ["colo"]), (6, "(unclosed", None), (7, "(?i)TION", None), (8, "reau[^a-z]", ["reau"]), (9, "un(?:e|d) [^ ]+ent", ["und ", "une "])]
_HELD = "unnest([w[2], w[3], w[4], w[5]]) AS x"
_PATTERN_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, $${p}$$, {'NULL' if n is None else n})" for i, p, n in _PATTERNS if i != 6) + """) t(pattern_id, pattern, literals) UNION ALL
  SELECT 1000 + item_id, array_to_string(list_transform(w[2:5], lambda x: regexp_escape(x)), '[ \\n]+'), [(SELECT u.x FROM (SELECT unnest(w[2:5]) AS x, generate_subscripts(w[2:5], 1) AS i) u ORDER BY length(u.x) DESC, u.i LIMIT 1)] FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))"""


@query(f"""WITH p AS {_PATTERN_SQL}, h AS (SELECT pattern_id, pattern, literals, doc_id, literals IS NULL OR length(literals[1]) < 2 OR len(list_filter(literals, lambda l: contains(text, l))) > 0 AS tried, len(regexp_extract_all(text, pattern)) AS times FROM p, documents WHERE text IS NOT NULL)
  SELECT pattern_id, count(*) FILTER (tried)::BIGINT AS tried, count(*) FILTER (times > 0)::BIGINT AS docs, sum(times)::BIGINT AS times FROM h WHERE tried GROUP BY pattern_id""")
def j7_pattern_corpus(spark, sf_dir):
    """Patterns, some given and one of each benchmark passage, over all documents: how many texts reach the pattern at all, how many hold it, and how often."""
    given = spark.createDataFrame([(i, p) for i, p, _ in _PATTERNS], "pattern_id long, pattern string")
    words = F.transform(F.slice(F.split("text", " "), 2, 4), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    own = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("pattern_id"), F.array_join(words, r"[ \n]+").alias("pattern"))
    done = G.pattern_hits(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), given.unionAll(own))
    return done.groupBy("pattern_id").agg(F.count("*").alias("tried"), F.count_if(F.col("times") > 0).alias("docs"), F.sum("times").alias("times"))
