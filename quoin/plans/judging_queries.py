"""Raters, verdicts, extraction tiers and boards over labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import evaluation, gate
from quoin.plans.registry import query
from quoin.operators.grounding import marker
from quoin.plans.grounding_queries import FLAT
from quoin.plans.text_queries import docs, sql_norm
from quoin.runtime import table

_PAIRS = "(SELECT 'c' || doc_id % 4 AS criterion, 1 + (doc_id % 4 > 0)::INT AS scale, quality + (doc_id % 4 > 0)::INT * (doc_id % 2) AS x, (CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END) + (doc_id % 4 > 0)::INT * (doc_id // 3 % 2) AS y FROM labels)"
_SHARES = "count(*)::BIGINT AS n, round(avg((x = y)::INT), 6) AS exact, round(avg((abs(x - y) <= 1)::INT), 6) AS adjacent"
_KAPPA = "round(CASE WHEN count(*) >= 2 THEN 1 - avg((x - y) * (x - y)) / nullif(round(var_pop(x) + var_pop(y) + (avg(x) - avg(y)) ** 2, 12), 0) END, 6)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters on four criteria, made from labels: the second disagrees with the first on some rows."""
    d, q, wide = F.col("doc_id"), F.col("quality"), (F.col("doc_id") % 4 > 0).cast("int")
    y = F.when(d % 9 == 0, 1 - q).otherwise(q) + wide * F.expr("(doc_id DIV 3) % 2")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), (d % 4).cast("string")).alias("criterion"), (1 + wide).alias("scale"), (q + wide * (d % 2)).alias("x"), y.alias("y"))


@query(f"SELECT criterion, {_KAPPA} AS qwk FROM {_PAIRS} GROUP BY criterion")
def a9_qwk(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.groupBy("criterion").agg(F.round(evaluation.weighted_kappa(F.col("x").cast("double"), F.col("y").cast("double")), 6).alias("qwk"))


@query(f"""SELECT criterion, {_SHARES}, {_KAPPA} AS qwk, CASE WHEN {_KAPPA} IS NULL THEN 'undefined' WHEN {_KAPPA} < 0.6 THEN 'under-specified' ELSE 'ok' END AS verdict FROM {_PAIRS} GROUP BY criterion
  UNION ALL SELECT 'OVERALL', {_SHARES}, CASE WHEN count(DISTINCT scale) = 1 THEN {_KAPPA} END, NULL FROM {_PAIRS}""")
def a10_agreement_report(spark, sf_dir):
    """For each criterion and over all; the overall kappa is withheld as scales differ."""
    return evaluation.rater_agreement(pairs(spark, sf_dir))


_SCALE = [("d", f"c{i}", top) for i, top in enumerate((3, 7, 5, 10))]
_SCORES = "(SELECT doc_id AS draft, 'c' || i AS criterion, t[i + 1] AS top, (doc_id * (i + 3) + quality * 5) % (t[i + 1] + CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END) AS score FROM (SELECT *, [3, 7, 5, 10] AS t FROM labels), range(4) r(i) WHERE NOT (doc_id % 8 = 1 AND i = 2))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores for each labelled document; some drafts lack one, some go over the scale."""
    top = {c: t for _, c, t in _SCALE}
    score = lambda i: (F.col("doc_id") * (i + 3) + F.col("quality") * 5) % (top[f"c{i}"] + F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1))
    each = F.array(*[F.struct(F.lit(f"c{i}").alias("criterion"), score(i).alias("score")) for i in range(4)])
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("draft"), F.lit("d").alias("dimension"), F.explode(each).alias("s")).select("draft", "dimension", "s.*")
    return rows.where(~((F.col("draft") % 8 == 1) & (F.col("criterion") == "c2")))


def scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SCALE, "dimension string, criterion string, top int")


@query(f"""SELECT draft, (sum(score * (210 // top)) * 100 // (4 * 210))::BIGINT AS points, sum(score * (210 // top)) * 100 >= 70 * 4 * 210 AS go, coalesce(string_agg(criterion, ',' ORDER BY score / top, criterion) FILTER (WHERE score * 100 < top * 70), '') AS defects
  FROM {_SCORES} GROUP BY draft HAVING count(*) = 4 AND bool_and(score <= top)""")
def a12_verdict(spark, sf_dir):
    """Exact verdicts of the drafts whose scores are complete and in range, with the criteria below the hurdle, worst first."""
    v = gate.verdicts(scale(spark), scores(spark, sf_dir), 70)
    return v.select("draft", "points", "go", F.array_join("defects", ",").alias("defects"))


@query(f"SELECT draft, 'c2' AS criterion, 'missing' AS problem FROM (SELECT DISTINCT draft FROM {_SCORES} WHERE draft % 8 = 1) UNION ALL SELECT draft, criterion, 'range' FROM {_SCORES} WHERE score > top")
def j17_score_problems(spark, sf_dir):
    return gate.score_problems(scale(spark), scores(spark, sf_dir)).select("draft", "criterion", "problem")


_RUNS = """(SELECT doc_id AS doc, tier, CASE WHEN (doc_id + k) % (k + 4) > 0 THEN ((doc_id * (k + 7)) % 97) / 97.0 END AS recall, CASE WHEN (doc_id + k) % (k + 4) > 0 THEN ((doc_id * (2 * k + 5)) % 89) / 89.0 - CASE WHEN k = 1 THEN 0.8 ELSE 0.2 END END AS orders FROM documents, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) t(tier, k))"""
TIERS = ["alpha", "beta", "gamma", "unused"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results of three tiers with failures; a fourth tier never ran."""
    d, out = F.col("doc_id"), None
    for k, tier in enumerate(TIERS[:3]):
        ran = (d + k) % (k + 4) > 0
        one = docs(spark, sf_dir).select(d.alias("doc"), F.lit(tier).alias("tier"), F.when(ran, (d * (k + 7)) % 97 / 97.0).alias("recall"), F.when(ran, (d * (2 * k + 5)) % 89 / 89.0 - (0.8 if k == 1 else 0.2)).alias("orders"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT tier, count(*)::BIGINT AS attempted, count(recall)::BIGINT AS measured, (count(*) - count(recall))::BIGINT AS failed FROM {_RUNS} GROUP BY tier UNION ALL SELECT 'unused', count(*), 0, count(*) FROM documents")
def a13_tier_totals(spark, sf_dir):
    return evaluation.tier_totals(runs(spark, sf_dir), TIERS)


@query(f"""WITH r AS (SELECT * FROM {_RUNS} WHERE recall IS NOT NULL), s AS (SELECT doc FROM r GROUP BY doc HAVING count(*) = 3), p AS (SELECT tier, count(*) AS docs, round(median(recall), 6) AS median_recall, round(min(recall), 6) AS worst_recall, round(list_sort(list(recall))[floor(0.1 * (count(*) - 1))::INT + 1], 6) AS p10_recall, round(median(orders), 6) AS median_order FROM r JOIN s USING (doc) GROUP BY tier)
  SELECT tier, docs::BIGINT AS docs, median_recall::DOUBLE AS median_recall, worst_recall::DOUBLE AS worst_recall, p10_recall::DOUBLE AS p10_recall, median_order::DOUBLE AS median_order, row_number() OVER (ORDER BY median_order < 0, median_recall DESC, tier) AS rank FROM p""")
def a13_paired_ranking(spark, sf_dir):
    """Tiers ranked on the documents that all of them measured; a tier whose order is inverted comes last."""
    r = evaluation.paired_ranking(runs(spark, sf_dir), TIERS)
    return r.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT coalesce(source, 'all') AS shelf, coalesce(lang, 'all') AS zoom, count(*)::BIGINT AS cards, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def a3_board_rollup(spark, sf_dir):
    """The board: cards by shelf and kind, with totals."""
    r = docs(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("cards"), F.sum("n_chars").alias("chars"))
    return r.select(F.coalesce("source", F.lit("all")).alias("shelf"), F.coalesce("lang", F.lit("all")).alias("zoom"), "cards", "chars")


@query("SELECT doc_id AS card, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 IN (1, 4) THEN 'unpinned' ELSE 'drifted' END AS problem FROM documents WHERE doc_id % 6 IN (0, 1, 2, 4)")
def j18_fingerprint(spark, sf_dir):
    """Panels of a card each against live sources: not installed, pinned as null, pinned as something else, or not among the pins at all."""
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("card"), F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 6).alias("k"))
    rubrics = d.select(F.col("card").alias("dimension"), F.array("card").alias("panel"))
    pinned = d.where("k != 4").select(F.col("card").alias("dimension"), "card", F.when(F.col("k") == 1, F.lit(None)).when(F.col("k") == 2, "0").otherwise(F.col("sha")).alias("pinned"))
    return gate.fingerprint(gate.pins(rubrics, pinned), d.where("k != 0").select("card", "sha")).select(F.col("card").cast("long").alias("card"), "problem")


_CITED = "SELECT doc_id, split_part(split_part(text, E'\\n', 1), ' ', 2) AS phrase FROM documents"


@query(f"""WITH p AS ({_CITED}), f AS (SELECT p.doc_id, p.phrase, {FLAT.replace('text', 'd.text')} AS flat, {sql_norm('phrase')} AS n FROM p JOIN documents d ON d.doc_id = p.doc_id), g AS (SELECT *, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, regexp_replace(n, '-\\s*', '', 'g') AS nd FROM f),
  k AS (SELECT doc_id, CASE WHEN n = '' THEN 0 WHEN contains(flat, n) THEN (length(flat) - length(replace(flat, n, ''))) // length(n) WHEN nd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, nd, ''))) // length(nd) END AS c FROM g)
  SELECT 'aim-' || doc_id % 20 || 'x' AS criterion, count(*)::BIGINT AS bindings, sum((c = 1)::INT)::BIGINT AS grounded, (ARRAY_AGG(CASE WHEN c = 0 THEN 'not-found' ELSE 'ambiguous' END ORDER BY doc_id) FILTER (WHERE c <> 1))[1] AS first_failure FROM k GROUP BY 1 UNION ALL SELECT 'bare-' || doc_id, 0, 0, 'not-grounded' FROM documents WHERE doc_id % 50 = 7""")
def j8_declared_binding(spark, sf_dir):
    """Each binding against the one card that it declares; a criterion's first failure in the order of its bindings, or that it has none."""
    d = docs(spark, sf_dir)
    bound = d.select(F.lit("d").alias("dimension"), F.concat(F.lit("aim-"), (F.col("doc_id") % 20).cast("string"), F.lit("x")).alias("criterion"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("card"), marker(F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))).alias("marker"))
    bare = d.where("doc_id % 50 = 7").select(F.lit("d").alias("dimension"), F.concat(F.lit("bare-"), F.col("doc_id").cast("string")).alias("criterion"), *[F.lit(None).cast(bound.schema[c].dataType).alias(c) for c in ("ord", "card", "marker")])
    live = d.select(F.col("doc_id").alias("card"), "text", F.lit(None).cast("string").alias("stored_sha"), F.lit(None).cast("string").alias("review_by"))
    done = gate.ground(bound.unionByName(bare), live, "2026-01-01", require_stamp=False)
    n = done.groupBy("criterion").agg(F.count("ord").alias("bindings"), F.count_if(F.col("grounded")).alias("grounded"))
    first = gate.first_failures(done).select("criterion", F.nullif("status", F.lit("found")).alias("first_failure"))
    return n.join(first, "criterion")


_QUOTE_SQL = f"(SELECT doc_id AS card, text, unnest([CASE WHEN doc_id % 3 = 0 THEN phrase || ' zzz' ELSE phrase END, CASE WHEN doc_id % 2 = 0 THEN 'qqq ' || phrase ELSE phrase END]) AS value FROM ({_CITED}) JOIN documents USING (doc_id) WHERE trim(phrase) <> '')"


@query(f"""WITH q AS (SELECT DISTINCT card, value, {sql_norm('value')} AS p, {FLAT.replace('text', 'q.text')} AS flat, len(list_filter(string_split(text, E'\\n'), lambda l: contains(l, value))) > 0 AS on_line FROM {_QUOTE_SQL} q), n AS (SELECT *, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, regexp_replace(p, '-\\s*', '', 'g') AS pd FROM q)
  SELECT card, value FROM n WHERE NOT (on_line AND CASE WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) WHEN pd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, pd, ''))) // length(pd) END = 1)""")
def r17_explicit_gaps(spark, sf_dir):
    """Explicit quotes, one of them in a further field, that their card doesn't hold once and as they are on a line."""
    words = F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))
    d = docs(spark, sf_dir).where(F.trim(words) != "")
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(words, F.lit(" zzz"))).otherwise(words)
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("qqq "), words)).otherwise(words)
    field = lambda v: F.struct(v.alias("value"), F.lit("explicit").alias("kind"), F.lit(None).cast("string").alias("warrant"), F.array(F.struct(F.col("doc_id").alias("card"), v.alias("phrase"))).alias("evidence"))
    level = F.array(F.struct(F.lit(0).alias("score"), field(own).alias("descriptor")))
    c = F.array(F.struct(F.col("doc_id").cast("string").alias("id"), field(own).alias("statement"), field(own).alias("guidance"), F.create_map(F.lit("more"), field(other)).alias("fields"), level.alias("levels")))
    rubrics = d.select(F.lit("d").alias("dimension"), F.array().cast("array<string>").alias("panel"), c.alias("criteria"))
    gaps = gate.explicit_gaps(rubrics, d.select(F.col("doc_id").alias("card"), "text"))
    return gaps.select(F.col("criterion").cast("long").alias("card"), "value")


@query(f"""WITH m AS (SELECT * FROM (VALUES (0, -1), (1, 0), (2, 1)) t(place, step)), a AS (SELECT doc_id AS move, k AS anchor, CASE WHEN k = 1 THEN 'zzz ' || w ELSE w END AS phrase FROM (SELECT doc_id, split_part(split_part(text, E'\\n', 1), ' ', 2) AS w FROM documents), (VALUES (0), (1)) t(k) WHERE trim(w) <> ''),
  s AS (SELECT move, anchor, place, phrase, {sql_norm('phrase')} AS p, d.text, {FLAT.replace('text', 'd.text')} AS flat FROM a, m LEFT JOIN documents d ON d.doc_id = a.move + m.step), n AS (SELECT *, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, regexp_replace(p, '-\\s*', '', 'g') AS pd FROM s),
  c AS (SELECT *, CASE WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) WHEN pd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, pd, ''))) // length(pd) END AS n FROM n),
  r AS (SELECT move, anchor, place, coalesce(n = 1, false) AS good, CASE WHEN text IS NULL THEN 2 WHEN n = 0 THEN 1 ELSE 3 END AS rank FROM c)
  SELECT move, anchor, CASE WHEN count(*) FILTER (WHERE good) > 1 THEN 'ambiguous-panel' WHEN count(*) FILTER (WHERE good) = 1 THEN 'grounded' ELSE ['not-found', 'source-not-installed', 'ambiguous'][max(rank) FILTER (WHERE NOT good)] END AS status, CASE WHEN count(*) FILTER (WHERE good) = 1 THEN max(move + place - 1) FILTER (WHERE good) END AS card FROM r GROUP BY move, anchor""")
def gate_panel_grounding(spark, sf_dir):
    """Two anchors of each move against a panel of three cards: exactly one has to hold an anchor."""
    words = F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))
    d = docs(spark, sf_dir)
    moves = d.where(F.trim(words) != "").select(F.col("doc_id").cast("string").alias("dimension"), F.lit(0).alias("ord"), F.array(marker(words), marker(F.concat(F.lit("zzz "), words))).alias("markers"))
    panel = moves.select("dimension", F.posexplode(F.array(*[F.col("dimension").cast("long") + i for i in (-1, 0, 1)])).alias("place", "card"))
    done = gate.ground_panel(moves, panel, d.select(F.col("doc_id").alias("card"), "text"), "2026-01-01")
    status = F.when(F.col("status").isin("found", "folded-only"), "grounded").otherwise(F.col("status"))
    return done.select(F.col("dimension").cast("long").alias("move"), "anchor", status.alias("status"), "card")
