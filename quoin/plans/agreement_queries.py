"""Agreement of each document with a changed copy of itself: every third is reversed by lines, every third loses its second half, the others repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import agreement as A
from quoin.plans.registry import query
from quoin.plans.text_queries import TOKENS_SQL, docs
from quoin.runtime import durable

_CAND_SQL = "CASE doc_id % 3 WHEN 0 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') WHEN 1 THEN substr(text, 1, length(text) // 2) ELSE text || ' ' || substr(text, 1, length(text) // 4) END"
_BAG_SQL = f"""a AS (SELECT id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id AS id, {TOKENS_SQL} AS t FROM documents)),
  c AS (SELECT id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i FROM (SELECT id, {TOKENS_SQL} AS t FROM (SELECT doc_id AS id, {_CAND_SQL} AS text FROM documents))),
  bag AS (SELECT id, t, sum(x) AS na, sum(y) AS nb, min(pa) AS pa, min(pb) AS pb FROM (SELECT id, t, 1 AS x, 0 AS y, i AS pa, NULL::BIGINT AS pb FROM a UNION ALL SELECT id, t, 0, 1, NULL, i FROM c) GROUP BY id, t),
  m AS (SELECT id, sum(na) AS control_tokens, sum(nb) AS candidate_tokens, sum(least(na, nb)) / sum(na) AS containment, sum(nb) / sum(na) AS inflation FROM bag GROUP BY id)"""
_WIN_SQL = f"""{_BAG_SQL}, rk AS (SELECT id, w, row_number() OVER (PARTITION BY id, w ORDER BY pa) AS x, row_number() OVER (PARTITION BY id, w ORDER BY pb) AS y FROM (SELECT *, pa // 400 AS w FROM bag WHERE na = 1 AND nb = 1)),
  sc AS (SELECT id, w, count(*) AS anchors, CASE WHEN count(*) >= 8 THEN 1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS rank_order FROM rk GROUP BY id, w),
  ev AS (SELECT id, unnest(range(0, greatest(ceil(control_tokens / 400)::BIGINT, 1))) AS w FROM m),
  wn AS (SELECT ev.id, ev.w, coalesce(anchors, 0) AS anchors, rank_order FROM ev LEFT JOIN sc USING (id, w))"""
_SUM_SQL = f"""{_WIN_SQL}, sm AS (SELECT id, count(*) AS windows, avg((rank_order IS NOT NULL)::INT) AS measured_share, median(rank_order) AS median, list_sort(list(rank_order) FILTER (WHERE rank_order IS NOT NULL)) AS v, min(rank_order) AS worst,
    min((rank_order, w)) FILTER (WHERE rank_order IS NOT NULL) AS ww FROM wn GROUP BY id)"""


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    words = F.array_join(F.reverse(F.split(c, " ")), " ")
    changed = F.when(F.col("doc_id") % 3 == 0, words).when(F.col("doc_id") % 3 == 1, F.substring(c, F.lit(1), half)).otherwise(F.concat(c, F.lit(" "), F.substring(c, F.lit(1), F.floor(F.length(c) / 4).cast("int"))))
    own = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", changed.alias("other"))
    return A.positions(own), A.positions(own, "other")


def bag_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bags(*pair(spark, sf_dir))


@query(f"WITH {_BAG_SQL} SELECT id, control_tokens::BIGINT AS control_tokens, candidate_tokens::BIGINT AS candidate_tokens, round(containment, 6)::DOUBLE AS containment, round(inflation, 6)::DOUBLE AS inflation FROM m")
def j13_containment(spark, sf_dir):
    m = A.containment(bag_of(spark, sf_dir))
    return m.select("id", "control_tokens", "candidate_tokens", F.round("containment", 6).alias("containment"), F.round("inflation", 6).alias("inflation"))


@query(f"WITH {_WIN_SQL} SELECT id, w::BIGINT AS w, anchors::BIGINT AS anchors, round(rank_order, 6) AS rank_order FROM wn")
def w1_window_order(spark, sf_dir):
    bag = durable(bag_of(spark, sf_dir), "bag")
    w = A.window_orders(bag, A.containment(bag))
    return w.select("id", F.col("w").cast("long").alias("w"), F.col("anchors").cast("long").alias("anchors"), F.round("rank_order", 6).alias("rank_order"))


def _summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bag = durable(bag_of(spark, sf_dir), "bag")
    sizes = A.containment(bag)
    return sizes, A.order_summary(A.window_orders(bag, sizes))


@query(f"WITH {_SUM_SQL} SELECT id, windows::BIGINT AS windows, round(measured_share, 6) AS measured_share, round(median, 6) AS median, round(v[round_even(0.05 * (len(v) - 1), 0)::INT + 1], 6) AS p05, round(worst, 6) AS worst, ww[2]::BIGINT AS worst_window FROM sm".replace("ww[2]", "struct_extract_at(ww, 2)"))
def a6_order_quantiles(spark, sf_dir):
    s = _summary(spark, sf_dir)[1]
    return s.select("id", "windows", *[F.round(c, 6).alias(c) for c in ("measured_share", "median", "p05", "worst")], F.col("worst_window").cast("long").alias("worst_window"))


_PAGES_SQL = "CASE id % 4 WHEN 0 THEN NULL ELSE list_filter(range(1, 1 + id % 5), lambda p: p % (id % 4 + 1) > 0) END"
_DECLARED_SQL = "(id % 5)::INT"


@query(f"""WITH {_SUM_SQL}, j AS (SELECT *, {_DECLARED_SQL} AS declared, {_PAGES_SQL} AS pages FROM m JOIN sm USING (id)),
  f AS (SELECT *, list_filter([CASE WHEN containment < 0.8 THEN 'containment' END, CASE WHEN inflation > 1.5 THEN 'inflation-high' END, CASE WHEN inflation < 0.67 THEN 'inflation-low' END, CASE WHEN median < 0 THEN 'median-order' END, CASE WHEN worst < -0.5 THEN 'worst-order' END,
    CASE WHEN declared > 0 AND pages IS NOT NULL AND len(list_filter(range(1, declared + 1), lambda p: NOT list_contains(pages, p))) > 0 THEN 'pages-missing' END], lambda r: r IS NOT NULL) AS reasons FROM j)
  SELECT id, CASE WHEN id % 17 = 0 THEN 'unverified' WHEN len(reasons) > 0 THEN 'failed' WHEN coalesce(measured_share <= 0.5, true) OR median IS NULL THEN 'abstained' ELSE 'verified' END AS state, array_to_string(reasons, ',') AS reasons FROM f""")
def i6_decide(spark, sf_dir):
    sizes, orders = _summary(spark, sf_dir)
    pages = F.when(F.col("id") % 4 != 0, F.filter(F.transform(F.when(F.col("id") % 5 > 0, F.sequence(F.lit(1), (F.col("id") % 5).cast("int"))).otherwise(F.array().cast("array<int>")), lambda p: p), lambda p: p % (F.col("id") % 4 + 1) > 0))
    rows = sizes.join(orders, "id").withColumn("declared", (F.col("id") % 5).cast("int")).withColumn("pages", pages).withColumn("accepted", F.col("id") % 17 == 0)
    return A.decide(rows).select("id", "state", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT id, array_to_string(list_filter(range(1, declared + 1), lambda p: NOT list_contains(pages, p)), ',') AS missing FROM (SELECT id, {_DECLARED_SQL} AS declared, {_PAGES_SQL} AS pages FROM (SELECT doc_id AS id FROM documents)) WHERE declared > 0 AND pages IS NOT NULL")
def u2_missing_pages(spark, sf_dir):
    n = (F.col("id") % 5).cast("int")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id")).withColumn("declared", n).where("declared > 0")
    pages = F.when(F.col("id") % 4 != 0, F.filter(F.sequence(F.lit(1), F.col("declared")), lambda p: p % (F.col("id") % 4 + 1) > 0))
    return rows.withColumn("missing", A.missing_pages(F.col("declared"), pages)).where("missing is not null").select("id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query(f"""WITH c AS (SELECT doc_id AS id, unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM (SELECT doc_id, {_CAND_SQL} AS text FROM documents))), l AS (SELECT doc_id AS id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS w FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents)),
  a AS (SELECT id, w, unnest(t) AS t, w * 4294967296 + generate_subscripts(t, 1) AS i FROM (SELECT id, w, {TOKENS_SQL} AS t FROM l)), bag AS (SELECT id, t, sum(x) AS na, sum(y) AS nb, min(pa) AS pa, min(pb) AS pb FROM (SELECT id, t, 1 AS x, 0 AS y, i AS pa, NULL::BIGINT AS pb FROM a UNION ALL SELECT id, t, 0, 1, NULL, i FROM c) GROUP BY id, t),
  rk AS (SELECT id, w, row_number() OVER (PARTITION BY id, w ORDER BY pa) AS x, row_number() OVER (PARTITION BY id, w ORDER BY pb) AS y FROM (SELECT *, pa // 4294967296 AS w FROM bag WHERE na = 1 AND nb = 1)),
  sc AS (SELECT id, w, count(*) AS anchors, CASE WHEN count(*) >= 8 THEN 1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS rank_order FROM rk GROUP BY id, w)
  SELECT l.id, l.w::BIGINT AS w, coalesce(anchors, 0)::BIGINT AS anchors, round(rank_order, 6) AS rank_order FROM l LEFT JOIN sc USING (id, w)""")
def w2_page_windows(spark, sf_dir):
    """Order within the control's own pages; its lines stand for pages."""
    pages = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("pages"))
    bag = durable(A.bags(A.page_positions(pages), pair(spark, sf_dir)[1]), "bag")
    w = A.page_orders(bag, pages)
    return w.select("id", F.col("w").cast("long").alias("w"), F.col("anchors").cast("long").alias("anchors"), F.round("rank_order", 6).alias("rank_order"))
