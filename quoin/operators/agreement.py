"""How faithful a candidate extraction is to a control: containment, inflation, order within windows, pages, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import text as T

# Limits of the decision.
LIMITS = {"min_containment": 0.80, "max_inflation": 1.50, "min_inflation": 0.67, "min_median_order": 0.0, "min_worst_order": -0.5, "min_measured_share": 0.5}
WINDOW, ANCHORS = 400, 8


def positions(texts: DataFrame, text: str = "text", exact: bool = True) -> DataFrame:
    """(id, i, t): tokens and their places from 0. exact=False leaves out compatibility forms and rare case foldings, and with them Python."""
    split = T.all_tokens(F.col(text)) if exact else T.tokens(F.col(text))
    return texts.select("id", F.posexplode(split).alias("i", "t"))


def bags(control: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, t, na, nb, pa, pb): occurrences of each token of either side, and places of those that occur once. One shuffle of counts on (id, t)."""
    a = control.select("id", "t", F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("i").alias("pa"), F.lit(None).cast("int").alias("pb"))
    b = candidate.select("id", "t", F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(None).cast("int").alias("pa"), F.col("i").alias("pb"))
    return a.unionAll(b).groupBy("id", "t").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))


def containment(bag: DataFrame) -> DataFrame:
    """(id, control_tokens, candidate_tokens, containment, inflation); 0 where the control is empty."""
    sums = bag.groupBy("id").agg(F.sum("na").alias("control_tokens"), F.sum("nb").alias("candidate_tokens"), F.sum(F.least("na", "nb")).alias("shared"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("control_tokens").cast("double")), F.lit(0.0))
    return sums.select("id", "control_tokens", "candidate_tokens", ratio("shared").alias("containment"), ratio("candidate_tokens").alias("inflation"))


def rank_orders(unique: DataFrame, by: list[str], least: int) -> DataFrame:
    """Spearman's rank correlation of places pa and pb in each group, with the number of anchors; null below `least` of them. Ranks have no ties, so the closed form is exact."""
    win = Window.partitionBy(*by)
    ranked = unique.withColumn("x", F.row_number().over(win.orderBy("pa"))).withColumn("y", F.row_number().over(win.orderBy("pb")))
    n = F.count("*").cast("double")
    rho = F.when(F.count("*") >= max(2, least), 1 - 6 * F.sum(F.pow((F.col("x") - F.col("y")).cast("double"), 2)) / (n * (n * n - 1)))
    return ranked.groupBy(*by).agg(F.count("*").alias("anchors"), rho.alias("rank_order"))


def window_orders(bag: DataFrame, sizes: DataFrame, width: int = WINDOW, least: int = ANCHORS) -> DataFrame:
    """(id, w, anchors, rank_order): Spearman's rank correlation of the tokens that are unique on both sides, for each window of the control's tokens.

    Windows with fewer than `least` of them abstain (null), and windows without any are kept. Ranks have no ties, so the closed form is exact.
    """
    unique = bag.where("na = 1 and nb = 1").withColumn("w", F.floor(F.col("pa") / width).cast("int"))
    scored = rank_orders(unique, ["id", "w"], least)
    last = F.greatest(F.ceil(F.col("control_tokens") / width).cast("int") - 1, F.lit(0))
    every = sizes.select("id", F.explode(F.sequence(F.lit(0), last)).alias("w"))
    return every.join(scored, ["id", "w"], "left").select("id", "w", F.coalesce("anchors", F.lit(0)).alias("anchors"), "rank_order")


def page_positions(pages: DataFrame, page: str = "pages") -> DataFrame:
    """(id, i, t) of documents given as arrays of pages: the place holds the page (from 0) above 32 bits, and the token's place in it."""
    rows = pages.select("id", F.posexplode(page).alias("p", "text")).select("id", "p", F.posexplode(T.tokens(F.col("text"))).alias("j", "t"))
    return rows.select("id", (F.shiftleft(F.col("p").cast("long"), 32) + F.col("j")).alias("i"), "t")


def page_orders(bag: DataFrame, pages: DataFrame, least: int = ANCHORS, page: str = "pages") -> DataFrame:
    """window_orders with the control's own pages as windows; bag is of page_positions of the control."""
    unique = bag.where("na = 1 and nb = 1").withColumn("w", F.shiftright("pa", 32).cast("int"))
    every = pages.select("id", F.explode(F.sequence(F.lit(0), F.greatest(F.size(page), F.lit(1)) - 1)).alias("w"))
    return every.join(rank_orders(unique, ["id", "w"], least), ["id", "w"], "left").select("id", "w", F.coalesce("anchors", F.lit(0)).alias("anchors"), "rank_order")


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank quantile (half to even) of a sorted array, null if it is empty."""
    return F.try_element_at(values, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def order_summary(windows: DataFrame) -> DataFrame:
    """(id, windows, measured_share, median, p05, worst, worst_window); null where nothing was measured."""
    values = F.array_sort(F.collect_list("rank_order"))
    g = windows.groupBy("id").agg(F.count("*").alias("windows"), F.avg(F.col("rank_order").isNotNull().cast("int")).alias("measured_share"), F.median("rank_order").alias("median"), values.alias("v"), F.min("rank_order").alias("worst"), F.min_by("w", F.when(F.col("rank_order").isNotNull(), F.struct("rank_order", "w"))).alias("worst_window"))
    sure = F.when(F.size("v") > 0, F.col("worst_window"))
    return g.select("id", "windows", "measured_share", "median", F.when(F.size("v") > 0, nearest_rank(F.col("v"), 0.05)).alias("p05"), "worst", sure.alias("worst_window"))


def missing_pages(declared: Column, present: Column) -> Column:
    """Declared pages that a candidate doesn't have; null where either isn't known."""
    return F.when((declared > 0) & present.isNotNull(), F.array_except(F.sequence(F.lit(1), declared), present))


def decide(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """rows (id, containment, inflation, windows, measured_share, median, worst, declared, pages, accepted) with state and reasons.

    Failures first; an accepted document is unverified, with its reasons; then abstained where order isn't known for most windows, or where nothing speaks for the
    candidate; else verified. Null containment means that no agreement was measured.
    """
    t = LIMITS | (limits or {})
    missing = missing_pages(F.col("declared"), F.col("pages"))
    fails = F.filter(F.array(
        F.when(F.col("containment") < t["min_containment"], "containment"), F.when(F.col("inflation") > t["max_inflation"], "inflation-high"),
        F.when(F.col("inflation") < t["min_inflation"], "inflation-low"), F.when(F.col("median") < t["min_median_order"], "median-order"),
        F.when(F.col("worst") < t["min_worst_order"], "worst-order"), F.when(F.size(missing) > 0, "pages-missing"),
    ), lambda r: r.isNotNull())
    measured = F.col("containment").isNotNull()
    pages_speak = F.coalesce((F.col("declared") > 0) & F.col("pages").isNotNull(), F.lit(False))
    unknown = F.when(measured, F.coalesce(F.col("measured_share") <= t["min_measured_share"], F.lit(True)) | F.col("median").isNull()).otherwise(~pages_speak)
    state = F.when(F.coalesce("accepted", F.lit(False)), "unverified").when(F.size(fails) > 0, "failed").when(unknown, "abstained").otherwise("verified")
    return rows.withColumn("missing", missing).withColumn("state", state).withColumn("reasons", fails)
