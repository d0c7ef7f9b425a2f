"""Metrics of retrieval, of two raters, and of paired extraction tiers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.anchors import resolve
from quoin.operators.grounding import folded, marker, phrase_hits
from quoin.operators.ranks import discrete, median, picked
from quoin.runtime import durable


def retrieval_means(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """Means over the questions that have relevant ids: P@5, R@10, MRR, nDCG@10. scored (question, id, score), gold (question, id)."""
    gold = gold.select("question", "id").distinct()
    sizes = gold.groupBy("question").agg(F.count("*").alias("n"))
    placed = durable(scored.select("question", "id", (-F.round("score", 9)).alias("s")), "scored")
    top = placed.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("s", "id"))).where("rank <= 10")  # a limit in each task before the shuffle
    hits = top.join(gold, ["question", "id"], "left_semi").select("question", "rank")
    best = placed.join(gold, ["question", "id"], "left_semi").groupBy("question").agg(F.min(F.struct("s", "id")).alias("best"))
    first = placed.join(best, "question").groupBy("question").agg((F.count_if(F.struct("s", "id") < F.col("best")) + 1).alias("first"))  # counted, not sorted
    gain = 1 / F.log2(F.col("rank") + 1)
    counts = hits.groupBy("question").agg(F.count_if(F.col("rank") <= 5).alias("in5"), F.count("*").alias("in10"), F.sum(gain).alias("dcg"))
    per = sizes.join(counts, "question", "left").join(first, "question", "left").select(
        "n", (F.coalesce("in5", F.lit(0)) / 5.0).alias("p5"), (F.coalesce("in10", F.lit(0)) / F.col("n")).alias("r10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce("dcg", F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("p5", "r10", "mrr")], F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg10"))


def anchor_compatibility(texts: DataFrame) -> DataFrame:
    """texts (id, text, anchors as an array of phrases): the share of anchors that the text still holds, and their number; null where there are none. No measure to rank extractions by."""
    rows = folded(texts).withColumn("marks", F.transform("anchors", lambda a: marker(a)))
    rows = rows.withColumn("held", F.size(F.filter(F.transform("marks", lambda m: resolve(m, F.col("flat"), F.col("nohy"), False)["found"]), lambda x: x)))
    n = F.size("anchors")
    return rows.select("id", F.try_divide(F.col("held"), F.nullif(n, F.lit(0))).alias("share"), n.alias("n"))


def count_scores(blobs: DataFrame, questions: DataFrame) -> DataFrame:
    """The arm that BM25 is held against: (question, id, score) with how often a question's terms occur, as they are, whatever a blob's length."""
    asked = questions.select("question", F.explode(F.transform("terms", F.lower)).alias("term")).where(F.trim("term") != "")
    numbered = asked.select("term").distinct().select(F.xxhash64("term").alias("phrase_id"), F.col("term").alias("phrase"))
    hits = phrase_hits(blobs.select("id", F.col("blob").alias("text")), numbered)
    return hits.join(asked.withColumn("phrase_id", F.xxhash64("term")), "phrase_id").groupBy("question", "id").agg(F.sum("times").cast("double").alias("score"))


# Words that a searcher leaves out of a question.
SEARCH_STOP = ("the", "and", "for", "are", "was", "with", "that", "this", "from", "into", "versus", "vs", "when", "does", "how", "what", "why", "who", "some", "more", "than", "its")


def search_terms(question: Column) -> Column:
    """The words of a question that one would search for: of three letters or digits or more, in order, repeats too."""
    return F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*SEARCH_STOP))


def weighted_kappa(x: Column, y: Column) -> Column:
    """Quadratic-weighted kappa as an aggregate, null where it is undefined: fewer than two pairs, or no disagreement to be expected."""
    expected = F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)
    return F.when(F.count("*") >= 2, 1 - F.avg(F.pow(x - y, 2)) / F.nullif(F.round(expected, 12), F.lit(0.0)))


def rater_agreement(pairs: DataFrame, bar: float = 0.6) -> DataFrame:
    """pairs (criterion, scale, x, y): exact and adjacent shares, kappa and verdict for each criterion, and over all, where kappa is withheld if scales differ."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    share = [F.count("*").alias("n"), F.round(F.avg((x == y).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(x - y) <= 1).cast("int")), 6).alias("adjacent")]
    each = pairs.groupBy("criterion").agg(*share, F.round(weighted_kappa(x, y), 6).alias("qwk"))
    whole = pairs.groupBy(F.lit("OVERALL").alias("criterion")).agg(*share, F.when(F.count_distinct("scale") == 1, F.round(weighted_kappa(x, y), 6)).alias("qwk"))
    verdict = F.when(F.col("qwk").isNull(), "undefined").when(F.col("qwk") < bar, "under-specified").otherwise("ok")
    return each.withColumn("verdict", verdict).unionByName(whole.withColumn("verdict", F.lit(None).cast("string")))


def tier_totals(runs: DataFrame, tiers: list[str]) -> DataFrame:
    """runs (doc, tier, recall, orders, error): attempts, measured and failures of each tier; a missing run is a failure."""
    grid = runs.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, tiers))).alias("tier"))
    all_ = grid.join(runs, ["doc", "tier"], "left")
    return all_.groupBy("tier").agg(F.count("*").alias("attempted"), F.count("recall").alias("measured"), F.count_if(F.col("recall").isNull()).alias("failed"))


def paired_ranking(runs: DataFrame, tiers: list[str], least: int = 2) -> DataFrame:
    """Rank the largest set of tiers that share documents (ties: more documents, then names) on the documents that all of them measured.

    Order is inverted where the median order is negative; then by median recall, then name. The search over sets runs on counts for each pattern of tiers (2^tiers rows).
    """
    measured = runs.where(F.col("recall").isNotNull())
    patterns = measured.groupBy("doc").agg(F.array_sort(F.collect_set("tier")).alias("own")).groupBy("own").agg(F.count("*").alias("n")).collect()
    best: tuple = ()
    for size in range(len(tiers), 0, -1):
        options = [(sum(p["n"] for p in patterns if set(c) <= set(p["own"])), c) for c in combinations(sorted(tiers), size)]
        options = [o for o in options if o[0] >= least]
        if options:
            best = min(options, key=lambda o: (-o[0], o[1]))[1]
            break
    shared = measured.where(F.col("tier").isin(*best)).groupBy("doc").agg(F.count_distinct("tier").alias("k")).where(F.col("k") == len(best)).select("doc")
    own = durable(measured.where(F.col("tier").isin(*best)).join(shared, "doc").select("tier", "recall", "orders"), "paired")  # ranked twice, and counted
    n = F.col("n")
    recalls = picked(own, "tier", "recall", {"median_recall": median(n), "p10_recall": discrete(0.1, n)}).drop("n")
    orders = picked(own, "tier", "orders", {"median_order": median(n)}).drop("n")
    counts = own.groupBy("tier").agg(F.count("*").alias("docs"), F.min("recall").alias("worst_recall"))
    stats = counts.join(recalls, "tier").join(orders, "tier", "left").select("tier", "docs", *[F.round(c, 6).alias(c) for c in ("median_recall", "worst_recall", "p10_recall", "median_order")])
    ranked = F.row_number().over(Window.orderBy(F.coalesce(F.col("median_order") < 0, F.lit(False)), F.desc("median_recall"), "tier"))
    return stats.withColumn("rank", ranked)
