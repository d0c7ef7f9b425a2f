"""A second opinion on anchors: how far the window of the source around an anchor supports the card's claim. Advisory; nothing grounds by it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.anchors import parse_markers
from quoin.operators import services as S

Backend = Callable[[str, str], float]


def support(premise: Column, claim: Column, backend: Backend | None) -> Column:
    """A column of support scores from an injected model; without one every score is null: not measured."""
    if backend is None:
        return F.lit(None).cast("double")

    def run(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([backend(a, b) if a is not None and b is not None else None for a, b in zip(p, c, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(premise, claim)


def overlap(premise: str, claim: str) -> float:
    """A stand-in for a model: the share of the claim's words that the premise has."""
    own = set(claim.lower().split())
    return len(own & set(premise.lower().split())) / len(own) if own else 0.0


def entailed(cards: DataFrame, backend: Backend | None) -> DataFrame:
    """cards (id, body, text of the source): (id, ord, phrase, claim, support) of every literal anchor of the body, its claim against the window of the source around it.

    support is null where the source has no such window or the card no claim: not measured. A card without literal anchors is one row without ord and phrase.
    """
    literal = F.transform(F.filter(parse_markers(F.col("body")), lambda m: ~m["regex"]), lambda m: F.struct(m["phrase"].alias("phrase"), T.norm(m["phrase"]).alias("fold")))
    cut = cards.select("id", "body", literal.alias("marks"), T.sentences(F.col("text")).alias("s"))
    cut = cut.withColumn("folds", F.transform("s", T.norm))  # a text is cut and folded once for all of its card's anchors
    marks = cut.select("id", "body", "s", "folds", F.posexplode_outer("marks").alias("ord", "marker")).withColumn("phrase", F.col("marker.phrase"))
    marked = lambda q: F.concat(F.lit(q), "phrase")  # noqa: E731  a mention within a marker comes before one in prose
    at = F.when(F.contains("body", marked("`")), marked("`")).when(F.contains("body", marked('"')), marked('"')).otherwise(F.col("phrase"))
    claim = F.when(F.col("phrase").isNotNull(), F.nullif(F.trim(S.claim_of(F.col("body"), at)), F.lit("")))
    scored = marks.select("id", "ord", "phrase", claim.alias("claim"), S.window_of(F.col("s"), F.col("folds"), F.col("marker.fold")).alias("premise"))
    return scored.select("id", "ord", "phrase", "claim", support(F.col("premise"), F.col("claim"), backend).alias("support"))
