"""Cards: front matter, title and sections of Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T


def as_cards(docs: DataFrame) -> DataFrame:
    """A card for each document: its first line is the title, 200 characters are thin, the rest is full."""
    line = lambda s: F.lit(s)
    card = F.concat(
        line("---\nid: doc-"), F.col("doc_id").cast("string"), line("\naliases: "), "lang", line("\nzoom: thin\n---\n# "), F.substring_index("text", "\n", 1),
        line("\n\n## Thin\n"), F.substring("text", 1, 200), line("\n## Full\n"), F.expr("substring(text, 201)"),
    )
    return docs.select("*", card.alias("card"))


def card_fields(cards: DataFrame, card: str = "card") -> DataFrame:
    """Parsed fields of a column of cards; null where a card has none."""
    front = T.front_matter(F.col(card))
    keys = ("id", "file", "aliases", "shelf", "zoom", "source_sha256", "review_by", "superseded_by")
    known = [c for c in cards.columns if c not in {*keys, "title", "thin", "full", "sections"}]
    return cards.select(*known, *[T.field(front, k).alias(k) for k in keys], T.title(F.col(card)).alias("title"), T.section(F.col(card), "thin").alias("thin"), T.section(F.col(card), "full").alias("full"), T.sections(F.col(card)).alias("sections"))
