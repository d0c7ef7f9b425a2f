import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns whose names clash with the operators' own."""
    random.seed(5)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n)) + "."
    base = text(120)
    rows = [(1, None, None, None, None), (2, "", "xx", "s", 0), (3, base, "xx", "s", 1), (4, base, "xx", "s", 1), (4, base, "xx", "s", 1), (5, base.replace(words[0], "zzz"), "yy", "s", 1), (6, "a b", "yy", "s", 3), (7, "A B", "yy", "s", 3), (8, " \n\t ", None, "s", 3)]
    rows += [(9, "x " * 60_000, "xx", "s", 1), (10, "y" * 30_000, "yy", "s", 1), (11, "Σίσυφος ½² ﬁ é 🙂 \x1c中文", "xx", "s", 1), (None, base, "xx", "s", 1), (None, None, None, None, None), (-5, text(80), "yy", None, 1)]
    rows += [(100 + i, text(random.randint(1, 200)), "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumn("row", F.lit(1)).withColumn("removed", F.lit("r")).withColumn("digest", F.lit("d")).withColumn("b", F.lit(0)).withColumn("n.x", F.lit(0))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
