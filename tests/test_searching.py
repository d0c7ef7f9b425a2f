"""The search index, patterns by their literals, texts that contain needles, ingest as transactions, and resumable runs."""

import random
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quoin.functions.patterns import needed
from quoin.operators import grounding, linter, normalize, ranks, retrieval, runs, search_index, services, wordlists
from quoin.operators.matching import containing
from quoin.streaming import transactions


def test_index_scores_as_a_scan_does(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "alphabet", "bet", "the", "theta", "a-b", "tion", "nation", "éa", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "the  nation\nthe nation")]
    blobs = spark.createDataFrame(rows, "id long, blob string")
    questions = spark.createDataFrame([(1, ["the", "alpha"]), (2, ["e"]), (3, ["THE NATION", "bet"]), (4, ["nope"]), (5, [" "]), (6, ["ab", "x y", "a-b"])], "question int, terms array<string>")
    own = search_index.Index(spark, str(tmp_path / "index"))
    assert own.search(questions).count() == 0
    own.add(blobs.where("id < 30").withColumn("blob", F.when(F.col("id") % 4 == 0, "old words the the").otherwise(F.col("blob"))))
    own.add(blobs.where("id >= 30"))
    own.add(blobs.where("id < 30 and id % 4 = 0"))
    want = {(r["question"], r["id"]): round(r["score"], 9) for r in retrieval.bm25(blobs.withColumn("blob", F.coalesce("blob", F.lit(""))), questions).collect()}
    assert {(r["question"], r["id"]): round(r["score"], 9) for r in own.search(questions).collect()} == want
    assert len({q for q, _ in want}) >= 4


def test_needed_literals_are_in_every_match():
    assert needed("(?:foo|bar)baz") == ["barbaz", "foobaz"] and needed("ab?c") is None and needed("(?i)abc") is None and needed("(unclosed") is None and needed("colou?r") == ["colo"]
    rng = random.Random(4)
    parts = ["a", "bc", "[ab]", "c?", "(?:ab|c)", "(?:ab|)", "(a|bc)+", "b{2}", "c{1,2}", ".", "[^a]", "^", "(?=a)", "\\b", "(?:ca){2,}", "a*"]
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    told = 0
    for _ in range(500):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "|bb", "|ac"])
        literals = needed(pattern)
        if literals:
            told += 1
            for t in texts:
                for m in re.finditer(pattern, t):
                    assert any(x in m[0] for x in literals), (pattern, literals, m[0])
    assert told > 100


def test_patterns_over_a_corpus(spark):
    docs = spark.createDataFrame([(1, "a nation of nations"), (2, "12 reasons"), (3, None), (4, "")], "id long, text string")
    patterns = spark.createDataFrame([(1, "nations?"), (2, "[0-9]+"), (3, "(bad"), (4, None), (5, "zebra+")], "pattern_id long, pattern string")
    assert {(r["pattern_id"], r["id"]): r["times"] for r in grounding.pattern_hits(docs, patterns).collect()} == {(1, 1): 2, (2, 1): 0, (2, 2): 1, (2, 4): 0}
    assert {r["pattern_id"]: r["kind"] for r in grounding.pattern_kinds(patterns).collect()} == {1: "literal", 2: "scan", 3: "invalid", 4: "invalid", 5: "literal"}


def test_containing_by_brute_force(spark):
    rng = random.Random(3)
    some = lambda a, b: "".join(rng.choice("abé-") for _ in range(rng.randint(a, b)))
    hay, needles = [(i, some(0, 12)) for i in range(200)] + [(200, None)], [(i, some(0, 5)) for i in range(80)] + [(80, None), (81, "zzz")]
    got = containing(spark.createDataFrame(hay, "h int, text string"), spark.createDataFrame(needles, "n int, needle string"), "text", "needle")
    assert sorted((r["h"], r["n"]) for r in got.collect()) == sorted((h, n) for h, t in hay for n, x in needles if t is not None and x is not None and x in t)


def test_a_hundred_thousand_names_without_nested_loops(spark, capsys):
    names = spark.range(100_000).select(F.concat(F.lit("card-"), F.col("id").cast("string"), F.lit("-x")).alias("id"))
    asked = spark.range(0, 100_000, 1000).select(F.col("id").alias("owner"), F.concat(F.col("id").cast("string"), F.lit("-x")).alias("name"))
    pairs = services.panel_names(asked, names)
    got = pairs.groupBy("kind").count().collect()
    assert sum(r["count"] for r in got) > 100
    lenses = spark.createDataFrame([("dimension", "pacing", "Pacing of scenes", None), ("source", "a", "On scenes", "x")], "kind string, name string, title string, aliases string")
    plans = [
        pairs, retrieval.consult(spark.createDataFrame([(1, "scenes")], "query_id int, name string"), lenses), retrieval.diagnose(spark.createDataFrame([(1, "too slow")], "symptom_id int, symptom string"), spark.createDataFrame([(0, ["slow"], ["pacing"])], "ord int, cues array<string>, dims array<string>")),
        linter.synthesis_sources(spark.createDataFrame([("s", "---\ncards: [abc, abd]\n---\n")], "name string, text string"), spark.createDataFrame([("abc-1", "r")], "id string, rel string"), None, "lib/.*"),
    ]
    for p in plans:
        p.explain()
        assert "NestedLoop" not in capsys.readouterr().out and p.columns


def test_ingest_is_one_transaction_a_batch(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for i in range(4):
        (drop / f"{i}.txt").write_text(f"Some words of text {i % 3}.\n")
    (drop / "empty.txt").write_text(" ")
    to, at = str(tmp_path / "to"), str(tmp_path / "checkpoint")

    def stop(table, number):
        if (table, number) == ("provenance", 0):
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        transactions.ingest(transactions.arrivals(spark, str(drop)), to, at, "r", between=stop).awaitTermination()
    assert transactions.committed(spark, to, "sources").count() == 0
    assert {x.split("/")[0] for x in transactions.rollback(spark, to)} == {"staged", "sources", "provenance"}
    transactions.ingest(transactions.arrivals(spark, str(drop)), to, at, "r").awaitTermination()
    sources, log = transactions.committed(spark, to, "sources").collect(), transactions.committed(spark, to, "provenance").collect()
    assert len(sources) == 3 and {r["sha256"] for r in sources} == {r["output_sha256"] for r in log} and {r["batch"] for r in log} == {0}
    assert [r["refused"] for r in transactions.committed(spark, to, "refused").collect()] != []
    (drop / "again.txt").write_text("Some words of text 1.\n")
    (drop / "new.txt").write_text("New words here.\n")
    transactions.ingest(transactions.arrivals(spark, str(drop)), to, at, "r").awaitTermination()
    assert transactions.committed(spark, to, "sources").count() == 4
    control = transactions.judged(spark.createDataFrame([("a.txt", b"one two three four five six")], "path string, content binary"), controls=spark.createDataFrame([("a.txt", "wholly other words that were there before it all " * 30, None)], "path string, control string, declared int")).first()
    assert control["refused"].startswith("verification: ") and control["state"] == "failed"


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, str(i)) for i in range(5) for t in "ab"], "doc int, tier string, digest string")
    measure = lambda left: left.select("doc", "tier", F.current_timestamp().alias("at"))
    first = {(r["doc"], r["tier"]): r["at"] for r in runs.resume(rows, str(tmp_path), {"k": 1}, measure, 4).collect()}
    assert len(first) == 4
    whole = {(r["doc"], r["tier"]): r["at"] for r in runs.resume(rows, str(tmp_path), {"k": 1}, measure).collect()}
    assert len(whole) == 10 and all(whole[k] == v for k, v in first.items())
    for other in ((rows, {"k": 2}), (rows.where("doc > 0"), {"k": 1})):
        with pytest.raises(runs.ManifestError):
            runs.resume(other[0], str(tmp_path), other[1], measure)


def test_ranks_and_quantiles_of_a_hot_group(spark):
    """Most rows are one group's, and most of those have one value; groups with nulls, ties and one row."""
    rng = random.Random(5)
    data = [("hot", rng.choice([7, 7, 7, rng.randrange(50)])) for _ in range(3000)] + [(None, v) for v in (3, 1, 2)] + [("one", 5), ("none", None), ("b", None), ("b", 4), ("b", 8)]
    df = spark.createDataFrame(data, "g string, v int")
    got = {}
    for r in ranks.ranked(df, ["g"], ["v"]).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["v"]))
    for g, own in got.items():
        values = sorted((v for k, v in data if k == g), key=lambda v: (v is not None, v or 0))
        assert [v for _, v in sorted(own)] == values and sorted(r for r, _ in own) == list(range(1, len(values) + 1))
    n = F.col("n")
    told = {r["g"]: (r["n"], r["m"], r["p"]) for r in ranks.picked(df, "g", "v", {"m": ranks.median(n), "p": ranks.discrete(0.1, n)}).collect()}
    hot = sorted(v for k, v in data if k == "hot")
    assert told == {"hot": (3000, (hot[1499] + hot[1500]) / 2, hot[299]), None: (3, 2.0, 1.0), "one": (1, 5.0, 5.0), "b": (2, 6.0, 4.0)}
    assert ranks.ranked(df.where("false"), ["g"], ["v"]).count() == 0


def test_lost_bytes_by_a_table_of_words(spark):
    rng = random.Random(9)
    known = ["definition", "define", "fine", "office", "flat", "first", "best", "rest", "no", "table", "notable", "after", "café"]
    made = lambda: rng.choice(known).replace(rng.choice(["fi", "ffi", "fl", "st", "ft", "ta", "zz"]), rng.choice("\x02\x1f\x03"))
    texts = [(i, " ".join(made() + rng.choice(["", ".", "\x02", "\x1f", " \x03 "]) for _ in range(rng.randint(0, 14)))) for i in range(200)] + [(200, ""), (201, "no\x02table no\x02table no\x02table")]
    got = wordlists.repaired(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in known], "word string"))
    assert {r["id"]: r["text"] for r in got.collect()} == {i: normalize.repair_control(t, frozenset(known)) for i, t in texts}
