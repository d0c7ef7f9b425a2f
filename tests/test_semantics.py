"""Pinned values and contracts on small rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quoin.functions import anchors, text as T
from quoin.operators import agreement, evaluation, gate, grounding, linter, normalize, retrieval
from quoin.sources import formats, library


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()[0]


def test_bm25_pinned(spark):
    blobs = spark.createDataFrame([("aaa", "aaa aaa  pacing "), ("bbb", "bbb bbb  pacing " + "filler " * 30)], "id string, blob string")
    blobs = blobs.withColumn("blob", F.col("blob"))
    got = {r["id"]: r["score"] for r in retrieval.bm25(blobs, spark.createDataFrame([(0, ["pacing"])], "question int, terms array<string>")).collect()}
    assert got["aaa"] == pytest.approx(0.2917144909, abs=1e-9) and got["bbb"] == pytest.approx(0.1325974959, abs=1e-9)


def test_blank_terms_match_nothing(spark):
    blobs = spark.createDataFrame([("a", "x")], "id string, blob string")
    assert retrieval.bm25(blobs, spark.createDataFrame([(0, [" ", ""])], "question int, terms array<string>")).count() == 0


@pytest.mark.parametrize("text, phrases", [
    ("(grep: `a b`)", ["a b"]), ("(search: `c`)", ["c"]), ('(`grep: "d e"`)', ["d e"]), ("(`grep:` `f`)", ["f"]), ("research: `no`", []), ("(grep: `a`; `b` | `c`)", ["a", "b", "c"]), ('(`grep: "A"`; `grep: "B"`)', ["A", "B"]),
])
def test_marker_spellings(text, phrases):
    assert [m["phrase"] for m in anchors.markers_of(text)] == phrases


def test_marker_pins():
    (m,) = anchors.markers_of("(grep-re: `p.*` before `x y` after \"z\" #3)")
    assert m == {"phrase": "p.*", "regex": True, "before": "x y", "after": "z", "nth": 3}


CASES = [
    ("plain text here", dict(phrase="text"), (True, 1, False)), ("a b a", dict(phrase="a"), (True, 2, True)), ("a b a", dict(phrase="a", nth=2), (True, 2, False)), ("a b a", dict(phrase="a", nth=3), (False, 2, False)),
    ("a", dict(phrase="a", nth=0), (False, 0, False)), ("informa-\ntion", dict(phrase="information"), (True, 1, False)), ("“smart” – dash", dict(phrase='"smart" - dash'), (True, 1, False)),
    ("alpha target one; beta target two", dict(phrase="target", before="beta"), (True, 1, False)), ("alpha target; alpha target", dict(phrase="target", before="alpha"), (True, 2, True)), ("x target y", dict(phrase="target", after="z"), (False, 0, False)),
    ("a.c abc", dict(phrase="a.c"), (True, 1, False)), ("a.c abc", dict(phrase="a.c", regex=True), (True, 2, True)), ("abc", dict(phrase="(", regex=True), (False, 0, False)), ("abc", dict(phrase=" "), (False, 0, False)),
]


def test_resolution(spark):
    rows = [(i, t, dict(phrase=None, regex=False, before=None, after=None, nth=None) | m) for i, (t, m, _) in enumerate(CASES)]
    df = spark.createDataFrame([(i, t, tuple(m[k] for k in ("phrase", "regex", "before", "after", "nth"))) for i, t, m in rows], "i int, text string, marker struct<phrase:string,regex:boolean,before:string,after:string,nth:int>")
    got = grounding.folded(df).select("i", anchors.resolve(F.col("marker"), F.col("flat"), F.col("nohy")).alias("r")).select("i", "r.*").orderBy("i").collect()
    assert [(r["found"], r["count"], r["ambiguous"]) for r in got] == [c[2] for c in CASES]


def test_status_order(spark):
    """Each case before the next, whatever else holds."""
    sha = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"  # of hello
    rows = [
        (1, "x", None, None, None, "source-not-installed"), (2, "x", "hello", "bad", "2020-01-01", "source-stale"), (3, "x", "hello", sha, "2020-01-01", "not-found"), (4, "l", "hello", sha, "2020-01-01", "ambiguous"),
        (5, "hell", "hello", sha, "soon", "review-date-invalid"), (6, "hell", "hello", sha, "2020-01-01", "review-expired"), (7, "hell", "hello", "", None, "source-unstamped"), (8, "hell", "hello", sha, "2030-01-01", "found"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "id int, phrase string, text string, stored_sha string, review_by string").withColumn("marker", grounding.marker(F.col("phrase")))
    got = {r["id"]: r["status"] for r in grounding.evidence_status(df, "2026-01-01", require_stamp=True).collect()}
    assert got == {r[0]: r[5] for r in rows}
    folded = spark.createDataFrame([(9, "two words", "two\nwords", "", None)], "id int, phrase string, text string, stored_sha string, review_by string").withColumn("marker", grounding.marker(F.col("phrase")))
    assert grounding.evidence_status(folded, "2026-01-01").first()["status"] == "folded-only"


def _orders(spark, control, candidate):
    a, b = (agreement.positions(spark.createDataFrame([(1, t)], "id int, text string")) for t in (control, candidate))
    bag = agreement.bags(a, b)
    sizes = agreement.containment(bag)
    return sizes, agreement.window_orders(bag, sizes)


def test_reversed_windows_are_inverted(spark):
    words = [f"w{i}" for i in range(2000)]
    pages = [words[i : i + 400] for i in range(0, 2000, 400)]
    sizes, orders = _orders(spark, " ".join(words), " ".join(w for p in pages for w in reversed(p)))
    assert sizes.first()["containment"] == 1.0 and all(r["rank_order"] < -0.99 for r in orders.collect())


def test_abstained_windows_stay(spark):
    sizes, orders = _orders(spark, "a a a", "a a a")
    rows = orders.collect()
    assert len(rows) == 1 and rows[0]["rank_order"] is None and agreement.order_summary(orders).first()["median"] is None


def test_decision(spark):
    schema = "id int, containment double, inflation double, measured_share double, median double, worst double, declared int, pages array<int>, accepted boolean"
    rows = [(1, 0.9, 1.0, 1.0, 0.9, 0.8, None, None, False), (2, 0.5, 1.0, 1.0, 0.9, 0.8, None, None, False), (3, 0.9, 1.0, 0.5, 0.9, 0.8, None, None, False), (4, 0.9, 1.0, 1.0, 0.9, 0.8, 3, [1, 3], False), (5, 0.5, 2.0, 1.0, 0.9, 0.8, None, None, True), (6, None, None, None, None, None, 0, None, False), (7, None, None, None, None, None, 2, [1, 2], False)]
    got = {r["id"]: (r["state"], r["reasons"]) for r in agreement.decide(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["verified", "failed", "abstained", "failed", "unverified", "abstained", "verified"]
    assert got[4][1] == ["pages-missing"] and got[5][1] == ["containment", "inflation-high"]


def test_kappa_by_matrix(spark):
    import random

    random.seed(3)
    pairs = [(random.randrange(4), random.randrange(4)) for _ in range(60)]
    n, k = len(pairs), 4
    seen = sum((x - y) ** 2 for x, y in pairs) / n
    expected = sum((x - y) ** 2 for x, _ in pairs for _, y in pairs) / n / n
    df = spark.createDataFrame([("c", k - 1, x, y) for x, y in pairs], "criterion string, scale int, x int, y int")
    assert evaluation.rater_agreement(df).where("criterion = 'c'").first()["qwk"] == pytest.approx(1 - seen / expected, abs=1e-6)
    same = spark.createDataFrame([("c", 3, 1, 1)] * 5, "criterion string, scale int, x int, y int")
    assert evaluation.rater_agreement(same).where("criterion = 'c'").first()["verdict"] == "undefined"


def test_verdict_at_the_hurdle(spark):
    """Two of three is 66.7: below 67, at or above 66; no double decides."""
    scale = spark.createDataFrame([("d", "a", 3), ("d", "b", 3)], "dimension string, criterion string, top int")
    scores = spark.createDataFrame([("x", "d", "a", 2), ("x", "d", "b", 2), ("y", "d", "a", 3)], "draft string, dimension string, criterion string, score int")
    assert [(r["draft"], r["points"], r["go"]) for r in gate.verdicts(scale, scores, 67).collect()] == [("x", 66, False)]
    assert gate.verdicts(scale, scores, 66).first()["go"]
    assert [(r["draft"], r["problem"]) for r in gate.score_problems(scale, scores).collect()] == [("y", "missing")]


def test_rubric_rules(spark):
    field = {"value": "v", "kind": "derived", "warrant": "w"}
    level = lambda i: {"score": i, "descriptor": field}
    good = {"id": "clear-aim", "criticality": "required", "statement": field, "guidance": field, "levels": [level(0), level(1)], "evidence": [{"card": "k", "phrase": "p"}]}
    bad = good | {"id": "c1", "levels": [level(0), level(2)], "evidence": [{"card": "z", "phrase": "p", "nth": 0}], "statement": {"value": "v", "kind": "explicit"}}
    import json

    df = spark.read.schema(gate.RUBRIC).json(spark.sparkContext.parallelize([json.dumps({"schema": gate.SCHEMA, "dimension": "d", "panel": ["k"], "criteria": [good, bad]})]))
    assert {(r["criterion"], r["rule"]) for r in gate.violations(df).collect()} == {("c1", x) for x in ("id-positional", "levels", "panel", "nth", "envelope")}
    with pytest.raises(ValueError):
        gate.load_rubric('{"a": 1, "a": 2}')
    assert gate.rubric_digest({"a": 1, "admission": "x"}) == gate.rubric_digest({"a": 1, "admission": "y"})


def test_tokens_of_plain_texts_stay_in_the_jvm(spark):
    rng = random.Random(6)
    pool = "aZ éÉßςΣσäÖñŞşİı0١²½ﬁﬃ-–‐ \n\t\x1c\u0301\u00adКйЇ한ᄒ中ⅣⓐＡ.,'_ǅŉµſ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["".join(rng.choice("aZ éÉßςΣσäÖñ0-\nКй.,'_") for _ in range(12)) for _ in range(400)] + [None, "", "well-\n known", "Straße ΟΔΟΣ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.all_tokens(F.col("t")).alias("a"), T.exact_tokens(F.col("t")).alias("b"), T.tokens(F.col("t")).alias("c"), T.is_plain(F.col("t")).alias("p"), "t").collect()
    assert all(r["a"] == r["b"] for r in got), [r for r in got if r["a"] != r["b"]][:3]
    assert sum(bool(r["p"]) for r in got) > 400 and all(r["c"] == r["b"] for r in got if r["p"])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.where(T.is_plain(F.col("text"))).count() > 0.5 * docs.count()


def test_framework_sections_of_one_number(spark):
    text = "### 1. One\nfirst\n### 2. Two\nb\n### 1. Again\nlast\n### 99. Beyond\nx"
    got = spark.createDataFrame([(text,)], "t string").select(library.framework_sections(F.col("t")).alias("m")).first()["m"]
    assert list(got.values()) == ["b", "last"] or sorted(got.values()) == ["b", "last"]


def test_files_that_an_enumeration_misses(spark, tmp_path):
    for n in ("a.md", "b.md", ".hidden.md", "INDEX.md", "c.txt"):
        (tmp_path / n).write_text("x")
    there = library.listed(spark, str(tmp_path), ".md", ("INDEX.md",))
    assert {r["name"] for r in library.tripwire(spark.createDataFrame([("a",)], "name string"), there).collect()} == {"b"}
    assert library.listed(spark, str(tmp_path / "none")).count() == 0


def test_normalize(spark):
    assert normalize.repair_control("de\x1fnition of \x1fne art; de\x1fne it", frozenset({"definition", "define", "fine"})) == "definition of  ne art; define it".replace("of  ne", "of  ne")
    assert normalize.strip_furniture("text\n12\n\nxiv\n| 1 | 2 |\n2003\nI") == "text\n\n| 1 | 2 |\n2003\nI"
    assert normalize.restore("Defne the FRST fllm") == "Define the FIRST film"
    body = "\n".join(["This is a line of the paragraph that goes on and behav-", "ior is then explained at the length of a line, well-", "known to all who read the page to the end of it now", "and it ends."])
    assert normalize.reflow(body, frozenset({"well", "known"})) == "This is a line of the paragraph that goes on and behavior is then explained at the length of a line, well-known to all who read the page to the end of it now and it ends."


def test_html():
    page = '<html><head><meta charset="utf-8"><title>T</title><script>x</script></head><body><p>One &amp; two</p><p>three<br>four</p><style>p{}</style></body></html>'
    assert formats.html_text(page) == "One & two\n\nthree\nfour"


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_archives(spark):
    epub = _zip({
        "mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>',
        "o/c.opf": '<package><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "o/a.html": "<p>last</p>", "o/b.html": "<p>first</p>",
    })
    docx = _zip({"word/document.xml": '<d xmlns:w="w"><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:t>c</w:t></w:p></d>'})
    rows = [("e", epub), ("d", docx), ("t", "plain ÿ".encode("latin-1")), ("p", b"%PDF-1.7"), ("z", _zip({"../x": "1", "word/document.xml": "<a/>"})), ("n", None)]
    got = {r["path"]: r for r in formats.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["e"]["text"] == "first\n\nlast" and got["d"]["text"] == "a\tb\nc" and got["t"]["text"] == "plain ÿ"
    assert got["p"]["text"] is None and got["p"]["error"] and "unsafe" in got["z"]["error"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Straße informa-\n tion ΟΔΟΣ x²") == ["strasse", "information", "οδοσ", "x²"]
    assert one(spark, T.exact_tokens(F.col("t")), t="ﬁne Ａ1") == ["fine", "a1"]
    assert one(spark, T.terms(F.col("t")), t="What is the pacing of a Scene, pacing?") == ["pacing", "scene"]


def test_blocks_of_eight_lines(spark):
    text = "\n".join(f"l{i}" for i in range(10)) + "\n\nnext"
    got = retrieval.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(1, 8), (9, 10), (12, 12)]


def test_context_window_keeps_the_match(spark):
    row = spark.range(1).select(grounding.context_window(F.lit(50), F.lit(95), F.lit(200), 3, 40).alias("a"), grounding.context_window(F.lit(50), F.lit(87), F.lit(200), 3, 40).alias("b"), grounding.context_window(F.lit(1), F.lit(1), F.lit(2), 3, 40).alias("c")).first()
    assert tuple(row["a"]) == (50, 89) and tuple(row["b"]) == (48, 87) and tuple(row["c"]) == (1, 2)


def test_missing_source_is_unmeasured(spark):
    cards = spark.createDataFrame([(1, "a", "", None, None)], "id int, rel string, stored_sha string, review_by string, superseded_by string")
    none = spark.createDataFrame([], "rel string, text string")
    anchors_ = spark.createDataFrame([(1, "p")], "id int, phrase string").select("id", grounding.marker(F.col("phrase")).alias("marker"))
    r = grounding.report(linter.check(cards, none, anchors_, "2026-01-01", index=cards.select("id"))).first()
    assert (r["errors"], r["unmeasured"], r["ok"]) == (0, 1, False)


def test_paired_ranking_uses_shared_documents(spark):
    rows = [(d, t, r, o) for d, t, r, o in [(1, "a", 0.9, -0.5), (2, "a", 0.9, -0.4), (1, "b", 0.8, 0.9), (2, "b", 0.7, 0.9), (3, "a", 0.1, 0.1), (3, "b", None, None)]]
    got = evaluation.paired_ranking(spark.createDataFrame(rows, "doc int, tier string, recall double, orders double"), ["a", "b"]).orderBy("rank").collect()
    assert [(r["tier"], r["docs"]) for r in got] == [("b", 2), ("a", 2)]


def test_context_of_evidence(spark):
    """The pinned occurrence is the one shown; what folds over a line break is placed; what can't be placed isn't usable."""
    text = "wrong target\nfiller\nalpha target\ntwo\nwords here\nhyphen-\nated end"
    marks = [(1, "target", "alpha", None), (2, "target", None, 2), (3, "two words", None, None), (4, "hyphenated", None, None), (5, "absent", None, None), (6, "target", None, None)]
    df = spark.createDataFrame([(i, p, b, n, text, "", None) for i, p, b, n in marks], "id int, phrase string, b string, n int, text string, stored_sha string, review_by string")
    df = df.withColumn("marker", grounding.marker(F.col("phrase"), before=F.col("b"), nth=F.col("n")))
    got = {r["id"]: r for r in grounding.evidence_context(df, "2026-01-01", around=0).collect()}
    assert (got[1]["status"], got[1]["line_start"], got[1]["context"]) == ("found", 3, "alpha target") and got[2]["line_start"] == 3
    assert (got[3]["status"], got[3]["line_start"], got[3]["line_end"], got[3]["context"]) == ("folded-only", 4, 5, "two\nwords here")
    assert (got[4]["status"], got[4]["usable"]) == ("folded-only", False) and (got[5]["status"], got[5]["usable"]) == ("not-found", False) and got[6]["status"] == "ambiguous"
