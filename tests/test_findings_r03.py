"""Queries against their SQL on small tables of the rows in which they differed, and what large tables need."""

import math

import duckdb
import pytest

from pyspark.sql import functions as F

from quoin.plans import catalog

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


def differ(spark, at, name, table, rows, schema):
    """What only the query and only its SQL give for a table of these rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(at))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert got
    return [r for r in got if r not in want], [r for r in want if r not in got]


def texts(*rows):
    return [(i, t, "en", "src0", len(t)) for i, t in enumerate(rows, 1)]


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("a8_page_recall", texts("maß mass ein zwei drei vier maß mass ein zwei", "one tw- o three", "abcd- efgh", "a b c d e f g h i j k l")),
        ("s8_card_fields", texts("x" * 199 + "### next of it\nmore", "y" * 200 + "## Thin\nother", "short", "# one\n## two\n## Full\nlast of them")),
        ("s24_ingest_transactions", texts("A.", "12", "xiv", "a real text of words", "Head\nHead\nHead\nHead\nHead", "| a | b |", "  ", "...", "A.\nbut this is one")),
    ],
)
def test_documents_against_sql(spark, tmp_path, name, rows):
    assert differ(spark, tmp_path, name, "documents", rows, DOCS) == ([], [])


def test_entities_without_semicolon(spark, tmp_path):
    html = ["<html><body><h1>cut &amp</h1><p>a &amp;&am b &copy 1</p></body></html>", "<html><body><p>a &lt;b&gt; &amp;quot; x</p></body></html>"]
    rows = [(i, "u", h) for i, h in enumerate(html, 1)]
    assert differ(spark, tmp_path, "s15_html_text", "pages", rows, "page_id long, url string, html string") == ([], [])


def test_part_of_a_run_without_a_limit_in_one_task(spark, tmp_path):
    from quoin.operators import runs

    rows = spark.range(40).selectExpr("id AS doc", "explode(array('b', 'a')) AS tier", "cast(id AS string) AS digest", "repeat('x', 9) AS text")
    plans = []

    def measure(left):
        plans.append(left._jdf.queryExecution().executedPlan().toString())
        return left.selectExpr("doc", "tier", "length(text) AS value")

    first = runs.resume(rows, f"{tmp_path}/run", {}, measure, 47)
    assert sorted((r["tier"], r["doc"]) for r in first.collect()) == [("a", i) for i in range(40)] + [("b", i) for i in range(7)]
    assert "Limit" not in plans[0] and "TakeOrdered" not in plans[0]
    assert runs.resume(rows, f"{tmp_path}/run", {}, measure).count() == 80


def test_workers_get_bounded_batches(spark, tmp_path):
    from quoin.sources import formats

    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 40)}
    for run in (lambda: formats.extract(spark.createDataFrame([("a", b"x")], "path string, content binary")), lambda: catalog.QUERIES["h11_rubric_types"](spark, "/root/testdata/sf0.001")):
        for k, v in keys.items():
            spark.conf.set(k, v)
        run()
        assert [int(spark.conf.get(k)) <= most for k, most in zip(keys, (500, 8 << 20), strict=True)] == [True, True]


def test_files_are_listed_by_tasks(spark, tmp_path):
    from quoin.sources import library

    at = tmp_path / "a b[1] %41+é"
    at.mkdir()
    (at / "sub.md").mkdir()
    for name in ("a.md", "b+c %41.md", "_d.md", ".e.md", "f.txt", "é[1].md"):
        (at / name).write_bytes(name.encode() + b"\xff")
    for folder in (str(at), f"file://{at}"):
        found = library.files(spark, folder, "*.md", r"\.md")
        assert sorted((r["name"], r["text"]) for r in found.collect()) == [("a", "a.md�"), ("b+c %41", "b+c %41.md�"), ("é[1]", "é[1].md�")]
        assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["name"] for r in library.listed(spark, folder, ".md", ("a.md",)).collect()) == ["_d", "b+c %41", "é[1]"]


def test_archives_are_told_apart_by_workers(spark):
    import io
    import zipfile

    from quoin.sources import formats

    def packed(*members, method=zipfile.ZIP_STORED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    epub = ("mimetype", f" {formats.EPUB}\n"), ("a", "x" * 300)
    files = [packed(*epub), packed(*epub, method=zipfile.ZIP_DEFLATED), packed((formats.DOCUMENT, "<d/>")), packed(("a", "x")), packed(*epub)[:-9], b"PK\x03\x04 torn", b"%PDF-1", b" <html>", b"text", b"", b"\x00", None]
    found = formats.extract(spark.createDataFrame(list(enumerate(files)), "path long, content binary"))
    assert str(found._jdf.queryExecution().optimizedPlan()).count("StringDecode") < 30
    sniffed = spark.createDataFrame(list(enumerate(files)), "path long, content binary").select("path", formats.sniffed(F.col("content")))
    assert [r["format"] for r in found.orderBy("path").collect()] == [r[1] for r in sniffed.orderBy("path").collect()] == ["epub", None, "docx", None, None, None, "pdf", "html", "txt", None, None, None]


def test_names_meet_lenses_by_whole_words(spark):
    from quoin.operators import retrieval

    long = "x" * 20_000  # what a piece index would take apart
    lenses = [("source", "s-1", f"the the Art of {long}", None), ("source", "s-2", "parted art, part9", "art"), ("source", "s-3", "Part é", None), ("dimension", "part-who", "", None), ("dimension", "part-what", "", None), ("source", "s-1", "art too", None)]
    rows = spark.createDataFrame(lenses, "kind string, name string, title string, aliases string")
    found = retrieval.consult(spark.createDataFrame([(0, "art"), (1, "part"), (2, "art art"), (3, "s-3"), (4, "zz")], "query_id int, name string"), rows)
    got = [(r["query_id"], r["status"], r["rank"], r["name"]) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(0, "ambiguous", 1, "s-1"), (0, "ambiguous", 2, "s-1"), (0, "ambiguous", 3, "s-2"), (1, "ambiguous", 1, "part-what"), (1, "ambiguous", 2, "part-who"), (2, "ambiguous", 1, "s-1"), (2, "ambiguous", 2, "s-1"), (2, "ambiguous", 3, "s-2"), (3, "exact", 1, "s-3"), (4, "none", None, None)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_plain_texts_are_told_without_flat_classes(spark):
    import re

    from quoin.functions import text as T

    flat = re.findall(r"\[(?:\\x\{?[0-9a-f]+\}?-\\x\{?[0-9a-f]+\}?){3,}\]", T.NOT_PLAIN)
    assert flat == []
    codes = {i for a, b in T._PLAIN for i in range(a, b + 1)}
    chars = spark.range(0x3000).where("id not in (0)").select("id", F.expr("concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'b')").alias("c"))
    assert {r["id"] for r in chars.where(T.is_plain(F.col("c"))).collect()} == codes - {0}
    texts = chars.where(T.is_plain(F.col("c"))).select("c", T.tokens(F.col("c")).alias("t"))
    assert [r["c"] for r in texts.collect() if r["t"] != ["".join(ch if ch.isalnum() else " " for ch in re.sub(r"-\s*", "", r["c"]).casefold()).split()][0]] == []


def test_folds_take_space_as_python_does(spark):
    from quoin.functions import text as T

    chars = [chr(i) for i in range(1, 0x3100)] + ["﻿", "\U0001f600"]
    rows = [(i, t) for i, t in enumerate([f"a {c} b{c}{c}c{c}" for c in chars] + ["", " ", "\r\n", "a\n\r\nb\r\r\n\n", "“a”–b… ‘c’", "a-\n b -", "  a  b ", "\x1fa\x00"])]
    c = F.col("t")
    got = spark.createDataFrame(rows, "i int, t string").select("t", T.norm(c).alias("n"), T.split_words(c).alias("w"), T.split_lines(c).alias("l"), T.dehyphenate(c).alias("d")).collect()
    for r in got:
        plain = "".join(" " if ch < " " and ch not in "\t\n\r" or ch == "\x7f" else ch for ch in r["t"].replace("\x0b", " ").replace("\x0c", " "))
        for k, v in T.TYPOGRAPHY.items():
            plain = plain.replace(k, v)
        assert r["n"] == " ".join(plain.split()), ascii(r["t"])
        assert (r["w"], r["l"]) == (r["t"].split(), r["t"].splitlines()), ascii(r["t"])
        assert r["d"] == __import__("re").sub(r"-[^\S\x1c-\x1f]*", "", r["t"]), ascii(r["t"])
    empty = spark.createDataFrame([(None,)], "t string").select(T.norm(c), T.split_words(c), T.split_lines(c), T.dehyphenate(c)).first()
    assert list(empty) == [None] * 4


def test_sources_are_folded_once_for_all_their_markers(spark, monkeypatch):
    from quoin.operators import grounding as G

    monkeypatch.setattr(G, "ANCHORS", 2)
    rows = [("a", "one two-\nfold one\n\nlast  line", "", None), ("b", "x", "bad", None), ("c", "due", None, "2020-01-01"), ("d", None, None, None)]
    cards = spark.createDataFrame(rows, "card string, text string, stored_sha string, review_by string")
    marks = [("one", None, None, None, False), ("last", None, None, None, False), ("twofold", None, None, None, False), ("one", "two-fold", None, None, False), ("one", None, "two", 2, False), ("l.st", None, None, None, True), ("(", None, None, None, True), ("", None, None, None, False), ("last line", None, None, None, False), ("zz", None, None, None, False), ("due", None, None, None, False), ("x", None, None, 1, False)]
    asked = spark.createDataFrame([(c, i, *m) for c in ("a", "b", "c", "d", "gone", None) for i, m in enumerate(marks)], "card string, i int, phrase string, before string, after string, nth int, regex boolean")
    asked = asked.select("card", "i", F.struct("phrase", "regex", "before", "after", "nth").alias("marker"))
    alone, beside = G.evidence_status(asked.join(cards, "card", "left"), "2026-01-01"), G.evidence_status(G.by_source(asked, cards), "2026-01-01")
    told = [sorted(map(str, df.select("card", "i", "status", "count", "lines").collect())) for df in (alone, beside)]
    assert told[0] == told[1] and len(told[0]) == 72
    plan = beside._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(own") < plan.index("AS flat#")  # the fold is below
    assert {r["status"] for r in beside.where("card is null or card in ('d', 'gone')").collect()} == {"source-not-installed"}


@pytest.mark.parametrize("name", ["gate_panel_grounding", "r17_explicit_gaps", "r14_gate"])
def test_gates_fold_each_card_once(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS flat#") == plan.count("explode(own") <= 2 and plan.index("explode(own") < plan.index("AS flat#")
    assert not [line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter") and "regexp_replace" in line and "translate" in line]


def test_what_is_named_often_is_computed_once(spark):
    from quoin.operators import retrieval
    from quoin.operators import services as S

    row = spark.createDataFrame([("One tion here. Reau and tion. Last of the tion.", "Reau  and")], "text string, phrase string")
    score = row.select(retrieval.passage_score(F.col("text"), F.array(F.lit("tion"), F.lit("reau")), F.lit("reau and")).alias("x"))
    window = row.select(S.sentence_window(F.col("text"), F.col("phrase"), 0).alias("x"))
    assert (score.first()["x"], window.first()["x"]) == (5.0 + 10.0 + 4, "Reau and tion.")
    told = [df._jdf.queryExecution().analyzed().toString() for df in (score, window)]
    assert told[0].count("lower(text") == 1 and told[1].count("split(trim(text") == 1


def test_pinned_places_in_one_reading(spark):
    from quoin.functions.anchors import resolve

    text = "pre ab ab xab preab yab post " * 4000 + "preab post abab"
    marks = [("ab", "pre", None), ("ab", None, "post"), ("ab", "pre", "post"), ("ab", "ab", None), (r"a\Eb", "p", None), ("abab", "x", None), ("ab", "p-re", None)]
    df = spark.createDataFrame([(i, *m, None, text) for i, m in enumerate(marks)], "i int, phrase string, before string, after string, nth int, flat string")
    df = df.select("i", resolve(F.struct("phrase", F.lit(False).alias("regex"), "before", "after", "nth"), F.col("flat"), F.col("flat"), False)["count"].alias("n"))
    assert "aggregate(" not in df._jdf.queryExecution().analyzed().toString()

    def places(p, b, a):
        at, n = text.find(p), 0
        while at >= 0:
            n += (not b or text.endswith((b, b + " "), 0, at)) and (not a or text.startswith((a, " " + a), at + len(p)))
            at = text.find(p, at + len(p))
        return n

    assert [r["n"] for r in df.orderBy("i").collect()] == [places(p, b and b.replace("-", ""), a) for p, b, a in marks]


@pytest.mark.parametrize("few", [{}, {"FEW_WORDS": 0}, {"FEW_WORDS": 0, "FEW_TERMS": 0}, {"FEW_TEXTS": 0}, {"FEW_TEXTS": 0, "FEW_TERMS": 0}])
def test_index_scores_the_same_by_every_way(spark, tmp_path, monkeypatch, few):
    from quoin.operators import retrieval, search_index

    for k, v in few.items():
        monkeypatch.setattr(search_index, k, v)
    texts = ["the nation of the nation", "of  the", "", None, "a b\x1cof the the", "ofthe the of", "theory of the other", "é é the é"]
    blobs = spark.createDataFrame(list(enumerate(texts)), "id long, blob string")
    questions = spark.createDataFrame([(1, ["the", "e"]), (2, ["of the", "é"]), (3, ["tion", "THE OTHER"]), (4, ["zzqx"])], "question int, terms array<string>")
    own = search_index.Index(spark, str(tmp_path / "index"))
    own.add(blobs.where("id < 6").withColumn("blob", F.when(F.col("id") % 2 == 1, "of the old nation").otherwise(F.col("blob"))))
    own.add(blobs.where("id >= 6 or id % 2 = 1"))
    want = {(r["question"], r["id"]): round(r["score"], 9) for r in retrieval.bm25(blobs.withColumn("blob", F.coalesce("blob", F.lit(""))), questions).collect()}
    assert {(r["question"], r["id"]): round(r["score"], 9) for r in own.search(questions).collect()} == want
    assert {q for q, _ in want} == {1, 2, 3}


def test_postings_of_a_frequent_word_are_not_one_task(spark, tmp_path):
    from quoin.operators import search_index

    own = search_index.Index(spark, str(tmp_path / "index"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own.add(spark.range(400).selectExpr("id", "concat('the w', id) AS blob"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(f"{own.at}/postings").where("word = 'the'").select("id", F.input_file_name().alias("file"))
    assert rows.count() == 400 and rows.select("file").distinct().count() > 1
