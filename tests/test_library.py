"""Knowledge bases on disk, services, the gate end to end, and the stream."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import gate, grounding, services
from quoin.sources import library
from quoin.streaming import ingest


@pytest.fixture
def kb(tmp_path):
    root = tmp_path / "kb[1] x"
    for p, t in {
        "books/brevity.txt": "Omit needless words.\nA sentence should contain\nno unnecessary words.", "books/.hidden": "x", "cards/brevity.md": "---\nid: brevity\nfile: ./books/brevity.txt\naliases: short, terse\n---\n# On Brevity\n\n## Thin\nCut (grep: `needless words`).\n## Full\nMore.\n",
        "cards/INDEX.md": "# board", "cards/README.md": "# read", "lenses/pacing.md": "# Pacing", "lenses/_diagnostics.md": "x", "lenses/GATE-TRIAGE.md": "x", "notes/bad.txt": "x",
    }.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (root / "books/latin.txt").write_bytes(b"caf\xe9")
    return library.manifest('id = "kb"\nshelves = ["books"]\n', str(root))


def test_tables_of_a_library(spark, kb):
    got = {r["id"]: r for r in library.sources(spark, kb).collect()}
    assert set(got) == {"brevity", "latin"} and got["latin"]["text"] == "caf�" and got["latin"]["size"] == 4
    assert got["brevity"]["sha256"] == hashlib.sha256(got["brevity"]["text"].encode()).hexdigest()
    (card,) = library.cards(spark, kb).collect()
    assert (card["id"], card["title"], card["aliases"], card["thin"]) == ("brevity", "On Brevity", "short, terse", "Cut (grep: `needless words`).")
    assert [r["name"] for r in library.lenses(spark, f"{kb.root}/lenses").collect()] == ["pacing"]
    seen = library.cards(spark, kb).select(F.col("stem").alias("name"))
    assert library.tripwire(seen, spark.createDataFrame([("brevity",), ("lost",)], "name string")).collect()[0]["name"] == "lost"


@pytest.mark.parametrize("text", ["id = 1", 'id = "A b"\nshelves = []', 'id = "a"\nshelves = [".."]', 'id = "a"\nshelves = ["x/y"]', 'id = "a"\nshelves = ["x"]\ncards = "../c"', "="])
def test_manifests_are_strict(text):
    with pytest.raises(library.ConfigError):
        library.manifest(text, "/r")


def test_registry_isolates_errors():
    good = ('id = "a"\nshelves = ["x"]', "/r")
    rows = {r["name"]: r for r in library.registry({"one": good, "two": ("=", "/r"), "three": good})}
    assert not rows["two"]["ok"] and not rows["one"]["ok"] and "repeated" in rows["three"]["error"]


def test_diagnostics_table(spark):
    text = "# map\n| cues | dims |\n|---|:--:|\n| slow, Drags | Pacing, story arc |\n| a\\|b | x |\nprose\n| | y |"
    got = library.diagnostics(spark.createDataFrame([(text,)], "text string")).orderBy("ord").collect()
    assert [(r["cues"], r["dims"]) for r in got] == [(["slow", "drags"], ["Pacing", "story arc"]), (["a|b"], ["x"])]


def test_page_provenance(spark):
    js = json.dumps({"texts": [{"text": "a", "prov": [{"page_no": 2}]}, {"text": "b", "prov": [{"page_no": 1}]}, {"text": "c", "prov": [{"page_no": 2}]}]})
    rows = spark.createDataFrame([(1, js), (2, '{"texts": [{"text": "x"}]}')], "id int, json string")
    assert [tuple(r) for r in library.docling_pages(rows).orderBy("page").collect()] == [(1, 1, "b"), (1, 2, "a\nc")]
    marked = spark.createDataFrame([(1, "{0}------\none\n{1}------\ntwo"), (2, "{1}------\na\n{1}------\nb"), (3, "none")], "id int, text string")
    assert [tuple(r) for r in library.marker_pages(marked).orderBy("page").collect()] == [(1, 1, "one"), (1, 2, "two")]


def test_framework_sections_and_marks(spark):
    text = "# T\n### 1. Claim\nc body\n### 4. Practices\np\nq\n### 9. Beyond\nz\n"
    mark = "<!-- scaffold: managed by any-tool v2 — edit Thin/Full below the marker by hand -->"
    row = spark.createDataFrame([(text, f"front\n{mark}\nmine", "none")], "a string, b string, c string").select(library.framework_sections(F.col("a")).alias("a"), library.body_below_mark(F.col("b")).alias("b"), library.body_below_mark(F.col("c")).alias("c")).first()
    assert row["a"] == {"claim": "c body", "practices": "p\nq"} and row["b"] == "\nmine" and row["c"] is None


def test_rating_sheet(spark, tmp_path):
    f = tmp_path / "sheet.jsonl"
    f.write_text('{"schema": "s", "rater": "ann", "rows": 2}\n{"draft": "d", "criterion": "c", "max_score": 3, "score": 2}\n{"draft": "d", "criterion": "e", "max_score": 3, "score": null}\n')
    header, rows = library.rating_sheet(spark, str(f))
    assert header.first()["rater"] == "ann" and rows.count() == 2 and rows.where("score is null").count() == 1
    f.write_text('{"draft": "d", "score": "two"}\n')
    with pytest.raises(Exception):
        library.rating_sheet(spark, str(f))[1].collect()


def test_services(spark):
    cards = spark.createDataFrame([("k1", "a", "On Pacing", None, "s", "thin", "pacing text", ""), ("k2", "b", "Other", None, "s", "stub", "pacing pacing", ""), ("k3", "c", "No", None, "s", "stub", "x", "")], "kb string, id string, title string, aliases string, shelf string, zoom string, thin string, full string")
    assert {r["id"] for r in services.execute("search", {"cards": cards}, {"terms": ["Pacing"]}, ["k1", "k2"]).collect()} == {"a", "b"}
    assert services.execute("zoom", {"cards": cards}, {"id": "a", "level": "thin"}).first()["body"] == "pacing text"
    assert services.execute("cards", {"cards": cards}, {}, ["k3"]).count() == 1
    for bad in (lambda: services.execute("nope", {}, {}), lambda: services.execute("search", {}, {}), lambda: services.execute("zoom", {"cards": cards}, {"id": "a"}, ["k1", "k2"])):
        with pytest.raises(ValueError):
            bad()


def test_evidence_routes(spark):
    src = "First line.\nPacing is the tempo of scenes.\nLast."
    rows = [("a", "Tempo of scenes and pacing (grep: `tempo of scenes`)\n\nOther", src), ("b", "nothing", src), ("c", "nothing", "unrelated")]
    got = {r["id"]: r for r in services.retrieve_evidence(spark.createDataFrame(rows, "id string, body string, text string"), "pacing tempo scenes").collect()}
    assert (got["a"]["route"], got["a"]["start"], got["a"]["end"], got["a"]["passage"]) == ("card-anchor", 1, 3, src)
    assert got["b"]["route"] == "full-text" and got["c"]["status"] == "insufficient" and got["c"]["full_text"]
    forced = services.retrieve_evidence(spark.createDataFrame(rows[:1], "id string, body string, text string"), "pacing tempo scenes", full_text=True).first()
    assert (forced["route"], forced["start"]) == ("full-text", 1)
    odd = [("s", "x", src, "bad", None), ("n", "x", None, None, None), ("e", rows[0][1], src, None, "2020-01-01")]
    told = {r["id"]: r for r in services.retrieve_evidence(spark.createDataFrame(odd, "id string, body string, text string, stored_sha string, review_by string"), "pacing tempo scenes", "2026-01-01").collect()}
    assert told["s"]["issues"] == ["source-stale"] and told["n"]["issues"] == ["source-not-installed"] and told["e"]["issues"] == ["review-expired"] and told["e"]["route"] == "full-text"
    assert services.retrieve_evidence(spark.createDataFrame(rows[:1], "id string, body string, text string"), "of the").first()["status"] == "insufficient"


def test_panel_status(spark):
    rows = [("x", 0, "not-found"), ("x", 1, "source-stale"), ("y", 0, "found"), ("y", 1, "ambiguous"), ("z", 0, "found"), ("z", 1, "found")]
    got = {r["anchor"]: r["status"] for r in services.worst_reason(spark.createDataFrame(rows, "anchor string, ord int, status string")).collect()}
    assert got == {"x": "source-stale", "y": "found", "z": "ambiguous-panel"}


def _rubric(**change):
    field = {"value": "v", "kind": "derived", "warrant": "w"}
    level = lambda i: {"score": i, "descriptor": field}
    c = {"id": "aim", "criticality": "required", "statement": field, "guidance": field, "levels": [level(0), level(1), level(2)], "evidence": [{"card": "k", "phrase": "needless words"}]} | change.pop("criterion", {})
    return {"schema": gate.SCHEMA, "dimension": "d", "panel": ["k"], "criteria": [c]} | change


@pytest.mark.parametrize("change, text, pin, score, want", [
    ({}, "Omit needless words.", True, 2, ("go", None)), ({}, "Omit needless words.", True, 1, ("recycle", None)), ({"admission": "candidate"}, "Omit needless words.", True, 2, ("unavailable", "not-approved")),
    ({"approved_digest": "0" * 64}, "Omit needless words.", True, 2, ("unavailable", "not-approved")), ({"criterion": {"evidence": []}}, "Omit needless words.", True, 2, ("unavailable", "rule-evidence")), ({}, "Omit needless words.", None, 2, ("unavailable", "panel-unpinned")),
    ({"schema": "other"}, "Omit needless words.", True, 2, ("unavailable", "rule-schema")), ({"criterion": {"statement": {"kind": "unknown"}}}, "Omit needless words.", True, 2, ("unavailable", "rule-statement-unknown")), ({"panel": []}, "Omit needless words.", True, 2, ("unavailable", "rule-panel")),
    ({"criterion": {"criticality": "optional"}}, "Omit needless words.", True, 2, ("unavailable", "rule-criticality")), ({}, "Omit needless words.", False, 2, ("unavailable", "panel-drifted")),
    ({}, "Omit other words.", True, 2, ("unavailable", "evidence-not-found")), ({}, "Omit needless words.", True, 3, ("unavailable", "scores")),
    ({"criterion": {"statement": {"value": "needless  words", "kind": "explicit", "evidence": [{"card": "k", "phrase": "needless words"}]}}}, "Omit needless words.", True, 2, ("unavailable", "quote-rotted")),
])
def test_review(spark, change, text, pin, score, want):
    doc = _rubric(**{k: dict(v) if isinstance(v, dict) else v for k, v in change.items()})
    doc = {"admission": "human_approved", "approved_digest": gate.rubric_digest(doc)} | doc
    rubrics = gate.read_rubrics(spark.createDataFrame([(json.dumps(doc),)], "text string"))
    assert rubrics.first()["body_digest"] == gate.rubric_digest(doc) and rubrics.first()["problems"] == (["panel: names of cards, one at least"] if doc["panel"] == [] else [])
    sha = hashlib.sha256(text.encode()).hexdigest()
    cards = spark.createDataFrame([("k", text, sha, None)], "card string, text string, stored_sha string, review_by string")
    pinned = spark.createDataFrame([("d", "k", sha if pin else "0")][: pin is not None], "dimension string, card string, pinned string")
    scores = spark.createDataFrame([("x", "d", "aim", score)], "draft string, dimension string, criterion string, score int")
    r = gate.review(rubrics, cards, pinned, scores, "2026-01-01").first()
    assert (r["outcome"], r["reason"]) == want


def test_craft_moves(spark):
    craft = "Intro\n- **Cut early.** Leave (grep: `cut`)\n- **No anchor** here"
    got = gate.craft_moves(spark.createDataFrame([("d", craft)], "dimension string, craft string")).collect()
    assert [(r["name"], len(r["markers"])) for r in got] == [("Cut early", 1), ("No anchor", 0)]
    pages = spark.range(1).select(gate.sample_pages(F.lit(10), F.lit(1618), 3).alias("a"), gate.sample_pages(F.lit(2), F.lit(1618), 3).alias("b"), gate.sample_pages(F.lit(0), F.lit(1), 3).alias("c")).first()
    assert pages["a"] == sorted(random.Random(1618).sample(range(1, 11), 3)) and pages["b"] == [1, 2] and pages["c"] == []


def test_stream_writes_each_source_once(spark, tmp_path):
    schema = "doc_id long, text string"
    drop, at = tmp_path / "drop", tmp_path
    write = lambda rows, mode: spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(drop))
    run = lambda: ingest.ingest(ingest.arrivals(spark, str(drop), spark.createDataFrame([], schema).schema), f"{at}/to", f"{at}/log", f"{at}/checkpoint").awaitTermination()
    write([(1, "one"), (2, "one"), (3, ""), (4, None), (5, "\x01\x02a")], "overwrite")
    run()
    write([(6, "one"), (7, "two")], "append")
    run()
    assert sorted(r["text"] for r in spark.read.parquet(f"{at}/to").collect()) == ["one", "two"] and spark.read.parquet(f"{at}/log").count() == 2


def test_any_of_and_phrase_hits(spark):
    sources = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "rel string, text string")
    marks = spark.createDataFrame([("x", "beta", ["a", "b"]), ("y", "delta", ["a", "zz"])], "owner string, phrase string, rels array<string>").withColumn("marker", grounding.marker(F.col("phrase"))).drop("phrase")
    assert {r["owner"]: (r["found"], r["absent"]) for r in services.any_of(marks, sources).collect()} == {"x": (True, 0), "y": (False, 1)}
    hits = grounding.phrase_hits(spark.createDataFrame([(1, "aaaa aa"), (2, None)], "id long, text string"), spark.createDataFrame([(1, "aa"), (2, ""), (3, None), (4, "aa")], "phrase_id long, phrase string"))
    assert sorted(tuple(r) for r in hits.collect()) == [(1, 1, 3), (4, 1, 3)]


def test_ingest_and_verify(spark):
    from quoin.operators import ingestion

    words = " ".join(f"word{i}" for i in range(900))
    pairs = spark.createDataFrame([(1, words, words, None, None, False), (2, words, words[:2000], None, None, False), (3, None, words, 0, None, False), (4, words, words, 2, [1], False)], "id int, control string, candidate string, declared int, pages array<int>, accepted boolean")
    assert {r["id"]: (r["state"], r["reasons"]) for r in ingestion.verify_extractions(pairs).collect()} == {1: ("verified", []), 2: ("failed", ["containment", "inflation-low"]), 3: ("abstained", []), 4: ("failed", ["pages-missing"])}
    files = spark.createDataFrame([("a", "The defne of it\n".encode()), ("b", b"<html><p>Hi there</p></html>"), ("c", b""), ("d", b"%PDF-1")], "path string, content binary")
    got = {r["path"]: r for r in ingestion.ingest_files(files).collect()}
    assert got["a"]["text"].strip() == "The define of it" and got["b"]["text"] == "Hi there" and "unsupported" in got["c"]["refused"] and got["d"]["text"] is None and got["d"]["refused"]
    assert ingestion.provenance(ingestion.ingest_files(files), "2026-01-01").count() == 2
    assert ingestion.coverage(spark.createDataFrame([(1, "one two three four five six\f\f")], "id int, text string")).first()["empty"] == [2]


def test_scaffold_keeps_what_is_written(spark):
    from quoin.operators import ingestion

    src = spark.createDataFrame([("on-style", "books", "./books/on-style.txt", "ab"), ("new", "books", "./books/new.txt", "cd")], "id string, shelf string, rel string, sha256 string")
    none = spark.createDataFrame([], "id string, card string")
    first = ingestion.scaffold(src, none)
    by_hand = first.withColumn("card", F.when(F.col("id") == "on-style", F.concat(F.regexp_replace("card", r"(?s)(-->).*", "$1"), F.lit("\n\n## Thin\nMine\n"))).otherwise(F.col("card")))
    again = {r["id"]: r["card"] for r in ingestion.scaffold(src, by_hand).collect()}
    assert again["on-style"].endswith("## Thin\nMine\n") and "zoom: full" in again["on-style"] and "zoom: stub" in again["new"] and "# On style" in again["on-style"]
    twice = ingestion.scaffold(src, spark.createDataFrame(list(again.items()), "id string, card string"))
    assert {r["id"]: r["card"] for r in twice.collect()} == again
    (line,) = ingestion.board(spark.createDataFrame([("s", "b", None), ("s", "a", "full")], "shelf string, id string, zoom string")).collect()
    assert line["line"] == "## s (2, stubs 1)\n- a\n- b"


def test_command_line(spark, kb, capsys):
    from pathlib import Path

    from quoin.__main__ import main

    root = Path(kb.root)
    (root / "library.toml").write_text('id = "kb"\nshelves = ["books"]\n')
    assert main(["--root", kb.root, "search", "needless"]) == 0 and "brevity" in capsys.readouterr().out
    assert main(["--root", kb.root, "verify", "brevity", "needless words"]) == 0 and main(["--root", kb.root, "verify", "brevity", "no such"]) == 1
    assert main(["--root", kb.root, "zoom", "brevity", "thin"]) == 0 and main(["--root", kb.root, "check"]) == 1
    assert "[B]" in capsys.readouterr().out  # latin.txt has no card


def test_small_operators(spark):
    from quoin.operators import ingestion

    secs = spark.createDataFrame([(1, {"claim": "c", "engine": "e"}), (2, {"claim": "c"})], "i int, s map<string,string>").select("i", services.framework_default(F.col("s")).alias("s"))
    assert {r["i"]: r["s"] for r in secs.collect()} == {1: {"engine": "e"}, 2: {"claim": "c"}}
    fw = spark.createDataFrame([("a", "see library/books/x.txt and library/books/y.txt"), ("b", "mylibrary/books/z.txt; library/books/x.txt"), ("c", "none")], "name string, text string")
    assert [tuple(r) for r in services.source_of_framework(fw, ["books"]).collect()] == [("library/books/x.txt", "b")]
    table = spark.createDataFrame([("| pacing too | z |\n| **Pacing/Beat** | keep |\nprose",)], "text string")
    assert services.triage_row(table, "pacing-beat").first()["row"] == "| **Pacing/Beat** | keep |" and services.triage_row(table, "voice").count() == 0
    pages = spark.createDataFrame([(["one page\n12", "two page\n13"],), ([],)], "p array<string>").select(ingestion.normalized_pages(F.col("p")).alias("p"))
    assert [r["p"] for r in pages.collect()] == [["one page", "two page"], []]


def test_entailment_scores_every_literal_anchor(spark):
    from quoin.operators import entailment as I

    source = "One fine day. Two dogs ran. Three cats sat. Four birds sang loud. Five fish swam."
    body = "Four birds are named in prose. Dogs flew away (grep: `Two dogs`). Loud fish sang (grep: `Four birds`). A gap (grep-re: `One.+day`). Nothing (grep: `day. Two`)."
    data = [(1, body, source), (2, "Short (grep: `Only`).", "Only one"), (3, "No anchor.", source), (4, None, None)]
    got = {(r["id"], r["phrase"]): r["support"] for r in I.entailed(spark.createDataFrame(data, "id long, body string, text string"), lambda p, c: float(len(p) * 1000 + len(c))).collect()}
    windows = {"Two dogs": ("One fine day. Two dogs ran. Three cats sat.", "Dogs flew away."), "Four birds": ("Three cats sat. Four birds sang loud. Five fish swam.", "Loud fish sang.")}
    assert got == {(1, k): float(len(p) * 1000 + len(c)) for k, (p, c) in windows.items()} | {(1, "day. Two"): None, (2, "Only"): float(8 * 1000 + 6), (3, None): None, (4, None): None}


def test_entailment_of_documents_reaches_their_ends(spark):
    from quoin.plans import catalog

    rows = catalog.QUERIES["r25_entail_stub"](spark, "/root/testdata/sf0.001").collect()
    ids = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == ids and max(r["ord"] or 0 for r in rows) == 2
    scores = [r["support"] for r in rows if r["support"] is not None]
    assert len(scores) > 1.5 * len(ids) and 0 < sum(x < 1 for x in scores)


def test_every_line_is_a_page(spark, tmp_path):
    from quoin.plans import catalog

    spark.createDataFrame([(1, "one two\nthree four\nfive six\nseven eights\n\nnine ten"), (2, "only one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc"], r["page"]): r["recall"] for r in catalog.QUERIES["a8_page_recall"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.5, (1, 3): 0.5, (1, 4): 0.5, (1, 5): None, (1, 6): 0.5, (2, 1): 0.5}


def test_stream_with_another_checkpoint_keeps_what_is_there(spark, tmp_path):
    schema = "doc_id long, text string"
    at = tmp_path
    for run, rows in (("one", [(1, "first"), (2, "second"), (3, "")]), ("two", [(4, "first"), (5, "third")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/drop-{run}")
        stream = ingest.arrivals(spark, f"{at}/drop-{run}", spark.createDataFrame([], schema).schema)
        ingest.ingest(stream, f"{at}/to", f"{at}/log", f"{at}/checkpoint-{run}", f"{at}/refused").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{at}/to").collect()) == ["first", "second", "third"]
    log = spark.read.schema(ingest.LOG).parquet(f"{at}/log")
    assert log.where("state = 'accepted'").count() == 3 and [r["reason"] for r in log.where("state = 'refused'").collect()] == ["no words"] and spark.read.parquet(f"{at}/refused").count() == 1


def test_absent_shelves_and_strict_reads(spark, kb):
    lib = library.manifest('id = "kb"\nshelves = ["books", "gone"]\n', kb.root)
    assert {r["shelf"] for r in library.sources(spark, lib).collect()} == {"books"}
    assert library.sources(spark, library.manifest('id = "kb"\nshelves = []\n', kb.root)).count() == 0
    with pytest.raises(Exception):
        library.sources(spark, kb, strict=True).select("text").collect()
    assert library.clashes(spark.createDataFrame([("a",), ("a",), ("b",)], "id string")).first()["id"] == "a"
    for name in ("../x", "a/b", "1a", ""):
        with pytest.raises(library.ConfigError):
            library.rubric_path(kb, name)


def test_catalog_keeps_the_last_good(spark, kb, tmp_path):
    import os

    at = tmp_path / "registry.toml"
    (tmp_path / "base").mkdir()
    (tmp_path / "base/library.toml").write_text('id = "one"\nshelves = ["x"]\n')
    at.write_text('[[kb]]\nname = "a"\npath = "base"\n[[kb]]\nname = "b"\npath = "gone"\n')
    c = library.Catalog(spark, str(at))
    assert [(r["name"], r["ok"]) for r in c.rows] == [("a", True), ("b", False)] and c.problem is None
    at.write_text("[[kb]\nhalf written")
    os.utime(at, (2_000_000_000, 2_000_000_000))
    assert [(r["name"], r["ok"]) for r in c.refresh()] == [("a", True), ("b", False)] and c.problem


def test_settings_precedence():
    from quoin.sources import settings

    got = settings.resolve({"judge.hurdle": 70}, settings.load("[judge]\nhurdle = 50\npermutations = 4\n"), {"QUOIN_JUDGE_PERMUTATIONS": "6", "QUOIN_INGEST_VERIFY": "no"})
    assert [(got[k].value, got[k].source) for k in ("judge.hurdle", "judge.permutations", "ingest.verify", "ingest.tier", "judge.model")] == [(70, "argument"), (6, "environment"), (False, "environment"), ("auto", "default"), (None, "unset")]
    for bad in (lambda: settings.load("[judge]\nhurdel = 1"), lambda: settings.resolve({"judge.hurdle": True}), lambda: settings.resolve({"judge.hurdle": 101}), lambda: settings.resolve({"judge.permutations": 3}), lambda: settings.resolve({"ingest.docling_url": "ftp://x"}), lambda: settings.resolve({}, {}, {"QUOIN_JUDGE_HURDLE": "59.6"})):
        with pytest.raises(ValueError):
            bad()


def test_calibration_covers_only_what_was_measured():
    from quoin.operators.judge import PROMPT_VERSION, Calibration

    c = Calibration("r", 20, 0.6, model="m", orders=2, prompt_version=PROMPT_VERSION)
    assert c.covers("r", "m", 2) and not any((c.covers("x", "m", 2), c.covers("r", "n", 2), c.covers("r", "m", 4), c.covers("r", None, 2), c.covers("r", "m", None)))
    assert not Calibration("r", 20, 0.6).covers("r", None, None) and not Calibration("r", 19, 0.9, model="m", orders=2, prompt_version=PROMPT_VERSION).covers("r", "m", 2)
    assert not Calibration("r", 20, 0.59, model="m", orders=2, prompt_version=PROMPT_VERSION).covers("r", "m", 2) and not Calibration("r", 20, 0.6, model="m", orders=True, prompt_version=PROMPT_VERSION).covers("r", "m", 1)


def test_judges(spark):
    from quoin.operators import judge

    drafts = spark.createDataFrame([("x", "d")], "draft string, dimension string")
    scale = spark.createDataFrame([("d", "a", 5), ("d", "b", 25), ("d", "c", 10)], "dimension string, criterion string, top int")
    known = spark.createDataFrame([("c", 1)], "criterion string, score int")
    assert {r["criterion"]: r["score"] for r in judge.fixture_scores(drafts, scale, known, 0.9).collect()} == {"a": 5, "b": 23, "c": 1}
    assert {r["criterion"]: r["score"] for r in judge.fixture_scores(drafts, scale, None, 0.58).collect()} == {"a": 3, "b": 15, "c": 6}
    rows = spark.createDataFrame([("x", "a", "text", "asked", 5)], "draft string, criterion string, text string, asked string, top int")
    assert tuple(judge.judged(rows, lambda t, a, back: 4 if back else 3).first()) == ("x", "a", 4, 1)
    with pytest.raises(ValueError):
        judge.judged(rows, lambda t, a, back: 3, 3)
    with pytest.raises(Exception):
        judge.judged(rows, lambda t, a, back: 6).collect()


def test_rubrics_are_derived_checked_and_approved(spark, kb, capsys):
    from pathlib import Path

    from quoin.__main__ import main

    root = Path(kb.root)
    (root / "library.toml").write_text('id = "kb"\nshelves = ["books"]\nframeworks = "fw"\nsyntheses = "lenses"\n')
    (root / "fw").mkdir()
    (root / "lenses/pacing.md").write_text("---\ncards: [brevity (cross-ref), latin]\n---\n# Pacing\n\n## Craft\nIntro\n- **Cut early.** [advisory] Leave out words (grep: `needless words`).\n- **Keep it short** (grep: `sentence should`; `unnecessary words`)\n")
    (root / "cards/latin.md").write_text("---\nid: latin\nfile: books/latin.txt\n---\n# Latin\n")
    assert main(["--root", kb.root, "rubric-derive", "pacing"]) == 0 and main(["--root", kb.root, "rubric-derive", "pacing"]) == 1
    at = root / "fw/_criteria/pacing.json"
    doc = json.loads(at.read_text())
    assert [c["id"] for c in doc["criteria"]] == ["pacing.cut-early", "pacing.keep-it-short"] and doc["panel"] == ["brevity", "latin"] and len(doc["criteria"][0]["levels"]) == 6
    assert [e["card"] for e in doc["criteria"][1]["evidence"]] == ["brevity", "brevity"] and doc["criteria"][0]["guidance"]["value"] == "Leave out words"
    assert main(["--root", kb.root, "rubric-check", "pacing"]) == 1  # warrants and levels are a person's to write
    card = root / "cards/brevity.md"
    for name in ("brevity", "latin"):
        sha = hashlib.sha256((root / f"books/{name}.txt").read_bytes().decode("utf-8", "replace").encode()).hexdigest()
        card = root / f"cards/{name}.md"
        card.write_text(card.read_text().replace(f"id: {name}\n", f"id: {name}\nsource_sha256: {sha}\n"))
    for c in doc["criteria"]:
        c["statement"]["warrant"] = "it says so"
        c["guidance"] = {"value": "g", "kind": "derived", "warrant": "w"}
        for x in c["levels"]:
            x["descriptor"] = {"value": f"level {x['score']}", "kind": "operator_policy", "warrant": "w"}
    at.write_text(json.dumps(doc))
    capsys.readouterr()
    assert main(["--root", kb.root, "rubric-check", "pacing"]) == 0 and "not approved" in capsys.readouterr().out
    assert main(["--root", kb.root, "rubric-approve", "pacing"]) == 0 and gate.approved(json.loads(at.read_text()))
    scores = root / "scores.jsonl"
    sound = json.loads(at.read_text())
    calibration = {"rubric": gate.rubric_identity(sound), "drafts": 30, "agreement": 0.9, "model": "m", "orders": 2, "prompt_version": "1"}
    lines = [{"draft": d, "criterion": c["id"], "score": n} for d, n in (("x", 5), ("y", 0)) for c in sound["criteria"]]
    scores.write_text("\n".join(map(json.dumps, [*lines, {"calibration": calibration, "model": "m", "orders": 2}])))
    capsys.readouterr()
    assert main(["--root", kb.root, "review", "pacing", "scores.jsonl"]) == 1
    told = {r["draft"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert told["x"]["outcome"] == "go" and told["x"]["calibrated"] and told["y"]["outcome"] == "recycle"
    assert main(["--root", kb.root, "rubric-repin", "pacing"]) == 0 and json.loads(at.read_text())["admission"] == "candidate"
    assert main(["--root", kb.root, "review", "pacing", "scores.jsonl"]) == 2 and "not-approved" in capsys.readouterr().out
    assert main(["--root", kb.root, "rubric-approve", "pacing"]) == 0
    changed = json.loads(at.read_text())
    changed["criteria"][0]["levels"][0]["descriptor"]["value"] = "other"
    assert not gate.approved(changed) and gate.rubric_identity(changed) != gate.rubric_identity(json.loads(at.read_text()))
    problems = gate.rubric_problems(changed | {"panel": [], "criteria": [changed["criteria"][0] | {"evidence": [{"card": "a", "phrase": "p", "nth": True, "regex": 0}]}]})
    assert problems == ["panel: names of cards, one at least", "criteria[0].evidence[0].nth: bool", "criteria[0].evidence[0].regex: not allowed"]


def test_derivation_refuses_what_it_cannot_cite(spark):
    craft = "- **One** (grep: `alpha`)\n- **One.** (grep: `beta`)\n- **Two** no anchor\n- **Three** (grep: `both`)\n- **Four** (grep: `gone`)"
    moves = gate.craft_moves(spark.createDataFrame([("d", craft), ("e", "prose")], "dimension string, craft string"))
    panel = spark.createDataFrame([("d", 0, "k"), ("d", 1, "l"), ("d", 2, "m")], "dimension string, place int, card string")
    cards = spark.createDataFrame([("k", "alpha both"), ("l", "beta both")], "card string, text string")
    made, problems = gate.derive(moves, panel, cards, "2026-01-01")
    assert made.count() == 0
    assert {(r["dimension"], r["ord"], r["problem"]) for r in problems.collect()} == {("d", 1, "name-repeated"), ("d", 2, "unanchored"), ("d", 3, "evidence-ambiguous-panel"), ("d", 4, "evidence-source-not-installed"), ("d", None, "not-installed-m"), ("e", None, "no-moves")}


def test_rating_sheets_round_trip(spark, tmp_path):
    rubric = _rubric()
    drafts = spark.createDataFrame([("x", "one"), ("y", "two")], "draft string, text string")
    lines = [r["line"] for r in gate.sheet(rubric, drafts, "ann").orderBy("ord").collect()]
    (tmp_path / "sheet.jsonl").write_text("\n".join(lines))
    header, rows = library.rating_sheet(spark, str(tmp_path / "sheet.jsonl"))
    assert header.first()["rows"] == 2 and header.first()["rubric_digest"] == gate.rubric_identity(rubric) and rows.where("score is null").count() == 2
    assert library.sheet_problems(header, rows).count() == 0
    bad = spark.createDataFrame([("x", "aim", 2, 3), ("x", "aim", 1, None), (None, "b", 2, 0)], "draft string, criterion string, max_score int, score int")
    assert {r["problem"] for r in library.sheet_problems(header, bad).collect()} == {"rows", "key", "repeated", "scale", "score"}
    two = spark.createDataFrame([("x", "aim", 2, 1), ("y", "aim", 3, 1), ("z", "aim", 2, 1)], "draft string, criterion string, max_score int, score int")
    one = spark.createDataFrame([("x", "aim", 2, 2), ("y", "aim", 2, 1), ("w", "aim", 2, None)], "draft string, criterion string, max_score int, score int")
    pairs, problems = gate.paired(one, two)
    assert [tuple(r) for r in pairs.collect()] == [("aim", 2, 2, 1)]
    assert {(r["draft"], r["problem"]) for r in problems.collect()} == {("y", "scales differ"), ("z", "only one has it"), ("w", "only one has it")}


def test_gold_for_another_corpus_is_refused(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"q": "what is pacing", "relevant": ["a", "b"]}\n')
    gold = library.gold(spark, str(tmp_path / "gold.jsonl"))
    assert library.gold_for(gold, spark.createDataFrame([("a",)], "id string")).count() == 2
    with pytest.raises(ValueError):
        library.gold_for(gold, spark.createDataFrame([("z",)], "id string"))


def test_the_facade():
    import quoin

    assert all(callable(getattr(quoin, n)) or n in ("__version__", "SERVICES") for n in quoin.__all__)
    assert len(quoin.SERVICES) == 16
    with pytest.raises(ValueError):
        services.scope("zoom", ["a", "b"])
    assert services.scope("search", [f"k{i:02}" for i in range(13)]) == ([f"k{i:02}" for i in range(10)], 3)


def test_consult_folds_a_book_into_its_framework(spark):
    from quoin.operators import retrieval

    lenses = spark.createDataFrame([("source", "king", "On Writing", "craft"), ("framework", "king-fw", "King", None), ("source", "other", "Other", "")], "kind string, name string, title string, aliases string")
    folded = retrieval.folded_lenses(lenses, spark.createDataFrame([("king", "king-fw")], "source string, framework string"))
    assert {(r["kind"], r["name"]) for r in folded.collect()} == {("framework", "king-fw"), ("source", "other")}
    found = retrieval.consult(spark.createDataFrame([(0, "writing craft")], "query_id int, name string"), folded).first()
    assert (found["status"], found["name"]) == ("unique", "king-fw")


def test_bibliography_rows(spark):
    from quoin.operators import bibliography as B

    text = "| **Plato** | `plato-republic.txt` |\nprose xbooth.txt and booth.txt.\nbooth.txt\n| King | `king.x.txt` |\nmention of Strunk only"
    rows = B.lines(spark.createDataFrame([(text,)], "text string"))
    ids = spark.createDataFrame([("plato",), ("plato-republic",), ("booth",), ("xbooth",), ("king",), ("strunk-white",), ("zzz-1999",)], "id string")
    assert {r["id"]: r["line"] for r in B.lookup(ids, rows).collect()} == {"plato": None, "plato-republic": "**Plato** | `plato-republic.txt` |", "booth": "booth.txt", "xbooth": "prose xbooth.txt and booth.txt.", "king": "King | `king.x.txt` |", "strunk-white": None, "zzz-1999": None}
    assert {r["id"] for r in B.uncovered(ids, rows).collect()} == {"zzz-1999"}


def test_normalisation_is_applied_with_backups(spark, tmp_path):
    from quoin.operators import normalize

    root, backups = tmp_path / "base", tmp_path / "backups"
    (root / "books").mkdir(parents=True)
    (root / "books/a.txt").write_text("The defne of it\n")
    sources = spark.createDataFrame([("books/a.txt", "The defne of it\n"), ("books/b.txt", "clean\n")], "rel string, text string")
    words = frozenset({"define"})
    for i in range(3):
        assert normalize.apply(sources, words, str(root), str(backups), f"run{i}", keep=2) == 1
    assert (root / "books/a.txt").read_text() == "The define of it\n" and not (root / "books/b.txt").exists()
    assert (backups / "normalize-backup-run2/books/a.txt").read_text() == "The defne of it\n" and len(list(backups.iterdir())) == 2
    for bad in (lambda: normalize.apply(sources, words, str(root), str(backups), "../x"), lambda: normalize.apply(sources, frozenset(), str(root), str(backups), "y")):
        with pytest.raises(ValueError):
            bad()
