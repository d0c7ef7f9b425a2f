"""Verbs over a knowledge base on disk: python -m quoin --root DIR VERB ... Exit 0: done; 1: failed or nothing found; 2: not measured, or bad arguments."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.anchors import parse_markers
from quoin.operators import bibliography, gate, grounding, judge, linter, normalize, services
from quoin.runtime import durable, ship
from quoin.sources import library, settings

VERBS = {
    "search": ("terms+",), "zoom": ("id", "level"), "cards": (), "lenses": (), "kbs": (), "consult": ("name",), "diagnose": ("symptom",), "verify": ("id", "phrase"), "evidence": ("id", "question"), "check": (), "build": (), "normalize": (), "ingest": ("folder",),
    "settings": (), "init": ("id",), "rubric-derive": ("dimension",), "rubric-check": ("dimension",), "rubric-approve": ("dimension",), "rubric-repin": ("dimension",),
    "review": ("dimension", "scores"),
}
FLAGS = ("json", "strict", "full-text", "write", "allow-unmeasured")
UNGROUNDED = ("none", "insufficient", "not-found", "ambiguous", "source-stale", "source-not-installed", "review-expired", "review-date-invalid", "source-unstamped")


def tables(spark: SparkSession, lib: library.Library, once: bool = False) -> dict[str, DataFrame]:
    """The tables that verbs need, from the library's files. once: sources and cards are read now and written as tables, for verbs that use them many times."""
    sources = library.sources(spark, lib)
    files = library.files(spark, f"{lib.root}/{lib.cards}", "*.md", r"\.md").select("name", "text")
    if once:
        sources, files = durable(sources, "sources"), durable(files, "files")
    cards = library.cards(spark, lib, files)
    cards = cards.withColumn("id", F.coalesce("id", "stem")).withColumn("rel", F.regexp_replace("file", r"^\./", "")).withColumn("stored_sha", F.col("source_sha256")).withColumn("body", F.concat_ws("\n\n", "thin", "full"))
    evidence = cards.join(sources.select("rel", "text"), "rel", "left").select("id", "title", "text", "stored_sha", "review_by", "body")
    out = {
        "cards": cards, "sources": sources, "evidence": evidence, "anchors": cards.select("id", F.explode(parse_markers(F.col("card"))).alias("marker")), "index": linter.index_entries(files.where("name = 'INDEX'").select("text")),
        "existing": files.select(F.col("name").alias("id"), F.col("text").alias("card")), "missed": library.tripwire(cards.select(F.col("stem").alias("name")), library.listed(spark, f"{lib.root}/{lib.cards}", ".md", tuple(library.NOT_CARDS))),
    }
    lenses = cards.select(F.lit("source").alias("kind"), F.col("id").alias("name"), F.coalesce("title", F.lit("")).alias("title"), "aliases")
    for folder, kind, table in ((lib.frameworks, "framework", "frameworks"), (lib.syntheses, "dimension", "syntheses")):
        if folder:
            own = library.lenses(spark, f"{lib.root}/{folder}")
            out[table] = own
            out["missed"] = out["missed"].unionAll(library.tripwire(own.select("name"), library.listed(spark, f"{lib.root}/{folder}").where(library.is_lens(F.col("name")))))
            aliases = F.nullif(F.trim(F.regexp_extract("text", r"(?mi)^\**aliases:?\**:?\s*(.+)$", 1)), F.lit(""))
            lenses = lenses.unionAll(own.select(F.lit(kind), "name", F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), aliases))
    if "frameworks" in out:
        out["framework_sources"] = linter.named_paths(out["frameworks"], pattern(lib)).groupBy("rel").agg(F.max("name").alias("framework")).join(sources.select("rel", F.col("id").alias("source")), "rel")
    if "syntheses" in out:
        out["dimensions"] = out["syntheses"].select("name", F.nullif(F.trim(F.regexp_extract("text", r"(?mi)^\**core question:?\**:?\s*(.+)$", 1)), F.lit("")).alias("core_question"))
        at = f"{lib.root}/{lib.syntheses}/_diagnostics.md"
        if library.exists(spark, at):
            out["diagnostics"] = library.diagnostics(spark.read.text(library.escaped(at), wholetext=True).withColumnRenamed("value", "text"))
    if lib.bibliography and library.exists(spark, f"{lib.root}/{lib.bibliography}"):
        out["bibliography"] = bibliography.lines(spark.read.text(library.escaped(f"{lib.root}/{lib.bibliography}"), wholetext=True).withColumnRenamed("value", "text"))
    return out | {"lenses": lenses}


def pattern(lib: library.Library) -> str:
    return linter.source_path(list(lib.shelves), lib.sources)


def rubric(spark: SparkSession, lib: library.Library, t: dict[str, DataFrame], verb: str, dimension: str, today: str) -> int:
    """Derive a candidate rubric from a dimension's Craft moves, check one, or approve one that is sound."""
    at = library.rubric_path(lib, dimension)
    live = t["evidence"].select(F.col("id").alias("card"), "text", "stored_sha", "review_by")
    if verb == "rubric-derive":
        lens = t["syntheses"].where(F.col("name") == dimension)
        moves = gate.craft_moves(lens.select(F.col("name").alias("dimension"), T.section(F.col("text"), "craft").alias("craft")))
        panel = lens.select(F.col("name").alias("dimension"), F.posexplode(gate.panel_of(T.field(T.front_matter(F.col("text")), "cards"))).alias("place", "card"))
        made, problems = gate.derive(moves, panel, live, today)
        for p in problems.collect():
            print(f"{p['problem']} (move {p['ord']})", file=sys.stderr)
        rows = made.select(F.lit(at.removeprefix(f"{lib.root}/")).alias("path"), F.to_json(F.struct(*made.columns)).alias("text"))
        return 0 if not library.exists(spark, at) and library.write_files(rows, lib.root) else 1
    if not library.exists(spark, at):
        print(f"no rubric at {at}", file=sys.stderr)
        return 1
    text = spark.read.text(library.escaped(at), wholetext=True).first()[0]
    doc = gate.load_rubric(text)
    shas = lambda: {r["card"]: r["sha"] for r in live.where(F.col("card").isin(*doc["panel"])).select("card", F.sha2("text", 256).alias("sha")).collect()}
    save = lambda d: library.write_files(spark.createDataFrame([(at.removeprefix(f"{lib.root}/"), json.dumps(d, ensure_ascii=False, indent=1))], "path string, text string"), lib.root)
    found = gate.rubric_problems(doc)
    if not found and verb == "rubric-repin":  # to the sources as they are: what was approved is a candidate again, for a person to look at
        save(gate.pinned(doc, shas()))
        print("pinned anew, not approved")
        return 0
    if not found:
        rows = gate.read_rubrics(spark.createDataFrame([(text,)], "text string"))
        found = [f"{r['criterion'] or 'rubric'}: {r['rule']}" for r in gate.violations(rows).where("rule != 'approved-digest'" if verb == "rubric-approve" else "true").collect()]
        found += [f"{r['criterion']}: {r['status']} in {r['card']}" for r in gate.ground(gate.bindings(rows), live, today).where("not grounded").collect()]
        found += [f"{r['criterion']}: {r['value']!r} is no quote" for r in gate.explicit_gaps(rows, live, today).collect()]
    for p in found:
        print(p, file=sys.stderr)
    if found:
        return 1
    if verb == "rubric-approve":
        save(gate.pinned(doc, shas(), True))
    else:
        print("approved" if gate.approved(doc) else "sound, not approved")
    return 0


def review(spark: SparkSession, lib: library.Library, t: dict[str, DataFrame], dimension: str, scores: str, today: str) -> int:
    """Verdicts of the drafts of a file of scores (JSON lines: draft, criterion, score, and what calibrates the judge, if anything). Exit 0: all go; 1: some are to be recycled; 2: no verdict for some."""
    at = library.rubric_path(lib, dimension)
    if not library.exists(spark, at):
        print(f"no rubric at {at}", file=sys.stderr)
        return 2
    rubrics = gate.read_rubrics(spark.read.text(library.escaped(at), wholetext=True).withColumnRenamed("value", "text"))
    live = t["evidence"].select(F.col("id").alias("card"), "text", "stored_sha", "review_by")
    rows = spark.read.schema("draft string, criterion string, score int, calibration struct<rubric:string,drafts:int,agreement:double,model:string,orders:int,prompt_version:string>, model string, orders int").json(library.escaped(f"{lib.root}/{scores}"))
    told = rows.where("calibration is not null").limit(1).collect()
    known = None
    if told and not rubrics.where("size(problems) > 0").count():
        own = judge.Calibration(**told[0]["calibration"].asDict())
        identity = gate.rubric_identity(gate.load_rubric(spark.read.text(library.escaped(at), wholetext=True).first()[0]))
        known = spark.createDataFrame([(dimension,)] if own.covers(identity, told[0]["model"], told[0]["orders"]) else [], "dimension string")
    done = gate.review(rubrics, live, None, rows.where("criterion is not null").select("draft", F.lit(dimension).alias("dimension"), "criterion", "score"), today, calibrated=known)
    found = done.orderBy("draft").collect()
    for r in found:
        print(json.dumps({k: v for k, v in r.asDict().items() if v is not None}))
    return 2 if not found or any(r["outcome"] == "unavailable" for r in found) else int(any(r["outcome"] == "recycle" for r in found))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quoin", description=__doc__)
    p.add_argument("--root", default=".")
    for f in FLAGS:
        p.add_argument(f"--{f}", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, names in VERBS.items():
        own = verbs.add_parser(name)
        for n in names:
            own.add_argument(n.rstrip("+"), **({"nargs": "+"} if n.endswith("+") else {}))
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    params = vars(a) | {"today": date.today().isoformat(), "spark": spark}
    toml = f"{a.root}/library.toml"
    if a.verb in ("settings", "init"):
        if a.verb == "init" and library.exists(spark, toml):
            print(f"{toml} is there already", file=sys.stderr)
            return 1
        at = f"{a.root}/settings.toml"
        rows = services.execute(a.verb, {}, params | {"file": settings.load(spark.read.text(library.escaped(at), wholetext=True).first()[0]) if a.verb == "settings" and library.exists(spark, at) else {}})
        if a.verb == "init":
            print(f"{library.write_files(rows, a.root)} files")
        else:
            print("\n".join(f"{r['name']}\t{r['value']}\t{r['source']}" for r in rows.collect()))
        return 0
    if a.verb == "kbs":
        catalog = library.Catalog(spark, f"{a.root}/registry.toml")
        print("\n".join(json.dumps(r) for r in catalog.rows) or str(catalog.problem))
        return 1 if catalog.problem or any(not r["ok"] for r in catalog.rows) else 0
    with open(toml, encoding="utf-8") as f:
        lib = library.manifest(f.read(), a.root)
    t = tables(spark, lib, a.verb == "check")
    if a.verb.startswith("rubric-"):
        return rubric(spark, lib, t, a.verb, a.dimension, params["today"])
    if a.verb == "review":
        return review(spark, lib, t, a.dimension, a.scores, params["today"])
    if a.verb in ("verify", "evidence"):
        t["evidence"] = t["evidence"].where(F.col("id") == a.id)
    if a.verb == "check":
        board = library.exists(spark, f"{a.root}/{lib.cards}/INDEX.md")
        t = t if board else {k: v for k, v in t.items() if k != "index"}
        params |= {"pattern": pattern(lib), "indexed": True, "catalogued": bool(lib.bibliography)}
    if a.verb == "ingest":
        t["files"] = spark.read.format("binaryFile").load(library.escaped(a.folder)).select("path", "content")
    if a.verb == "build":
        params["cards"] = lib.cards
        if t["sources"].isEmpty() and not t["cards"].isEmpty():
            print("no source is installed: cards stay as they are", file=sys.stderr)
            return 2
        if clash := [r["id"] for r in library.clashes(t["sources"]).collect()]:
            print(f"names on several shelves: {clash}", file=sys.stderr)
            return 1
    if a.verb == "normalize" and a.write:
        with open(f"{a.root}/words.txt", encoding="utf-8") as f:
            words = frozenset(f.read().lower().split())
        n = normalize.apply(t["sources"], words, a.root, f"{a.root}/../{lib.id}-backups", datetime.now().strftime("%Y%m%d-%H%M%S"))
        print(f"{n} sources changed")
        return 0
    rows = services.execute(a.verb, t, params)
    if a.verb == "build":
        made = durable(rows, "cards")  # it depends on the files that are written
        n = library.write_files(made, a.root) if a.write else made.count()
        if a.write:
            ids = made.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id")).orderBy("id")
            lines = ids.agg(F.concat(F.lit("# Board\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("- ["), i, F.lit("]("), i, F.lit(".md)"))), "\n"), F.lit("\n")).alias("text"))
            library.write_files(lines.select(F.lit(f"{lib.cards}/INDEX.md").alias("path"), "text"), a.root)
        print(f"{n} cards" + ("" if a.write else ", not written"))
        return 0
    if a.verb == "check":
        found = [x.asDict() for x in rows.collect()]
        r = grounding.report(spark.createDataFrame([(x["severity"],) for x in found], "severity string")).first()
        print(json.dumps({**r.asDict(), "findings": found}) if a.json else "\n".join(f"{x['severity']} [{x['code']}] {x['subject']}{': ' + x['detail'] if x['detail'] else ''}" for x in found) or "no findings")
        return 1 if r["errors"] else 2 if r["unmeasured"] and not a.allow_unmeasured else 0
    found = [x.asDict(recursive=True) for x in rows.collect()]
    for x in found:
        print(json.dumps(x, default=str) if a.json else "\t".join(str(v) for v in x.values()))
    if a.verb == "normalize":
        return 0
    good = [x for x in found if x.get("status", "found") not in UNGROUNDED and not x.get("refused")]
    return 0 if good else 2 if any(x.get("status") == "source-not-installed" for x in found) else 1


if __name__ == "__main__":
    sys.exit(main())
