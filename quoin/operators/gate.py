"""Rubrics: their rules as violations, the fingerprint of their panel, exact verdicts."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The schema of a rubric.
EVIDENCE = "struct<card:string,phrase:string,before:string,after:string,nth:int>"
FIELD = f"struct<value:string,kind:string,warrant:string,evidence:array<{EVIDENCE}>>"
RUBRIC = f"schema string, dimension string, panel array<string>, admission string, approved_digest string, derived_from string, note string, fingerprint struct<sources:map<string,string>>, criteria array<struct<id:string,criticality:string,statement:{FIELD},guidance:{FIELD},fields:map<string,{FIELD}>,levels:array<struct<score:int,descriptor:{FIELD}>>,evidence:array<{EVIDENCE}>>>"
KINDS = ("explicit", "paraphrase", "derived", "operator_policy", "unknown")
# Names of the schema, of rubrics (they are file names), of criteria, of slots that are no names, and digests.
SCHEMA = "criterion-spec/v1"
SCHEMAS, DIMENSION, NAME, SLOT, SHA = r"^(?:[a-z]+\.)?criterion-spec/v1$", r"^[A-Za-z][A-Za-z0-9_-]*$", r"^[A-Za-z][A-Za-z0-9._-]*$", r"^[A-Za-z]\d+[A-Za-z]?$", r"^[0-9a-f]{64}$"
APPROVAL = ("admission", "approved_digest")


def load_rubric(text: str, most: int = 4 << 20) -> dict:
    """A rubric's JSON; duplicate keys, constants that aren't JSON, and files over the size are refused."""
    if len(text.encode()) > most:
        raise ValueError("rubric is too large")

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError(f"duplicate key in {sorted(keys)}")
        return dict(pairs)

    def refuse(x):
        raise ValueError(f"{x} is no JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def _canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rubric_digest(rubric: dict) -> str:
    """SHA-256 of the canonical JSON without what approval writes: what was approved."""
    return _canonical({k: v for k, v in rubric.items() if k not in APPROVAL})


def rubric_identity(rubric: dict) -> str:
    """SHA-256 of what a rater is asked to apply: words, scales and evidence, without notes, pins or approval. An agreement that was measured belongs to one identity."""
    anchor = lambda e: {k: e.get(k) for k in ("card", "phrase", "before", "after", "nth")}

    def told(f: dict | None) -> dict:
        f = f or {}
        return {"value": f.get("value"), "kind": f.get("kind"), "warrant": f.get("warrant") or "", "evidence": [anchor(e) for e in f.get("evidence") or ()]}

    each = [
        {
            "id": c["id"], "max_score": len(c["levels"]) - 1, "statement": told(c.get("statement")), "guidance": told(c.get("guidance")), "fields": {k: told(v) for k, v in (c.get("fields") or {}).items()},
            "levels": [{"score": x["score"], "descriptor": told(x["descriptor"])} for x in c["levels"]], "evidence": [anchor(e) for e in c.get("evidence") or ()],
        }
        for c in rubric["criteria"]
    ]
    return _canonical({"dimension": rubric["dimension"], "panel": list(rubric["panel"]), "criteria": each})


def approved(rubric: dict) -> bool:
    """Whether a person approved this very content."""
    return rubric.get("admission") == "human_approved" and rubric.get("approved_digest") == rubric_digest(rubric)


def rubric_problems(rubric: object) -> list[str]:
    """Where the types of a rubric's JSON are wrong, as paths; true and false are no numbers. Rules on what the values say are in violations()."""
    found: list[str] = []

    def want(value: object, kind: type | tuple, at: str, may_lack: bool = False) -> bool:
        ok = may_lack and value is None or isinstance(value, kind) and not (isinstance(value, bool) and bool not in (kind if isinstance(kind, tuple) else (kind,)))
        if not ok:
            found.append(f"{at}: {type(value).__name__}")
        return ok and value is not None

    def anchors(value: object, at: str) -> None:
        if want(value, list, at, True):
            for i, e in enumerate(value):
                if want(e, dict, f"{at}[{i}]"):
                    want(e.get("card"), str, f"{at}[{i}].card")
                    want(e.get("phrase"), str, f"{at}[{i}].phrase")
                    for k, kind in (("before", str), ("after", str), ("nth", int)):
                        want(e.get(k), kind, f"{at}[{i}].{k}", True)
                    if "regex" in e:
                        found.append(f"{at}[{i}].regex: not allowed")

    def envelope(value: object, at: str, may_lack: bool = False) -> None:
        if want(value, dict, at, may_lack):
            want(value.get("value"), str, f"{at}.value", True)
            want(value.get("kind"), str, f"{at}.kind")
            want(value.get("warrant"), str, f"{at}.warrant", True)
            anchors(value.get("evidence"), f"{at}.evidence")

    if want(rubric, dict, "rubric"):
        want(rubric.get("dimension"), str, "dimension")
        if want(rubric.get("panel"), list, "panel") and (not rubric["panel"] or not all(isinstance(c, str) and c for c in rubric["panel"])):
            found.append("panel: names of cards, one at least")
        if want(rubric.get("criteria"), list, "criteria"):
            for i, c in enumerate(rubric["criteria"]):
                at = f"criteria[{i}]"
                if not want(c, dict, at):
                    continue
                want(c.get("id"), str, f"{at}.id")
                want(c.get("criticality"), str, f"{at}.criticality", True)
                envelope(c.get("statement"), f"{at}.statement")
                envelope(c.get("guidance"), f"{at}.guidance", True)
                anchors(c.get("evidence"), f"{at}.evidence")
                if want(c.get("fields"), dict, f"{at}.fields", True):
                    for k, v in c["fields"].items():
                        envelope(v, f"{at}.fields.{k}")
                if want(c.get("levels"), list, f"{at}.levels"):
                    for j, x in enumerate(c["levels"]):
                        if want(x, dict, f"{at}.levels[{j}]"):
                            want(x.get("score"), int, f"{at}.levels[{j}].score")
                            envelope(x.get("descriptor"), f"{at}.levels[{j}].descriptor")
    return found


def _kind(v: Column) -> Column:
    """The kind of a JSON value: STRING, BIGINT, BOOLEAN, OBJECT, ARRAY, VOID ...; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def body_digest(v: Column) -> Column:
    """rubric_digest as a column, of a rubric's JSON as a variant: keys are sorted and values compact there. It is the same for all JSON whose numbers are whole, as a rubric's are."""
    own = F.try_variant_get(v, "$", "map<string,variant>")
    names = F.array_sort(F.filter(F.map_keys(own), lambda k: ~k.isin(*APPROVAL)))
    said = F.transform(names, lambda k: F.concat(F.substr(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(own[k])))
    text = F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))
    for x in "ABCDEF":  # of control characters; backslashes before them are pairs
        text = F.regexp_replace(text, rf"((?<!\\)(?:\\\\)*\\u00[01]){x}", rf"$1{x.lower()}")
    return F.sha2(text, 256)


def type_problems(v: Column) -> Column:
    """rubric_problems as a column, of a rubric's JSON as a variant (null: no JSON, or a key twice): where types are wrong, as paths, with the kind that stands there. true and false are no numbers."""
    none = F.array().cast("array<string>")

    def want(x: Column, kinds: tuple[str, ...], at: Column, may_lack: bool = False) -> Column:
        k = _kind(x)
        ok = F.coalesce(k.isin(*kinds), F.lit(False)) | (F.coalesce(k == "VOID", F.lit(True)) if may_lack else F.lit(False))
        return F.when(ok, none).otherwise(F.array(F.concat(at, F.lit(": "), F.coalesce(F.lower(k), F.lit("missing")))))

    def each(x: Column, at: Column, told) -> Column:
        """What is told of every element of a list."""
        items = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.flatten(F.transform(items, lambda e, i: told(e, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))

    sub = lambda at, key: F.concat(at, F.lit(f".{key}"))
    text, whole, thing, many = ("STRING",), ("BIGINT",), ("OBJECT",), ("ARRAY",)

    def anchor(e: Column, at: Column) -> Column:
        refused = F.when(_kind(_part(e, "regex")).isNotNull(), F.array(F.concat(at, F.lit(".regex: not allowed")))).otherwise(none)
        fields = [want(_part(e, "card"), text, sub(at, "card")), want(_part(e, "phrase"), text, sub(at, "phrase")), *(want(_part(e, k), kind, sub(at, k), True) for k, kind in (("before", text), ("after", text), ("nth", whole)))]
        return F.when(_kind(e) == "OBJECT", F.concat(*fields, refused)).otherwise(want(e, thing, at))

    def anchors(x: Column, at: Column) -> Column:
        return F.concat(want(x, many, at, True), each(x, at, anchor))

    def envelope(x: Column, at: Column, may_lack: bool = False) -> Column:
        fields = [want(_part(x, "value"), text, sub(at, "value"), True), want(_part(x, "kind"), text, sub(at, "kind")), want(_part(x, "warrant"), text, sub(at, "warrant"), True), anchors(_part(x, "evidence"), sub(at, "evidence"))]
        return F.when(_kind(x) == "OBJECT", F.concat(*fields)).otherwise(want(x, thing, at, may_lack))

    def criterion(c: Column, at: Column) -> Column:
        levels = lambda e, i: F.when(_kind(e) == "OBJECT", F.concat(want(_part(e, "score"), whole, sub(i, "score")), envelope(_part(e, "descriptor"), sub(i, "descriptor")))).otherwise(want(e, thing, i))
        further = F.coalesce(F.try_variant_get(_part(c, "fields"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        more = F.flatten(F.transform(F.array_sort(F.map_keys(further)), lambda k: envelope(further[k], F.concat(at, F.lit(".fields."), k))))
        parts = [
            want(_part(c, "id"), text, sub(at, "id")), want(_part(c, "criticality"), text, sub(at, "criticality"), True), envelope(_part(c, "statement"), sub(at, "statement")), envelope(_part(c, "guidance"), sub(at, "guidance"), True),
            anchors(_part(c, "evidence"), sub(at, "evidence")), want(_part(c, "fields"), thing, sub(at, "fields"), True), more, want(_part(c, "levels"), many, sub(at, "levels")), each(_part(c, "levels"), sub(at, "levels"), levels),
        ]
        return F.when(_kind(c) == "OBJECT", F.concat(*parts)).otherwise(want(c, thing, at))

    panel = F.coalesce(F.try_variant_get(_part(v, "panel"), "$", "array<variant>"), F.array().cast("array<variant>"))
    named = F.when((_kind(_part(v, "panel")) == "ARRAY") & ((F.size(panel) == 0) | F.exists(panel, lambda c: (_kind(c) != "STRING") | (F.try_variant_get(c, "$", "string") == ""))), F.array(F.lit("panel: names of cards, one at least"))).otherwise(none)
    all_ = F.concat(want(_part(v, "dimension"), text, F.lit("dimension")), want(_part(v, "panel"), many, F.lit("panel")), named, want(_part(v, "criteria"), many, F.lit("criteria")), each(_part(v, "criteria"), F.lit("criteria"), criterion))
    return F.when(v.isNull(), F.array(F.lit("rubric: no JSON, or a key is repeated"))).when(_kind(v) == "OBJECT", all_).otherwise(F.array(F.concat(F.lit("rubric: "), F.lower(_kind(v)))))


def read_rubrics(rows: DataFrame, text: str = "text", most: int = 4 << 20) -> DataFrame:
    """A table of rubrics' JSON texts as the rubrics' fields, body_digest and problems (paths whose types are wrong; such rubrics must not be used), after the columns of rows but for the text.

    A text over the size is no rubric; nor is one in which a key is repeated, or with constants that aren't JSON.
    """
    v = F.when(F.octet_length(text) <= most, F.try_parse_json(text))
    read = rows.withColumn("json ", v).withColumn("rubric ", F.from_json(text, RUBRIC))
    kept = [f"`{c}`" for c in rows.columns if c != text]
    return read.select(*kept, "`rubric `.*", body_digest(F.col("json ")).alias("body_digest"), type_problems(F.col("json ")).alias("problems"))


def criterion_key(c: Column) -> Column:
    """The digest of what a criterion says (id, statement, guidance, levels): what was derived for one wording isn't used for another under the same id."""
    levels = F.array_join(F.transform(c["levels"], lambda x: F.concat(x["score"].cast("string"), F.lit("="), F.coalesce(x["descriptor"]["value"], F.lit("")))), "|")
    nul = F.lit("\0")
    return F.sha2(F.concat(c["id"], nul, F.coalesce(c["statement"]["value"], F.lit("")), nul, F.coalesce(c["guidance"]["value"], F.lit("")), nul, levels), 256)


def criteria(rubrics: DataFrame) -> DataFrame:
    """A row for each criterion of rubrics (dimension, panel, criteria), with its place."""
    return rubrics.select("dimension", "panel", F.posexplode("criteria").alias("ord", "c"))


def _fields(c: Column) -> Column:
    """The envelopes of a criterion: its levels' descriptors, its statement and guidance, and its further fields."""
    further = F.coalesce(F.map_values(c["fields"]), F.filter(F.array(c["statement"]), lambda _: F.lit(False)))
    return F.filter(F.concat(F.transform(c["levels"], lambda x: x["descriptor"]), F.array(c["statement"], c["guidance"]), further), lambda f: f.isNotNull())


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"[\p{Cf}\p{Cc}\p{Zs}\p{Zl}\p{Zp}]", "")) == "", F.lit(True))


def violations(rubrics: DataFrame) -> DataFrame:
    """(dimension, criterion, rule) of each broken rule; none means that the structure holds. Rules on a rubric as a whole have no criterion.

    rubrics as read_rubrics makes them: without the column body_digest no approval holds, as nobody can tell what was approved.
    """
    rows = criteria(rubrics)
    own = lambda name: F.col(name) if name in rubrics.columns else F.lit(None)
    c, at = "c", lambda rule, when: (rule, when)
    levels = F.col("c.levels")
    fields = _fields(F.col("c"))
    some = lambda f: F.coalesce(F.size(f["evidence"]) > 0, F.lit(False))
    bad = lambda f: (
        ~f["kind"].isin(*KINDS)
        | ((f["kind"] == "explicit") & (~some(f) | ~_blank(f["warrant"])))
        | ((f["kind"] == "paraphrase") & (~some(f) | _blank(f["warrant"])))
        | (f["kind"].isin("derived", "operator_policy") & _blank(f["warrant"]))
        | ((f["kind"] == "unknown") & (f["value"].isNotNull() | some(f) | ~_blank(f["warrant"])))
        | ((f["kind"] != "unknown") & _blank(f["value"]))
    )
    cited = F.flatten(F.array_append(F.transform(fields, lambda f: F.coalesce(f["evidence"], F.array().cast(f"array<{EVIDENCE}>"))), F.coalesce(F.col("c.evidence"), F.array().cast(f"array<{EVIDENCE}>"))))
    rules = [
        at("id", ~F.coalesce(F.col("c.id").rlike(NAME), F.lit(False)) | _blank(F.col("c.id"))),
        at("id-positional", F.col("c.id").rlike(SLOT)),
        at("statement-unknown", F.coalesce(F.col("c.statement.kind") == "unknown", F.lit(True))),
        at("evidence", F.coalesce(F.size("c.evidence") < 1, F.lit(True))),
        at("field-name", F.exists(F.map_keys("c.fields"), _blank)),
        at("level-unknown", F.exists(levels, lambda x: x["descriptor"]["kind"] == "unknown")),
        at("criticality", F.col("c.criticality") != "required"),
        at("levels", levels.isNull() | (F.size(levels) < 2) | F.exists(F.transform(levels, lambda x, i: x["score"] != i), lambda b: b)),
        at("envelope", F.exists(fields, bad)),
        at("panel", F.size(F.array_except(F.transform(cited, lambda e: e["card"]), F.col("panel"))) > 0),
        at("nth", F.exists(cited, lambda e: e["nth"] < 1)),
        at("phrase", F.exists(cited, lambda e: _blank(e["phrase"]))),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(r)) for r, w in rules]), lambda r: r.isNotNull())
    each = rows.select("dimension", F.col("c.id").alias("criterion"), F.explode(broken).alias("rule"))
    twice = rows.groupBy("dimension", F.col("c.id").alias("criterion")).agg(F.count("*").alias("n")).where("n > 1").select("dimension", "criterion", F.lit("id-repeated").alias("rule"))
    panel, pins = own("panel").cast("array<string>"), own("fingerprint")["sources"] if "fingerprint" in rubrics.columns else F.lit(None).cast("map<string,string>")
    no = lambda c: F.coalesce(c, F.lit(True))
    whole = [
        at("schema", no(~own("schema").cast("string").rlike(SCHEMAS))),
        at("dimension", no(~F.col("dimension").cast("string").rlike(DIMENSION))),
        at("panel-empty", no(F.size(panel) < 1)),
        at("panel-repeated", F.size(F.array_distinct(panel)) < F.size(panel)),
        at("criteria-empty", no(F.size("criteria") < 1)),
        at("pin", F.exists(F.map_values(pins), lambda x: no(~x.rlike(SHA)))),
        at("admission", ~own("admission").cast("string").isin("candidate", "human_approved")),
        at("approved-digest", (own("admission") == "human_approved") & no(own("approved_digest").cast("string") != own("body_digest").cast("string"))),
        at("types", F.size(own("problems").cast("array<string>")) > 0),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(r)) for r, w in whole]), lambda r: r.isNotNull())
    return each.unionByName(twice).unionByName(rubrics.select("dimension", F.lit(None).cast("string").alias("criterion"), F.explode(broken).alias("rule")))


def pins(rubrics: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(dimension, card, pinned) of every card of every panel, pinned being null where nothing pins it. pinned (dimension, card, pinned), or else the rubrics' own fingerprints."""
    if pinned is None:
        return rubrics.select("dimension", F.explode("panel").alias("card"), F.col("fingerprint.sources").alias("s")).select("dimension", "card", F.col("s")[F.col("card")].alias("pinned"))
    return rubrics.select("dimension", F.explode("panel").alias("card")).join(pinned.select("dimension", "card", "pinned"), ["dimension", "card"], "left")


def fingerprint(panel: DataFrame, live: DataFrame) -> DataFrame:
    """panel (dimension, card, pinned) against live (card, sha): what isn't installed, isn't pinned or has drifted, in that order of precedence."""
    joined = panel.join(live, "card", "left")
    problem = F.when(F.col("sha").isNull(), "missing").when(F.col("pinned").isNull(), "unpinned").when(F.col("pinned") != F.col("sha"), "drifted")
    return joined.select("dimension", "card", problem.alias("problem")).where("problem is not null")


def score_problems(scale: DataFrame, scores: DataFrame) -> DataFrame:
    """scale (dimension, criterion, top) against scores (draft, dimension, criterion, score): missing, unknown, repeated and out of range, for each draft."""
    drafts = scores.select("draft", "dimension").distinct()
    want = drafts.join(scale, "dimension")
    counted = scores.groupBy("draft", "dimension", "criterion").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    both = want.join(counted, ["draft", "dimension", "criterion"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("top").isNull(), "unknown").when(F.col("n") > 1, "repeated").when((F.col("low") < 0) | (F.col("high") > F.col("top")) | F.col("low").isNull(), "range")
    return both.select("draft", "dimension", "criterion", problem.alias("problem")).where("problem is not null")


def verdicts(scale: DataFrame, scores: DataFrame, hurdle: int = 60) -> DataFrame:
    """(draft, dimension, criteria, points, go, defects): the mean of score/top against the hurdle in whole numbers; a draft with any problem has none.

    Scales are control data: the least common multiple L of their tops is a literal, and sum(score * L / top) * 100 >= hurdle * n * L decides.
    """
    if isinstance(hurdle, bool) or not isinstance(hurdle, int) or not 0 <= hurdle <= 100:
        raise ValueError(f"hurdle must be a whole number from 0 to 100, not {hurdle!r}")
    tops = [r[0] for r in scale.select("top").distinct().collect()]
    whole = math.lcm(*tops) if tops else 1
    sound = scores.join(score_problems(scale, scores).select("draft", "dimension").distinct(), ["draft", "dimension"], "left_anti")
    part = F.expr(f"score * ({whole} DIV top)").cast("long")
    weak = F.col("score") * 100 < F.col("top") * hurdle
    rows = sound.join(scale, ["dimension", "criterion"])
    summed = rows.groupBy("draft", "dimension").agg(F.count("*").alias("criteria"), F.sum(part).alias("sum"), F.array_sort(F.collect_list(F.when(weak, F.struct((F.col("score") * (whole / F.col("top"))).alias("r"), "criterion")))).alias("weak"))
    go = F.col("sum") * 100 >= F.col("criteria") * hurdle * whole
    return summed.select("draft", "dimension", "criteria", F.expr(f"sum * 100 DIV (criteria * {whole})").alias("points"), go.alias("go"), F.transform("weak", lambda x: x["criterion"]).alias("defects"))


def bindings(rubrics: DataFrame) -> DataFrame:
    """(dimension, criterion, ord, card, marker) of every piece of evidence of every criterion, levels' and fields' included, in order. A criterion that cites nothing itself is one row without ord."""
    c = F.col("c")
    none = F.array().cast(f"array<{EVIDENCE}>")
    all_ = F.concat(F.coalesce(c["evidence"], none), F.flatten(F.transform(_fields(c), lambda f: F.coalesce(f["evidence"], none))))
    rows = criteria(rubrics).select("dimension", c["id"].alias("criterion"), F.posexplode_outer(F.when(F.size(F.coalesce(c["evidence"], none)) > 0, all_)).alias("ord", "e"))
    mark = F.struct(F.col("e.phrase").alias("phrase"), F.lit(False).alias("regex"), F.col("e.before").alias("before"), F.col("e.after").alias("after"), F.col("e.nth").alias("nth"))
    return rows.select("dimension", "criterion", "ord", F.col("e.card").alias("card"), mark.alias("marker"))


def ground(bound: DataFrame, cards: DataFrame, today: str, require_stamp: bool = True, patterns: bool = True) -> DataFrame:
    """Each binding against the one card that it declares: status, and grounded (found or folded-only). cards (card, text, stored_sha, review_by). patterns=False where no marker is one."""
    from quoin.operators.grounding import by_source, evidence_status

    asked = bound.where("ord is not null").select("dimension", "criterion", "ord", "card", "marker")
    done = evidence_status(by_source(asked, cards), today, require_stamp, patterns)
    told = done.select("dimension", "criterion", "ord", "card", "status", F.col("status").isin("found", "folded-only").alias("grounded"))
    return told.unionByName(bound.where("ord is null").select("dimension", "criterion", "ord", "card", F.lit("not-grounded").alias("status"), F.lit(False).alias("grounded")))


def first_failures(grounded: DataFrame) -> DataFrame:
    """(dimension, criterion, status): found, or the first failure in the order of bindings; of a criterion without bindings (where told) not-grounded."""
    bad = F.min_by("status", F.when(~F.col("grounded"), F.col("ord")))
    return grounded.groupBy("dimension", "criterion").agg(F.coalesce(bad, F.when(F.count("ord") == 0, "not-grounded"), F.lit("found")).alias("status"))


def explicit_gaps(rubrics: DataFrame, cards: DataFrame, today: str = "0001-01-01", require_stamp: bool = False) -> DataFrame:
    """Explicit values that no card which they cite holds as they are: (dimension, criterion, value). The value itself has to be found on a line of a fresh source; folds don't count."""
    from quoin.operators.grounding import by_source, evidence_status, marker

    rows = criteria(rubrics).select("dimension", F.col("c.id").alias("criterion"), F.explode(F.filter(_fields(F.col("c")), lambda f: f["kind"] == "explicit")).alias("f"))
    cited = rows.select("dimension", "criterion", F.col("f.value").alias("value"), F.explode_outer(F.array_distinct(F.transform("f.evidence", lambda e: e["card"]))).alias("card"))
    held = evidence_status(by_source(cited.withColumn("marker", marker(F.col("value"))), _stamped(cards)), today, require_stamp, patterns=False)
    found = held.groupBy("dimension", "criterion", "value").agg(F.max(F.col("status") == "found").alias("held"))
    return found.where("not held").drop("held")


def _stamped(cards: DataFrame) -> DataFrame:
    """cards (card, text) with stored_sha and review_by, null where they lack them."""
    none = F.lit(None).cast("string")
    return cards.select("card", "text", *[(F.col(c) if c in cards.columns else none).alias(c) for c in ("stored_sha", "review_by")])


def review(rubrics: DataFrame, cards: DataFrame, pinned: DataFrame | None, scores: DataFrame, today: str, hurdle: int = 60, require_stamp: bool = True, calibrated: DataFrame | None = None) -> DataFrame:
    """(draft, dimension, outcome, reason, points, defects, calibrated): go or recycle, or unavailable with its first reason.

    The gates in order: a person approved this very content; its rules hold; every card of its panel is installed, pinned and as pinned; every binding grounds; explicit quotes stand in their cards; the
    scores are complete and in range. Whatever can't be told keeps the gate shut. rubrics as read_rubrics makes them; pinned as for pins(). calibrated (dimension): the rubrics on which the judge was measured
    against people and agreed; of others, and without the table, the verdict says false.
    """
    from quoin.runtime import durable

    rubrics = durable(rubrics, "rubrics")  # every gate reads them
    why = lambda df, rank, reason: df.select("dimension", F.when(reason.isNotNull(), F.struct(F.lit(rank).alias("rank"), reason.alias("reason"))).alias("w"))
    live = cards.select("card", F.sha2("text", 256).alias("sha"))
    gates = [
        why(rubrics.where(~F.coalesce((F.col("admission") == "human_approved") & (F.col("approved_digest") == (F.col("body_digest") if "body_digest" in rubrics.columns else F.lit(None))), F.lit(False))), 1, F.lit("not-approved")),
        why(violations(rubrics), 2, F.concat(F.lit("rule-"), "rule")),
        why(fingerprint(pins(rubrics, pinned), live), 3, F.concat(F.lit("panel-"), "problem")),
        why(ground(bindings(rubrics), cards, today, require_stamp, patterns=False), 4, F.when(~F.col("grounded"), F.concat(F.lit("evidence-"), "status"))),  # a filter would ground each twice
        why(explicit_gaps(rubrics, cards, today, require_stamp), 5, F.lit("quote-rotted")),
    ]
    shut = gates[0]
    for g in gates[1:]:
        shut = shut.unionAll(g)
    first = shut.groupBy("dimension").agg(F.min("w").alias("w"))
    scale = criteria(rubrics).select("dimension", F.col("c.id").alias("criterion"), (F.size("c.levels") - 1).alias("top"))
    judged = verdicts(scale, scores, hurdle)
    drafts = scores.select("draft", "dimension").distinct().join(rubrics.select("dimension"), "dimension")
    known = calibrated.select("dimension").distinct().withColumn("calibrated", F.lit(True)) if calibrated is not None else rubrics.select("dimension").where("false").withColumn("calibrated", F.lit(True))
    rows = drafts.join(first, "dimension", "left").join(judged, ["draft", "dimension"], "left").join(known, "dimension", "left")
    reason = F.coalesce(F.col("w.reason"), F.when(F.col("go").isNull(), "scores"))
    outcome = F.when(reason.isNotNull(), "unavailable").when(F.col("go"), "go").otherwise("recycle")
    return rows.select("draft", "dimension", outcome.alias("outcome"), reason.alias("reason"), F.when(reason.isNull(), F.col("points")).alias("points"), F.when(reason.isNull(), F.col("defects")).alias("defects"), (reason.isNull() & F.coalesce("calibrated", F.lit(False))).alias("calibrated"))


# How a move begins, what marks it as advice, and what of its text is a marker.
MOVE, ADVISORY = r"^- \*\*(.+?)\*\*", r"(?i)\[advisory\]"
IN_MARKER = r"(?s)\(\s*(?:grep|search)(?:-re)?:(?:[^`)]|`[^`]*`)*\)"


def craft_moves(texts: DataFrame) -> DataFrame:
    """(dimension, ord, name, body, markers, criticality, guidance, problem) of the bold bullets of Craft sections (dimension, craft).

    A move without an anchor has the problem unanchored, and a section without any move is one row with the problem no-moves: neither can be made a rubric.
    """
    from quoin.functions.anchors import parse_markers

    moves = F.filter(F.split("craft", r"\n(?=- \*\*)"), lambda m: m.rlike(MOVE))
    rows = texts.select("dimension", F.posexplode_outer(moves).alias("ord", "body"))
    rows = rows.withColumn("markers", parse_markers(F.col("body"))).withColumn("bare", F.regexp_replace(F.regexp_replace("body", MOVE, ""), IN_MARKER, ""))
    guidance = F.btrim(F.regexp_replace(F.regexp_replace("bare", ADVISORY, ""), r"(?U)\s+", " "), F.lit(" .—-"))
    problem = F.when(F.col("body").isNull(), "no-moves").when(F.size("markers") == 0, "unanchored")
    return rows.select("dimension", "ord", F.trim(F.regexp_extract("body", MOVE, 1), F.lit(" .:")).alias("name"), "body", "markers", F.when(F.col("bare").rlike(ADVISORY), "advisory").otherwise("required").alias("criticality"), guidance.alias("guidance"), problem.alias("problem"))


def panel_of(listed: Column) -> Column:
    """The cards that a synthesis lists, without brackets and remarks in parentheses."""
    return F.filter(F.transform(F.split(F.translate(listed, "[]", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"\s*\([^)]*\)", ""))), lambda x: x != "")


def ground_panel(moves: DataFrame, panel: DataFrame, cards: DataFrame, today: str, require_stamp: bool = False) -> DataFrame:
    """Each anchor of moves (dimension, ord, markers) against every card of its panel (dimension, place, card): (dimension, ord, anchor, marker, status, card, line).

    An anchor that one card holds is found there; one that several hold is ambiguous-panel; else the status is the most telling failure, the later card's of equal ones. Without a panel
    nothing is found. cards (card, text, stored_sha, review_by).
    """
    from quoin.operators.grounding import by_source, evidence_status
    from quoin.operators.services import REASONS

    marks = moves.select("dimension", "ord", F.posexplode("markers").alias("anchor", "marker"))
    asked = marks.join(panel.select("dimension", "place", "card"), "dimension", "left")
    done = evidence_status(by_source(asked, _stamped(cards)), today, require_stamp).withColumn("status", F.when(F.col("card").isNull(), "not-found").otherwise(F.col("status")))
    good = F.col("status").isin("found", "folded-only")
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("status")], F.lit(0))
    g = done.groupBy("dimension", "ord", "anchor").agg(
        F.first("marker").alias("marker"), F.count_if(good).alias("n"), F.max(F.when(good, F.struct("place", "card", "status", F.try_element_at("lines", F.lit(1)).alias("line")))).alias("hit"), F.max_by("status", F.when(~good, F.struct(rank, "place"))).alias("why")
    )
    one = F.col("n") == 1
    status = F.when(one, F.col("hit.status")).when(F.col("n") > 1, "ambiguous-panel").otherwise(F.col("why"))
    return g.select("dimension", "ord", "anchor", "marker", status.alias("status"), F.when(one, F.col("hit.card")).alias("card"), F.when(one, F.col("hit.line")).alias("line"))


def derive(moves: DataFrame, panel: DataFrame, cards: DataFrame, today: str, levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """Candidate rubrics made of Craft moves (from craft_moves), and the problems (dimension, ord, problem) of dimensions from which none is made.

    A move becomes a criterion under a name that stays, its anchors cited to the card that holds each. What needs judgement is left blank: such a rubric breaks its rules until a person fills it.
    A dimension with an unanchored move, an anchor that doesn't ground in exactly one card, two moves of one name, or a panel card that isn't installed, has problems and no rubric.
    """
    if isinstance(levels, bool) or not isinstance(levels, int) or levels < 2:
        raise ValueError(f"levels must be a whole number of 2 or more, not {levels!r}")
    from quoin.functions.text import slug

    told = ground_panel(moves.where("problem is null"), panel, cards, today)
    name = F.concat("dimension", F.lit("."), F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), F.lit("criterion")))
    named = moves.where("problem is null").withColumn("id", name)
    live = panel.join(cards.select("card", F.sha2("text", 256).alias("sha")), "card", "left")
    problem = lambda df, ord_, what: df.select("dimension", ord_.cast("int").alias("ord"), what.alias("problem"))
    problems = problem(moves.where("problem is not null"), F.col("ord"), F.col("problem"))
    problems = problems.unionAll(problem(told.where(~F.col("status").isin("found", "folded-only")), F.col("ord"), F.concat(F.lit("evidence-"), "status")))
    problems = problems.unionAll(problem(named.groupBy("dimension", "id").agg(F.count("*").alias("n"), F.max("ord").alias("ord")).where("n > 1"), F.col("ord"), F.lit("name-repeated")))
    problems = problems.unionAll(problem(live.where("sha is null"), F.lit(None), F.concat(F.lit("not-installed-"), "card"))).distinct()

    text = lambda c: c.cast("string")
    cited = told.groupBy("dimension", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "card", "marker"))), lambda x: F.struct(x["card"].alias("card"), x["marker"]["phrase"].alias("phrase"), x["marker"]["before"].alias("before"), x["marker"]["after"].alias("after"), x["marker"]["nth"].alias("nth"))).alias("evidence"))
    none = F.lit(None).cast(f"array<{EVIDENCE}>")
    envelope = lambda value, kind, evidence: F.struct(text(value).alias("value"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.lit(None).cast("string").alias("warrant"), evidence.alias("evidence"))
    said = F.col("guidance") != ""
    c = F.struct(
        "ord", "id", F.lit("required").alias("criticality"), envelope(F.col("name"), "paraphrase", F.col("evidence")).alias("statement"), envelope(F.when(said, F.col("guidance")), F.when(said, "derived").otherwise("unknown"), none).alias("guidance"),
        F.lit(None).cast(f"map<string,{FIELD}>").alias("fields"), F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(i.alias("score"), envelope(F.lit(""), "operator_policy", none).alias("descriptor"))).alias("levels"), F.col("evidence"),
    )
    body = named.join(cited, ["dimension", "ord"]).groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(c), lambda x, y: x["ord"] - y["ord"]), lambda x: x.dropFields("ord")).alias("criteria"))
    pins = live.groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "card"))), lambda x: x["card"]).alias("panel"), F.map_from_entries(F.collect_list(F.struct("card", "sha"))).alias("sources"))
    sound = body.join(pins, "dimension").join(problems.select("dimension").distinct(), "dimension", "left_anti")
    return sound.select(F.lit(SCHEMA).alias("schema"), "dimension", "panel", F.lit("candidate").alias("admission"), F.concat(F.lit("_syntheses/"), "dimension", F.lit(".md")).alias("derived_from"), F.struct("sources").alias("fingerprint"), "criteria"), problems


def pinned(rubric: dict, live: dict[str, str | None], approve: bool = False) -> dict:
    """A rubric of authored criteria with its panel's sources pinned as they are (card -> digest), and if it is approved the digest of what was approved."""
    if gone := sorted(c for c in rubric["panel"] if live.get(c) is None):
        raise ValueError(f"panel cards whose source isn't installed can't be pinned: {gone}")
    out = {k: v for k, v in rubric.items() if k not in ("admission", "approved_digest")} | {"admission": "human_approved" if approve else "candidate", "fingerprint": {"sources": {c: live[c] for c in rubric["panel"]}}}
    return out | {"approved_digest": rubric_digest(out)} if approve else out


def sample_pages(pages: Column, seed: Column, n: int) -> Column:
    """n pages of 1..pages in order, the same for the same seed, as the standard library's generator draws them; all if there are no more, none of no pages."""

    def one(last: float, start: int) -> list[int]:
        every = range(1, int(last) + 1) if last == last and last else range(0)
        return list(every) if n >= len(every) else sorted(random.Random(int(start)).sample(every, max(0, n)))

    def run(last: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(last, start, strict=True)])

    return F.pandas_udf(run, "array<int>")(pages, seed)


def document_seed(text: Column) -> Column:
    """A number that is a document's own, as decimal text: the first 64 bits of its digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)


def rater_order(drafts: DataFrame, raters: DataFrame) -> DataFrame:
    """(rater, draft, ord): each rater's own order of the drafts (draft as text), which no rater can foresee and every run repeats. Each rater has a row for every draft; raters are people, so few."""
    from quoin.operators.ranks import ranked

    named = F.explode(F.array(*[F.lit(r["rater"]) for r in raters.select("rater").distinct().collect()] or [F.lit(None).cast("string")])).alias("rater")
    rows = drafts.select(F.col("draft").cast("string").alias("draft"), named).where("rater is not null")
    keyed = rows.withColumn("key ", F.sha2(F.concat("rater", F.lit(":"), "draft"), 256))
    return ranked(keyed, ["rater"], ["key "], "ord").select("rater", "draft", F.col("ord").cast("int").alias("ord"))


def sheet(rubric: dict, drafts: DataFrame, rater: str) -> DataFrame:
    """The JSON lines (ord, line) of a rater's sheet: a header with the rubric's identity and the drafts' digest, then a row for each draft, in the rater's order, and criterion, to be scored.

    drafts (draft, text) with a draft's name once.
    """
    spark = drafts.sparkSession
    each = spark.createDataFrame([(i, c["id"], c["statement"].get("value"), (c.get("guidance") or {}).get("value"), {str(x["score"]): x["descriptor"].get("value") for x in c["levels"]}, len(c["levels"]) - 1) for i, c in enumerate(rubric["criteria"])], "place int, criterion string, statement string, guidance string, levels map<string,string>, max_score int")
    n = drafts.agg(F.count("*").alias("n"), F.count_distinct("draft").alias("names"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("draft", F.sha2("text", 256).alias("sha"))))), 256).alias("digest"))
    head = F.struct(F.lit("rating-sheet/v1").alias("schema"), F.lit(rater).alias("rater"), F.lit(rubric["dimension"]).alias("dimension"), F.lit(rubric_identity(rubric)).alias("rubric_digest"), F.col("digest").alias("draft_digest"), (F.col("n") * len(rubric["criteria"])).alias("rows"))
    header = n.select(F.lit(0).cast("long").alias("ord"), F.when(F.col("n") == F.col("names"), F.to_json(head)).otherwise(F.raise_error(F.lit("a draft's name is repeated")).cast("string")).alias("line"))
    order = rater_order(drafts, spark.createDataFrame([(rater,)], "rater string"))
    row = F.struct("rater", "draft", "criterion", "statement", "guidance", "levels", "max_score", F.lit(None).cast("int").alias("score"), F.lit("").alias("note"))
    rows = order.crossJoin(F.broadcast(each)).select(((F.col("ord") - 1) * len(rubric["criteria"]) + F.col("place") + 1).cast("long").alias("ord"), F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))
    return header.unionAll(rows)


def paired(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two raters' rows (draft, criterion, max_score, score): the pairs (criterion, scale, x, y) that both scored on one scale, and the problems (draft, criterion, problem) of the rest."""
    both = one.select("draft", "criterion", F.col("max_score").alias("s1"), F.col("score").alias("x")).join(two.select("draft", "criterion", F.col("max_score").alias("s2"), F.col("score").alias("y")), ["draft", "criterion"], "full_outer")
    problem = F.when(F.col("s1").isNull() | F.col("s2").isNull(), "only one has it").when(F.col("s1") != F.col("s2"), "scales differ").when(F.col("x").isNull() | F.col("y").isNull(), "unscored")
    told = both.withColumn("problem", problem)
    return told.where("problem is null").select("criterion", F.col("s1").alias("scale"), "x", "y"), told.where("problem is not null").select("draft", "criterion", "problem")
