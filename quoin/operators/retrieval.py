"""Ranked search, evidence passages, and routes from names and symptoms to lenses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators.grounding import phrase_hits
from quoin.operators.matching import containing
from quoin.runtime import durable

K1, B, FEW_TERMS = 1.5, 0.75, 12


def _counted(blobs: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, dl, tfs): each blob's words and how often it has each term, in the order of wanted. Blobs are read once; few terms are counted in the JVM, many by one automaton."""
    dl = F.greatest(F.size(T.split_words(F.col("blob"))), F.lit(1))
    if len(wanted) <= FEW_TERMS:
        return blobs.select("id", dl.alias("dl"), F.array(*[T.count_of(F.lit(t), F.col("blob")) for t in wanted]).alias("tfs"))
    numbered = blobs.sparkSession.createDataFrame(list(enumerate(wanted)), "phrase_id long, phrase string")
    found = phrase_hits(blobs.select("id", F.col("blob").alias("text")), numbered)
    own = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("phrase_id").cast("int"), "times"))).alias("own"))
    return blobs.select("id", dl.alias("dl")).join(own, "id", "left").select("id", "dl", "own")


def bm25(blobs: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores of (question, id) for blobs (id, blob in lower case) and questions (question, terms array), by how often a term occurs as a substring.

    Questions are control data. Blobs are read once and their counts written (a row of numbers each); statistics and scores come from those.
    """
    asked = [(r["question"], [t.lower() for t in r["terms"] if t.strip()]) for r in questions.select("question", "terms").collect()]
    wanted = sorted({t for _, terms in asked for t in terms})
    kind = questions.schema["question"].dataType.simpleString()
    if not wanted:
        return blobs.select(F.lit(None).cast(kind).alias("question"), "id", F.lit(0.0).alias("score")).where("false")
    few = len(wanted) <= FEW_TERMS
    counts = durable(_counted(blobs, wanted), "counts")
    tf = lambda i: F.get("tfs", F.lit(i)) if few else F.coalesce(F.try_element_at("own", F.lit(i)), F.lit(0))
    if few:
        dfs = F.array(*[F.count_if(tf(i) > 0) for i in range(len(wanted))])
        stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), dfs.alias("dfs")).first()
        df = {t: stats["dfs"][i] for i, t in enumerate(wanted)}
    else:
        stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        seen = {r["i"]: r["df"] for r in counts.select(F.explode(F.map_keys("own")).alias("i")).groupBy("i").agg(F.count("*").alias("df")).collect()}
        df = {t: seen.get(i, 0) for i, t in enumerate(wanted)}
    idf = {t: math.log(1 + (stats["n"] - df[t] + 0.5) / (df[t] + 0.5)) for t in wanted}
    place = {t: i for i, t in enumerate(wanted)}
    weight = lambda i: tf(i) * (K1 + 1) / (tf(i) + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"])))
    if few:
        each = F.array(*[F.struct(F.lit(q).cast(kind).alias("question"), sum((F.lit(idf[t]) * weight(place[t]) for t in terms), F.lit(0.0)).alias("score"), sum(((tf(place[t]) > 0).cast("int") for t in terms), F.lit(0)).alias("hits")) for q, terms in asked if terms])
        return counts.select("id", F.explode(each).alias("x")).where("x.hits > 0").select("x.question", "id", "x.score")
    terms_ = counts.sparkSession.createDataFrame([(q, place[t], idf[t]) for q, terms in asked for t in terms], f"question {kind}, i int, idf double")
    hits = counts.where("own is not null").select("id", "dl", F.explode("own").alias("i", "tf"))
    score = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"])))
    return hits.join(terms_, "i").groupBy("question", "id").agg(F.sum(score).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "question") -> DataFrame:
    """The k best of each group, ties to the smaller id; a total for what is cut off."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_with_total(scored: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The k best of all rows, ties to the smaller id, and how many rows there are."""
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k), scored.count()


def blocks(docs: DataFrame, most: int = 8) -> DataFrame:
    """Paragraphs (islands between blank lines) in pieces of at most so many lines: id, start, end (lines from 1), text."""
    lines = docs.select(F.col("doc_id").alias("id"), F.posexplode(T.split_lines(F.col("text"))).alias("at", "line")).withColumn("blank", F.trim(F.translate("line", "\t\f ", "   ")) == "")
    in_doc = Window.partitionBy("id").orderBy("at")
    para = lines.withColumn("para", F.sum(F.col("blank").cast("int")).over(in_doc)).where(~F.col("blank"))
    piece = F.floor((F.row_number().over(Window.partitionBy("id", "para").orderBy("at")) - 1) / most)
    own = F.array_sort(F.collect_list(F.struct("at", "line")))
    grouped = para.withColumn("piece", piece).groupBy("id", "para", "piece").agg((F.min("at") + 1).alias("start"), (F.max("at") + 1).alias("end"), own.alias("own"))
    return grouped.select("id", "start", "end", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))


def passage_score(text: Column, terms: Column, exact: Column | None = None) -> Column:
    """Ten times the share of terms that occur, each term's occurrences up to three, and five for the whole question; 0 unless two terms occur (one of one)."""
    asked = F.array_join(T.split_words(F.lower(exact)), " ") if exact is not None else None
    need = F.when(F.size(terms) == 1, 1).otherwise(2)

    def scored(blob: Column, counts: Column) -> Column:
        matched = F.size(F.filter(counts, lambda n: n > 0))
        often = F.aggregate(counts, F.lit(0), lambda s, n: s + F.least(n, F.lit(3)))
        whole = F.lit(0.0) if exact is None else F.when((F.length(exact) > 0) & F.contains(blob, asked), 5.0).otherwise(0.0)
        return F.when(matched < need, F.lit(0.0)).otherwise(whole + matched / F.greatest(F.size(terms), F.lit(1)) * 10.0 + often)

    blob = F.array_join(T.split_words(F.lower(text)), " ")
    return T.once(blob, lambda own: T.once(F.transform(terms, lambda t: T.count_of(t, own)), lambda counts: scored(own, counts)))


def excerpt(text: Column, terms: Column, most: int = 2000) -> Column:
    """At most so many characters around the earliest term, with ellipses where it is cut."""
    low = F.lower(text)
    first = F.coalesce(F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)) - 1, F.lit(0))
    high = F.least(F.length(text), F.greatest(F.lit(0), first - most // 3) + most)
    start = F.greatest(F.lit(0), high - most)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, high - start), F.when(high < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def content_terms(question: str, title: Column | None) -> Column:
    """A question's terms without those of the title, which chose the source; all of them if none is left."""
    asked = T.terms(F.lit(question))
    if title is None:
        return asked
    left = F.array_except(asked, F.coalesce(T.terms(title), F.array().cast("array<string>")))
    return F.when(F.size(left) > 0, left).otherwise(asked)


def evidence(docs: DataFrame, question: str, k: int = 5) -> DataFrame:
    """The k best blocks of each document (doc_id, text, and title where there is one) for a question: id, rank, start, end, score, excerpt. No claim that a passage answers it."""
    own = blocks(docs).withColumn("terms", T.terms(F.lit(question)))
    if "title" in docs.columns:
        own = own.drop("terms").join(docs.select(F.col("doc_id").alias("id"), content_terms(question, F.col("title")).alias("terms")), "id")
    scored = own.withColumn("score", passage_score(F.col("text"), F.col("terms"), F.lit(question)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "start"))).where((F.col("rank") <= k) & (F.col("score") > 0))  # a filter before would score twice
    return ranked.select("id", "rank", "start", "end", "score", excerpt(F.col("text"), F.col("terms")).alias("excerpt"))


def cue_hit(cue: Column, symptom: Column) -> Column:
    """Cues with ASCII letters or digits match whole words, others anywhere."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), cue, F.lit(r"\E\b"))
    return F.when(cue.rlike("[A-Za-z0-9]"), F.regexp_like(symptom, quoted)).otherwise(F.contains(symptom, cue))


def diagnose(symptoms: DataFrame, diagnostics: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """symptoms (symptom_id, symptom) against the map (ord, cues, dims): the dimensions of rows with a hit, most hits first, each once (symptom_id, rank, dimension).

    dimensions (name, core_question) add the question of each, empty where it has none.
    """
    cues = diagnostics.select("ord", F.posexplode("cues").alias("cue_no", "c")).select("ord", "cue_no", F.lower("c").alias("cue"))
    met = containing(symptoms.select("symptom_id", F.lower("symptom").alias("low")), cues, "low", "cue").where(cue_hit(F.col("cue"), F.col("low")))
    scored = met.groupBy("symptom_id", "ord").agg(F.count("*").alias("score")).join(diagnostics.select("ord", "dims"), "ord")
    dims = scored.select("symptom_id", "score", "ord", F.posexplode("dims").alias("place", "d")).withColumn("dimension", F.replace(F.lower(F.trim("d")), F.lit(" "), F.lit("-")))
    firsts = dims.groupBy("symptom_id", "dimension").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "place")).alias("best"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("symptom_id").orderBy("best"))).select("symptom_id", "rank", "dimension")
    if dimensions is None:
        return ranked
    asked = dimensions.select(F.col("name").alias("dimension"), "core_question")
    return ranked.join(asked, "dimension", "left").select("symptom_id", "rank", "dimension", F.coalesce("core_question", F.lit("")).alias("core_question"))


NAME_STOP = ["the", "of", "a", "an", "and", "to", "in", "on", "for", "by", "&"]


def name_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, NAME_STOP))
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def folded_lenses(lenses: DataFrame, framework_sources: DataFrame | None) -> DataFrame:
    """lenses (kind, name, title, aliases) with sources that a framework (source, framework) stands for left out, and their titles and aliases among the framework's aliases."""
    if framework_sources is None:
        return lenses
    own = lenses.where("kind = 'source'").select(F.col("name").alias("source"), F.concat_ws(" ", "title", "aliases").alias("more"))
    told = framework_sources.select("source", F.col("framework").alias("name")).join(own, "source").groupBy("name").agg(F.concat_ws(" ", F.array_sort(F.collect_list("more"))).alias("more"))
    kept = lenses.join(framework_sources.select(F.lit("source").alias("kind"), F.col("source").alias("name")), ["kind", "name"], "left_anti")
    folded = kept.join(told.withColumn("kind", F.lit("framework")), ["kind", "name"], "left")
    return folded.select("kind", "name", "title", F.when(F.col("more").isNotNull(), F.concat_ws(" ", "aliases", "more")).otherwise(F.col("aliases")).alias("aliases"))


def consult(queries: DataFrame, lenses: DataFrame, most: int = 8, hints: int = 5) -> DataFrame:
    """Names (query_id, name) against lenses (kind, name, title, aliases): the exact stem first, then a family of stems, then whole words of all lenses.

    One row for each match with status exact, unique, ambiguous or none (then a suggestion), and one row without match where there is none. Queries meet the lenses that have their stem or hold one of their words.
    """
    stem = F.replace(F.lower(F.trim("asked")), F.lit(" "), F.lit("-"))
    asked = queries.select("query_id", F.col("name").alias("asked")).withColumn("stem", stem).withColumn("toks", name_tokens(F.col("asked")))
    hay = F.lower(F.concat_ws(" ", "name", "title", F.coalesce("aliases", F.lit(""))))
    own = lenses.select("kind", "name", F.sha2(hay, 256).alias("lens"), hay.alias("hay"))
    whole = own.select("kind", "name", "lens", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit(r"\b[a-z0-9]+\b"), F.lit(0)))).alias("tok"))
    toks = asked.select("query_id", F.posexplode("toks").alias("tok_no", "tok"))
    met = whole.join(F.broadcast(toks), "tok").select("kind", "name", "lens", "query_id", "tok_no")
    named = own.drop("hay").join(asked.select("query_id", F.col("stem").alias("name")), "name").select("kind", "name", "lens", "query_id")
    held = containing(own.drop("hay").where("kind = 'dimension'"), asked.select("query_id", "stem"), "name", "stem").select("kind", "name", "lens", "query_id")
    met = met.unionAll(named.unionAll(held).withColumn("tok_no", F.lit(None).cast("int")))
    pairs = met.groupBy("kind", "name", "lens", "query_id").agg(F.count_distinct("tok_no").alias("words")).join(asked, "query_id")
    kind_order = F.when(F.col("kind") == "dimension", 0).when(F.col("kind") == "framework", 1).otherwise(2)
    exact, family = F.col("name") == F.col("stem"), (F.col("kind") == "dimension") & F.startswith("name", F.concat("stem", F.lit("-")))
    scored = pairs.select("query_id", "kind", "name", F.when(exact, 3).when(family, 2).when(F.col("kind") == "dimension", 0).otherwise(1).alias("route"), kind_order.alias("k"), "words", F.size("toks").alias("need"), ((F.col("kind") == "dimension") & F.contains("name", F.col("stem"))).alias("inside"))
    scored = durable(scored.where((F.col("route") >= 2) | ((F.col("route") == 1) & (F.col("words") > 0)) | F.col("inside")), "lenses")
    tally = scored.groupBy("query_id").agg(F.max(F.col("route") == 3).alias("has_exact"), F.sum((F.col("route") == 2).cast("int")).alias("n_family"), F.sum(((F.col("route") == 1) & (F.col("words") == F.col("need"))).cast("int")).alias("n_full"), F.sum(F.col("inside").cast("int")).alias("n_inside"))
    full = (F.col("route") == 1) & (F.col("words") == F.col("need"))
    guarded = (F.col("n_full") == 1) & (F.col("n_inside") >= 2)
    status = F.when(F.col("has_exact") | (F.col("n_family") == 1), "exact").when(F.col("n_family") > 1, "ambiguous").when(guarded | (F.col("n_full") > 1), "ambiguous").when(F.col("n_full") == 1, "unique").otherwise("none")
    member = F.when(F.col("has_exact"), F.col("route") == 3).when(F.col("n_family") > 0, F.col("route") == 2).when(guarded, full | F.col("inside")).when(F.col("n_full") > 0, full).otherwise((F.col("route") == 1) & (F.col("words") > 0))
    rows = scored.join(tally, "query_id").withColumn("status", status).where(member)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("status") == "exact", F.col("k")).otherwise(0), F.when(F.col("inside"), 0).otherwise(1), F.desc("words"), "name")
    cap = F.when(F.col("status") == "exact", 1).when((F.col("status") == "ambiguous") & (F.col("n_family") == 0) & ~guarded, most).when(F.col("status") == "none", hints).otherwise(1 << 30)
    numbered = rows.withColumn("cap", cap).withColumn("rank", F.row_number().over(order))
    first = max(most, hints, 1)  # a number, so that each task keeps so many rows of a name before they are dealt
    ranked = numbered.where((F.col("cap") <= first) & (F.col("rank") <= first)).where("rank <= cap").unionAll(numbered.where(F.col("cap") > first))
    return asked.select("query_id").join(ranked, "query_id", "left").select("query_id", F.coalesce("status", F.lit("none")).alias("status"), "rank", "kind", "name")
