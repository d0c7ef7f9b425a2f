"""Search by an index: the scores of retrieval.bm25 without reading texts, kept up as documents come.

A term without white space occurs in a text as often as in the text's words, one after another. So a segment of the index holds the words of its texts with how often each has them (postings, with the text's
length in words), every different word, and the words' grams (three characters). A search finds the words that hold a term through the term's grams, adds up their postings, and scores from the numbers of texts
and words, which segments keep too; where very many words hold the terms, postings are asked themselves instead. A term with white space takes its candidates from the postings of its parts, and is counted in
those texts; where they are very many, in all, as one pass over the texts costs less than joining them. Postings and grams lie in files sorted by word and gram, so that a search skips what it doesn't ask for.

add() writes one segment; a text whose id is in the index already replaces the older one (its older postings no longer count). A segment without its marker, which is written last, isn't read. Texts are dealt
once, by id, to count their words, over several tasks a core, and at least as many as the session's shuffles have.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators.retrieval import B, K1
from quoin.runtime import durable

GRAM, FEW_WORDS, FEW_TERMS, FEW_TEXTS = 3, 4096, 32, 100_000


def _spaced(term: str) -> bool:
    return any(c.isspace() or "\x1c" <= c <= "\x1f" for c in term)


def _counted(words: Column) -> Column:
    """(word, dl, n) of the different words of a text, from runs in their order: no shuffle brings together what one row holds. The empty word, n 0, stands for the text itself, which may have no words."""
    row = lambda word, dl, n: F.struct(word.alias("word"), dl.alias("dl"), n.alias("n"))

    def runs(own: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~F.get(own, i).eqNullSafe(F.get(own, i - 1)))
        each = T.once(first, lambda at: F.transform(at, lambda i, k: row(F.get(own, i), F.size(own), F.coalesce(F.get(at, k + 1), F.size(own)) - i)))
        return F.concat(F.array(row(F.lit(""), F.greatest(F.size(own), F.lit(1)), F.lit(0))), each)

    return T.once(F.sort_array(words), runs)


def _told(rows: DataFrame, own: list[str], times: dict[str, Column]) -> DataFrame:
    """rows with (term, tf) for each of a few terms that they hold, by how often it is in them."""
    each = F.array(*[F.struct(F.lit(t).alias("term"), n.cast("bigint").alias("tf")) for t, n in times.items()])
    return rows.select(*own, F.inline(each)).where("tf > 0")


class Index:
    """An index in a folder of the shared store."""

    def __init__(self, spark: SparkSession, at: str, kind: str = "bigint") -> None:
        self.spark, self.at, self.kind = spark, at.rstrip("/"), kind

    def segments(self) -> list[str]:
        """Segments in the order in which they were added."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/done")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A few rows of control data as literals."""
        names = [c.split() for c in schema.split(", ")]
        each = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, names, strict=True)]) for r in rows]) if rows else F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in names)}>>")
        return self.spark.range(1, numPartitions=1).select(F.explode(each).alias("x")).select("x.*")

    def _read(self, table: str, schema: str) -> DataFrame:
        """All segments' rows of a table, with the number of the segment."""
        own, paths = self.segments(), []
        for s in own:
            paths.append(f"{self.at}/{table}/segment={s}")
        schema = f"{schema}, segment string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.at}/{table}").parquet(*paths)

    def add(self, blobs: DataFrame) -> str:
        """Index blobs (id, blob), whose ids are different. Returns the segment's name; nothing counts before all of it is written."""
        name = f"{len(self.segments()):08d}-{uuid.uuid4().hex[:8]}"

        def write(df: DataFrame, table: str) -> DataFrame:
            at = f"{self.at}/{table}/segment={name}"
            df.write.mode("overwrite").parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        rows = blobs.select(F.col("id").cast(self.kind).alias("id"), F.coalesce("blob", F.lit("")).alias("blob"))
        own = write(rows, "texts")
        deals = max(3 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # whatever the input's files are, and several a core: a last one alone leaves cores idle
        posted = write(own.repartition(deals, "id").select("id", F.inline(_counted(T.split_words(F.col("blob"))))).sortWithinPartitions("word"), "postings")
        words = write(posted.where("word <> ''").select("word").distinct(), "words")
        pieces = words.where(F.length("word") >= GRAM).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - GRAM + 1)).alias("i"))
        write(pieces.select("word", F.substring("word", F.col("i"), F.lit(GRAM)).alias("gram")).repartition("gram").sortWithinPartitions("gram"), "grams")
        sizes = posted.where("word = ''").select("id", "dl")
        made = sizes.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
        if self.segments():
            held = self._read("postings", f"id {self.kind}, word string, dl int").where("word = ''").groupBy("id").agg(F.max_by("dl", "segment").alias("was"))
            gone = held.join(sizes.select("id"), "id")
            write(gone.select("id"), "gone")
            made = made.unionAll(gone.agg(-F.count("*"), -F.sum("was")))
        else:
            write(sizes.where("false").select("id").coalesce(1), "gone")
        write(made.select("n", F.coalesce("total", F.lit(0)).cast("long").alias("total")).coalesce(1), "stats")
        self.spark.range(1, numPartitions=1).select(F.lit(name).alias("segment")).write.mode("overwrite").parquet(f"{self.at}/done/{name}")
        return name

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (id, segment) of texts that no later segment replaces."""
        gone = self._read("gone", f"id {self.kind}").groupBy("id").agg(F.max("segment").alias("since"))
        if len(self.segments()) < 2:
            return rows
        return rows.join(gone, "id", "left").where("since is null or segment >= since").drop("since")

    def words_of(self, terms: list[str]) -> DataFrame:
        """(term, word, times): the words that hold each term. Terms shorter than a gram are looked for in all words."""
        short, long = [t for t in terms if len(t) < GRAM], [t for t in terms if len(t) >= GRAM]
        asked = self._table([(t, t[i : i + GRAM]) for t in long for i in range(len(t) - GRAM + 1)], "term string, gram string").distinct()
        need = asked.groupBy("term").agg(F.count("*").alias("need"))
        found = self._read("grams", "word string, gram string").where(F.col("gram").isin(*sorted({t[i : i + GRAM] for t in long for i in range(len(t) - GRAM + 1)}))).select("word", "gram").distinct()
        held = found.join(F.broadcast(asked), "gram").groupBy("term", "word").agg(F.count("*").alias("n")).join(F.broadcast(need), "term").where("n = need").select("term", "word")  # of what is asked: small
        if short:
            every = self._read("words", "word string").select(F.explode(F.array(*map(F.lit, short))).alias("term"), "word").where(F.contains("word", "term"))
            held = every.unionAll(held) if long else every
        return held.select("term", "word", T.count_of(F.col("term"), F.col("word")).alias("times")).where("times > 0")

    def _sums(self, posted: DataFrame, terms: list[str]) -> DataFrame:
        """(term, id, segment, dl, tf) of a few terms, a column each, from all postings."""
        each = [F.sum(F.col("n") * T.count_of(F.lit(t), F.col("word"))).alias(f"t{i}") for i, t in enumerate(terms)]
        return _told(posted.groupBy("id", "segment").agg(F.max("dl").alias("dl"), *each), ["id", "segment", "dl"], {t: F.col(f"t{i}") for i, t in enumerate(terms)})

    def counts(self, terms: list[str]) -> DataFrame:
        """(term, id, dl, tf) of the texts that hold each term, as tables that are written."""
        plain, phrases = [t for t in terms if not _spaced(t)], [t for t in terms if _spaced(t)]
        parts = sorted({*plain, *(p for t in phrases for p in t.split())})
        empty = self.spark.createDataFrame([], f"term string, id {self.kind}, dl int, tf bigint")
        if not parts:
            return empty
        posted = self._read("postings", f"id {self.kind}, dl int, word string, n int")
        short = [t for t in parts if len(t) < GRAM]
        some = self.words_of(short).limit(FEW_WORDS + 1).collect() if short else []
        words = self.words_of(parts)
        if len(some) <= FEW_WORDS:
            some = words.limit(FEW_WORDS + 1).collect()
        if len(some) > FEW_WORDS and len(parts) <= FEW_TERMS:  # most words: no join of theirs with their postings
            hits = self._sums(posted, parts)
        else:
            words = words.distinct()  # segments may share words
            if len(some) <= FEW_WORDS:  # few words: the postings' files are asked for them alone
                names = sorted({r["word"] for r in some})
                words = self.spark.createDataFrame(sorted({tuple(r) for r in some}), words.schema).coalesce(1)
                posted = posted.where(F.col("word").isin(*names)) if names else posted.where("false")
            hits = posted.join(words, "word").groupBy("term", "id", "segment").agg(F.max("dl").alias("dl"), F.sum(F.col("n") * F.col("times")).alias("tf"))
        found = durable(self._live(hits).select("term", "id", "segment", "dl", "tf"), "hits")
        out = found.where(F.col("term").isin(*plain)).select("term", "id", "dl", "tf") if plain else empty
        if not phrases:
            return out
        wanted = self._table([(t, p) for t in phrases for p in sorted(set(t.split()))], "phrase string, term string")
        need = wanted.groupBy("phrase").agg(F.count("*").alias("need"))
        parted = found.join(F.broadcast(wanted), "term").groupBy("phrase", "id", "segment").agg(F.count("*").alias("n"), F.max("dl").alias("dl"))
        able = parted.join(F.broadcast(need), "phrase").where("n = need").select(F.col("phrase").alias("term"), "id", "segment", "dl")
        texts = self._read("texts", f"id {self.kind}, blob string")
        many = able.count() > FEW_TEXTS
        if many and len(phrases) <= FEW_TERMS:  # no shuffle of texts
            told = _told(texts, ["id", "segment"], {t: T.count_of(F.lit(t), F.col("blob")) for t in phrases}).join(able, ["term", "id", "segment"])
        else:
            told = texts.join(able if many else F.broadcast(able), ["id", "segment"]).withColumn("tf", T.count_of(F.col("term"), F.col("blob")).cast("bigint")).where("tf > 0")
        return out.unionAll(durable(told.select("term", "id", "dl", "tf"), "phrases"))

    def search(self, questions: DataFrame) -> DataFrame:
        """Scores (question, id, score) for questions (question, terms), as retrieval.bm25 gives them for all texts of the index."""
        asked = [(r["question"], [t.lower() for t in r["terms"] if t.strip()]) for r in questions.select("question", "terms").collect()]
        kind = questions.schema["question"].dataType.simpleString()
        wanted = sorted({t for _, terms in asked for t in terms})
        if not wanted or not self.segments():
            return self.spark.createDataFrame([], f"question {kind}, id {self.kind}, score double")
        stats = self._read("stats", "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        found = self.counts(wanted)
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term
        idf = lambda t: math.log(1 + (stats["n"] - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
        weights = self._table([(q, t, idf(t)) for q, terms in asked for t in terms], f"question {kind}, term string, idf double")
        score = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["total"] / max(1, stats["n"]))))
        return found.join(F.broadcast(weights), "term").groupBy("question", "id").agg(F.sum(score).alias("score"))
