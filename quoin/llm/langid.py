"""Language identification by cross-parsing entropy.

Of each language (every label) a sample of labelled text becomes a suffix automaton: at most SAMPLE symbols, from the 2 * DOCS rows with the least hash of id and text at most, of
each its first PREFIX characters, if they have SHORT symbols or more, and an equal share of SAMPLE but LEAST symbols at least. These bounds are parameters of learn(). A worker
holds the automata of one group of at most LANGUAGES languages, which bounds it at about 200 MB (50 MB for four languages); of more languages, each group parses all texts in tasks
of its own and the least rate over the groups decides. A text is cut greedily into the longest phrases that occur in the sample; the language that needs the fewest phrases a letter
wins, ties to the first name. Letters are lower-cased, runs of anything else are one space. The COMMON letters that the group's samples have most are a symbol each; any other
letter of theirs is a number of as many digits to the base 32 as they need, so alphabets of any size are told apart; letters that no sample of the group has match nothing.
The whole text is parsed, in stretches of STRETCH symbols at whose ends a phrase ends.

Automata are dense tables (states by symbols) and many stretches advance together, a symbol a step. Texts that are null or have no letter are `und`, with score 0.
score is the share by which the winner needs fewer phrases than the second (with one language: 1 - phrases a letter). Without any labelled row all are `und`.
Labels that are null or blank aren't learned. Only doc_id, text and, in learning, lang are read; lang, source and doc_id are no inputs of a prediction.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, worker_cache

SAMPLE, DOCS, PREFIX, SHORT, LEAST = 32_768, 128, 4000, 20, 256
LANGUAGES, STRETCH, COMMON, BLOCK = 8, 1024, 61, 2_000_000


def learn(rows: DataFrame, most: int = SAMPLE, docs: int = DOCS, prefix: int = PREFIX, short: int = SHORT, least: int = LEAST) -> dict[str, str]:
    """A bounded sample of normalised text for each language of rows (doc_id, text, lang)."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    rows = rows.where("lang is not null and trim(lang) != '' and text is not null").select("text", "lang", F.pmod(h, F.lit(1 << 30)).alias("h"))
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    out: dict[str, str] = {}
    order = Window.partitionBy("lang").orderBy("h", "text")
    for at in range(0, len(counts), 8 * LANGUAGES):  # what the driver holds at once
        limits = rows.sparkSession.createDataFrame([(k, int(min(1.0, 4 * docs / n) * (1 << 30))) for k, n in counts[at : at + 8 * LANGUAGES]], "lang string, most long")
        likely = rows.join(F.broadcast(limits), "lang").where("h < most").select("lang", "h", F.substring("text", 1, prefix).alias("text"))
        picked = likely.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * docs).collect()  # however many rows share a hash
        texts: dict[str, list] = {}
        for r in sorted(picked, key=lambda r: (r["lang"], r["r"])):
            if len(t := normalised(r["text"])) >= short:
                texts.setdefault(r["lang"], []).append(t)
        out |= {k: " ".join(t[: max(least, most // len(v))] for t in v)[:most] for k, v in texts.items()}
    return out


def groups_of(sample: dict[str, str]) -> list[dict[str, str]]:
    """The sample in groups of at most LANGUAGES languages."""
    names = sorted(sample)
    return [{k: sample[k] for k in names[i : i + LANGUAGES]} for i in range(0, len(names), LANGUAGES)]


def normalised(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton: row 1 is the root, 0 means that no transition exists."""
    nxt = np.zeros((2 * len(symbols) + 3, width), np.int32)
    link, length = [0] * len(nxt), [0] * len(nxt)
    size, last = 2, 1
    for s in symbols.tolist():
        cur, size = size, size + 1
        length[cur] = length[last] + 1
        p = last
        while p and not nxt[p, s]:
            nxt[p, s] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = int(nxt[p, s])
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone, size = size, size + 1
                nxt[clone] = nxt[q]
                length[clone], link[clone] = length[p] + 1, link[q]
                while p and nxt[p, s] == q:
                    nxt[p, s] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt[:size]


class _Symbols:
    """Letters as symbols: 0 letters that no sample has, 2 space, from 3 on the common letters, then the 32 digits that other letters are written in."""

    def __init__(self, sample: dict[str, str]) -> None:
        seen = Counter("".join(sample.values()))
        del seen[" "]
        common = [c for c, _ in seen.most_common(COMMON)]
        rest = sorted(set(seen) - set(common))
        self.table = np.fromiter((0 if chr(c).isalpha() else 2 for c in range(0x110000)), np.uint8, 0x110000)
        for i, c in enumerate(sorted(common)):
            self.table[ord(c)] = 3 + i
        self.first = 3 + len(common)
        self.width = self.first + (32 if rest else 0)
        self.digits, self.number = 1, None
        if rest:
            while 32**self.digits < len(rest):
                self.digits += 1
            self.number = np.zeros(0x110000, np.int32)
            self.number[[ord(c) for c in rest]] = np.arange(len(rest))
            self.table[[ord(c) for c in rest]] = 1

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """The symbols of a text, with one space for a run of them, and the number of its letters and spaces."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[points]
        space = s == 2
        kept = ~(space & np.append(True, space[:-1]))
        s, points = s[kept], points[kept]
        n = len(s)
        if self.number is not None and (s == 1).any():
            times = np.where(s == 1, self.digits, 1)
            at = np.repeat(np.arange(n), times)
            place = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            digit = self.number[points[at]] // 32 ** (self.digits - 1 - np.minimum(place, self.digits - 1)) % 32
            s = np.where(s[at] == 1, self.first + digit, s[at]).astype(np.uint8)
        return s, n


def _model(sample: dict[str, str]):
    """The symbols, and the languages' automata one below another."""
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).digest()
    ready = worker_cache("automata", 1)  # gone when the worker turns to something else
    if key not in ready:
        ready.clear()
        symbols, parts, base, roots = _Symbols(sample), [], 0, []
        for lang in sorted(sample):
            auto = automaton(symbols.of(sample[lang])[0], symbols.width)
            parts.append(np.where(auto, auto + base, 0))
            roots.append(base + 1)
            base += len(auto)
        ready[key] = symbols, np.concatenate(parts).astype(np.int32).ravel(), np.array(roots, np.int32)
    return ready[key]


def phrases(rows: list[np.ndarray], width: int, flat: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases that each language needs for each stretch: a matrix of languages by rows."""
    order = np.argsort([-len(r) for r in rows], kind="stable")
    lengths = np.array([len(rows[i]) for i in order])
    grid = np.zeros((int(lengths[0]), len(rows)), np.int32)
    for j, i in enumerate(order):
        grid[: lengths[j], j] = rows[i]
    first = flat[(roots[:, None] * width + np.arange(width)[None, :]).astype(np.int64)]
    unknown = first == 0
    first = np.where(unknown, roots[:, None], first)
    state = np.repeat(roots[:, None], len(rows), axis=1)
    count = np.zeros(state.shape, np.int32)
    active = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # rows longer than j
    for j, n in enumerate(active.tolist()):
        s = grid[j, :n]
        now = state[:, :n]
        to = flat[now.astype(np.int64) * width + s]
        dead = to == 0
        count[:, :n] += dead
        count[:, :n] += dead & unknown[:, s] & (now != roots[:, None])
        state[:, :n] = np.where(dead, first[:, s], to)
    count += state != roots[:, None]
    out = np.empty_like(count)
    out[:, order] = count
    return out


def _rates(sample: dict[str, str]):
    """For batches (doc_id, text): the batch, the phrases a letter of each language (by name) and row, and whether the row has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        symbols, flat, roots = _model(sample)
        for batch in batches:
            totals, sizes = np.zeros((len(roots), batch.num_rows)), np.zeros(batch.num_rows, np.int64)
            rows: list[np.ndarray] = []
            owners: list[int] = []
            held = 0

            def parse() -> None:
                nonlocal rows, owners, held
                if rows:
                    got = phrases(rows, symbols.width, flat, roots)
                    for k in range(len(roots)):
                        totals[k] += np.bincount(owners, got[k], batch.num_rows)
                rows, owners, held = [], [], 0

            for i, text in enumerate(batch.column(1)):
                t = text.as_py()
                if not t:
                    continue
                s, n = symbols.of(t.lower())
                if not n or s.max() == 2 and s.min() == 2:
                    continue
                sizes[i] = n
                for at in range(0, len(s), STRETCH):
                    rows.append(s[at : at + STRETCH])
                    owners.append(i)
                held += len(s)
                if held > BLOCK:
                    parse()
            parse()
            rate = totals / np.maximum(sizes, 1)
            yield batch, rate, sizes > 0

    return run


def _predict(sample: dict[str, str]):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(sample)
        for batch, rate, some in _rates(sample)(batches):
            best = rate.argmin(axis=0)
            ranked = np.sort(rate, axis=0)
            with np.errstate(all="ignore"):
                score = (ranked[1] - ranked[0]) / np.maximum(ranked[1], 1e-12) if len(langs) > 1 else 1 - ranked[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[b] if k else "und" for b, k in zip(best, some, strict=True)]), pa.array(np.where(some, np.clip(score, 0, 1), 0.0))], schema=schema)

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * batch.num_rows), pa.array([0.0] * batch.num_rows)], schema=schema)

    return run if sample else none


def _two_best(sample: dict[str, str]):
    """doc_id, row, and the rates and names of the best two languages of a group; none for rows without a letter."""
    two = pa.list_(pa.struct([("rate", pa.float64()), ("lang", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("best", two)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(sample)
        for batch, rate, some in _rates(sample)(batches):
            order = np.argsort(rate, axis=0, kind="stable")[:2]
            best = [[{"rate": float(rate[k, i]), "lang": langs[k]} for k in order[:, i]] if some[i] else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, two)], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame, sample: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row (and row, a hash of its text, where there are several groups of languages); learned from the rows' own labels but for held-out rows, unless a sample is given."""
    arrow_limits(docs.sparkSession)
    if sample is None:
        sample = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = groups_of(sample)
    if len(groups) < 2:
        return rows.mapInArrow(_predict(sample), "doc_id long, lang_pred string, score double")
    rows = rows.withColumn("row", F.xxhash64("text"))
    parts = [rows.mapInArrow(_two_best(g), "doc_id long, row long, best array<struct<rate:double,lang:string>>").withColumn("g", F.lit(i)) for i, g in enumerate(groups)]
    held = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "row").agg((F.count("*") / len(groups)).cast("int").alias("times"), F.collect_set(F.struct("g", "best")).alias("all"))
    ranked = held.select("doc_id", "row", "times", F.array_sort(F.flatten("all.best")).alias("r"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    score = F.least(F.greatest((second["rate"] - first["rate"]) / F.greatest(second["rate"], F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    out = ranked.select("doc_id", "row", F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return out.drop("copy")


def kept(docs: DataFrame) -> DataFrame:
    """The rows, with their own columns, whose text has a letter, and their lang as it is predicted: a wrong or missing label is set right. Rows that prediction calls `und` go; where
    nothing can be learned, so do texts without a letter, and lang stays as it is."""
    arrow_limits(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, label = names.index("text"), names.index("lang") if "lang" in names else None
    sample = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")) if label is not None else {}
    groups = groups_of(sample)
    inner = _predict(groups[0]) if sample else None  # what has a letter is the same in all groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if inner is None:
                yield batch.filter(pa.array([any(map(str.isalpha, t.lower())) if t else False for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            (found,) = inner(iter([own]))
            told = found.column(1)
            if len(groups) == 1:
                batch = batch.set_column(label, batch.schema.field(label), told.cast(batch.schema.field(label).type))
            yield batch.filter(pa.array([x != "und" for x in told.to_pylist()]))

    rows = plain.mapInArrow(run, plain.schema).toDF(*names)
    if len(groups) < 2:
        return rows
    told = languages(rows.select("doc_id", "text", "lang"), sample).dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("its id"), F.col("row").alias("its row"), F.col("lang_pred").alias("its language"))
    same = F.col("c_id").eqNullSafe(F.col("its id")) & (F.col("c_row") == F.col("its row"))
    own = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("c_id"), F.xxhash64("text").alias("c_row"))
    both = own.join(told, same, "left")
    return both.select(*[(F.coalesce("its language", f"c{i}") if i == label else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
