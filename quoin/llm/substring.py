"""Substring dedup: digests of short units, their earliest place in the corpus, and repeated passages cut out to the word.

Words are runs of letters and digits, compared in lower case; everything between them is taken along. by="passages" cuts a text after each word that comes first among
the NEAR words on either side of it: the last of a line before the last of a sentence, that before others, then by the smallest hash. So a cut depends on a few words around it, the units inside a passage
are the same wherever the passage stands, and text without sentence ends is cut as often as other text: a passage of 51 words holds whole units of 10 words in total. by="lines" has whole lines as units.
Units of three words or more (of one, for lines) are hashed to 128 bits; over all documents the digest's first place (smallest doc_id, there the first unit) is its earliest
occurrence, and units elsewhere are repeats. Repeats that follow each other are a run. A passage seldom begins and ends with a unit, so the ends of a run are
compared word by word with what stands beside the earliest occurrence (BESIDE words of it, as 16-bit codes) and the run grows as far as they agree; that is asked of runs whose units have ASK words or more
(no passage of 48 words was seen to have fewer). A run of least words or more is removed; shorter ones are phrases that texts share by chance, and stay (lines have least=1: every repeated line goes). A stretch of one word that is said over and over is
one unit, and equal only to as long a stretch. Removed spans keep their offsets (characters of the original
text); a span goes on to the next word that stays.

Hot units are one row for each task before the shuffle that finds first places; the joins back are ones that adaptive execution may split. What is gathered is gathered by
document, whose size bounds it. Null texts stay null; texts without words have no units. Rows of one doc_id are one document, so none of them repeats another. Rows without a
doc_id rank last, and don't repeat each other. What a document says twice itself stays, unless within=True; of a passage that another document has earlier, every copy goes.
An empty table gives an empty one. A very long text is cut, and cleaned, by one task that holds it and its units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, durable, worker_cache

LEAST, NEAR, BESIDE, ASK, CACHE, CHARS = 48, 6, 48, 8, 100_000, 500_000
TOKEN = re.compile(r"[^\W_]+|[.!?]+(?=[ \t\n])|\n")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x7FB5D329728EA185, 0xD6E8FEB86659FD93], np.uint64)


def _codes(tokens: list[str]) -> np.ndarray:
    """A hash of each word; 0 for line ends, 1 for sentence ends."""
    known = worker_cache("words of units", CACHE)
    try:
        return np.array(list(map(known.__getitem__, tokens)), np.uint64)
    except KeyError:
        for t in set(tokens):
            if t not in known:
                known[t] = 0 if t == "\n" else 1 if t[0] in ".!?" else xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")) | 2
        return np.array(list(map(known.__getitem__, tokens)), np.uint64)


def _mixed(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * m
    return x ^ (x >> np.uint64(29))


def units(texts: list[np.ndarray], by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts' codes, one after another: the words' hashes, the text of each word, where the units begin (in words), and their digests (two 64-bit numbers each)."""
    codes = np.concatenate([*texts, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    word = codes > 1
    h, doc = codes[word], owner[word]
    if not len(h):
        return h, doc, np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    before = np.cumsum(word) - 1

    def ends(code: int) -> np.ndarray:
        at = np.flatnonzero(codes == code)
        e = before[at]
        return e[(e >= 0) & (doc[e] == owner[at])]

    if by == "lines":
        cut = np.zeros(len(h), bool)
        cut[ends(0)] = True
    else:
        rank = np.full(len(h), 2, np.uint64)
        rank[ends(1)] = 1
        rank[ends(0)] = 0
        key = rank << np.uint64(32) | h >> np.uint64(32)
        cut = np.ones(len(h), bool)
        for d in range(1, min(NEAR, len(h) - 1) + 1):
            other = doc[d:] != doc[:-d]
            cut[d:] &= (key[d:] < key[:-d]) | other
            cut[:-d] &= (key[:-d] <= key[d:]) | other
    starts = np.append(0, np.flatnonzero(cut[:-1] | (doc[1:] != doc[:-1])) + 1)
    at = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
    sums = [np.add.reduceat(_mixed(h + at * _MIX[i], _MIX[i + 2]), starts) for i in (0, 1)]
    return h, doc, starts, np.stack(sums, axis=1)


def _narrow(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.uint16)


def _fixed(values: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous array as binaries of so many bytes."""
    n = len(values)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_KINDS = "doc_id long, row long, digest array<binary>, at array<int>, size array<int>, words binary, n_units long, own boolean"


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about CHARS characters of text: what is held for each character is many times as large."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size) // CHARS)) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows]):
            yield batch.slice(a, b - a)


def _cut(by: str):
    """Each document's distinct digests with the first word and the size of the first unit that has each; its words as codes; whether it repeats a unit of its own."""
    small = 1 if by == "lines" else 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n = batch.num_rows
            h, doc, starts, digest = units([_codes(TOKEN.findall(t.as_py() or "")) for t in batch.column(2)], by)
            size = np.diff(np.append(starts, len(h)))
            of = doc[starts] if len(h) else doc
            begins = np.searchsorted(doc, np.arange(n + 1))
            big = np.flatnonzero(size >= small)
            order = big[np.lexsort((big, digest[big, 1], digest[big, 0], of[big]))]
            new = np.ones(len(order), bool)
            new[1:] = (of[order[1:]] != of[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
            kept = np.sort(order[new])
            offsets = pa.array(np.searchsorted(of[kept], np.arange(n + 1)), pa.int32())
            lists = (_fixed(digest[kept], 16), pa.array((starts - begins[of])[kept], pa.int32()), pa.array(size[kept], pa.int32()))
            codes = _narrow(h)
            words = pa.array([codes[a:b].tobytes() for a, b in zip(begins, begins[1:])], pa.binary())
            counts = np.diff(np.searchsorted(of, np.arange(n + 1)))
            own = np.bincount(of[big], minlength=n) > np.bincount(of[kept], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.ListArray.from_arrays(offsets, x) for x in lists], words, pa.array(counts, pa.int64()), pa.array(own)], names=["doc_id", "row", "digest", "at", "size", "words", "n_units", "own"]
            )

    return run


_ASKS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("left", pa.bool_()), ("a_doc", pa.int64()), ("digest", pa.binary())])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's repeats: the two outer units at either end of runs of ASK words or more, with their earliest document."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, row, repeats in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = sorted({r["at"]: r for r in repeats}.values(), key=lambda r: r["at"])
            i = 0
            while i < len(found):
                j = i + 1
                while j < len(found) and found[j]["at"] - found[j - 1]["at"] - found[j - 1]["size"] <= 2:
                    j += 1
                if sum(r["size"] for r in found[i:j]) >= ASK:
                    rows += [(doc, row, r["at"], True, r["a_doc"], r["digest"]) for r in found[i : min(i + 2, j)]]
                    rows += [(doc, row, r["at"] + r["size"], False, r["a_doc"], r["digest"]) for r in found[max(i, j - 2) : j]]
                i = j
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ASKS)], schema=_ASKS)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, at, size, words, asked) of documents to (digest, left, beside): the codes of the words before or after a unit."""
    for batch in batches:
        out: list[tuple] = []
        for i, asked in enumerate(batch.column(4).to_pylist()):
            digests, at, size, words = (batch.column(k)[i].as_py() for k in range(4))
            index = {d: k for k, d in enumerate(digests)}
            for x in asked:
                if (k := index.get(x["digest"])) is not None:
                    first, stop = 2 * at[k], 2 * (at[k] + size[k])
                    out.append((x["digest"], x["left"], words[max(0, first - 2 * BESIDE) : first] if x["left"] else words[stop : stop + 2 * BESIDE]))
        kinds = (pa.binary(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["digest", "left", "beside"])


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def cut_runs(text: str | None, repeats: set[int], beside: dict[tuple[int, bool], np.ndarray], least: int, by: str = "passages", within: bool = False) -> tuple[str | None, list[dict]]:
    """The text without its repeats, and the removed spans. repeats: first words of units that other documents have earlier (of equal units in this one, the first).

    beside: by word and side, the codes that stand beside the earliest occurrence of the unit that begins (left) or ends there.
    """
    if not text:
        return text, []
    found = list(TOKEN.finditer(text))
    codes = _codes([m[0] for m in found])
    h, _, starts, digest = units([codes], by)
    h, stops = _narrow(h), np.append(starts, len(h))[1:]
    small = 1 if by == "lines" else 3
    first: dict[bytes, int] = {}
    again: list[bool] = []
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
        key = digest[i].tobytes()
        if b - a < small:
            again.append(False)
            continue
        again.append(within and key in first or first.setdefault(key, a) in repeats)
    held = {k for k, a in first.items() if a in repeats}

    def grown(i: int, left: bool, most: int) -> int:
        """Words beyond the run's outer unit i that agree with what stands beside an earliest occurrence; at most so many."""
        best = 0
        inner = [k for k in ((i, i + 1) if left else (i, i - 1)) if 0 <= k < len(again) and again[k]]
        edge = int(starts[i] if left else stops[i])
        for k in inner:
            w = int(starts[k] if left else stops[k])
            key = digest[k].tobytes()
            if key in held:
                source = int(first[key] + (0 if left else stops[k] - starts[k]))
                other = beside.get((source, left))
                if other is None:
                    continue
            else:
                source = int(first[key] + (0 if left else stops[k] - starts[k]))
                other = h[max(0, source - BESIDE) : source] if left else h[source : source + BESIDE]
            n = _agree(h[:w][::-1], other[::-1]) if left else _agree(h[w:], other)
            best = max(best, n - abs(w - edge))
        return max(0, min(best, most))

    spans: list[tuple[int, int]] = []
    i, last = 0, 0
    while i < len(again):
        if not again[i]:
            i += 1
            continue
        j = i + 1
        while j < len(again) and (again[j] or (stops[j] - starts[j] < small and j + 1 < len(again) and again[j + 1])):
            j += 1
        a, b = int(starts[i]), int(stops[j - 1])
        if by != "lines":
            a, b = a - grown(i, True, a - last), b + grown(j - 1, False, len(h) - b)
        if b - a >= least:
            spans.append((a, b))
            last = b
        i = j
    places = [m.start() for m, c in zip(found, codes.tolist()) if c > 1]
    whole = [{"start": places[a] if a else 0, "end": places[b] if b < len(places) else len(text)} for a, b in spans]
    out: list[dict] = []
    for s in whole:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(s)
    at, kept = 0, []
    for s in out:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*kept, text[at:]]), out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _drop(least: int, by: str, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, spans = batch.column("text"), [[] for _ in range(batch.num_rows)]
            marks = batch.column("repeats" if by == "lines" else "edges").to_pylist()  # passages have edges, or are shorter than ASK
            work = [i for i, (own, m) in enumerate(zip(batch.column("own").to_pylist(), marks, strict=True)) if within and own or m]
            if work:
                texts = clean.to_pylist()
                for i in work:
                    beside = {(x["at"], x["left"]): np.frombuffer(x["beside"], np.uint16) for x in batch.column("edges")[i].as_py() or ()}
                    texts[i], spans[i] = cut_runs(texts[i], {x["at"] for x in batch.column("repeats")[i].as_py() or ()}, beside, least, by, within)
                clean = pa.array(texts, pa.string())
            names = [n for n in batch.schema.names if n not in ("text", "own", "repeats", "edges")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], clean, pa.array(spans, _SPANS)], names=[*names, "clean", "removed"])

    return run


def substring_dedup(docs: DataFrame, least: int | None = None, more: tuple[str, str] = ("removed", "n_units"), by: str = "passages", within: bool = False) -> DataFrame:
    """The rows' columns with text cleaned and, after them, the removed spans of the original text and the number of units, under the names in more.

    by: "passages" of least words (48) or more, or whole "lines" of least words (1) or more. n_chars, where there is one, is counted anew. Where the table has a column of a name in
    more, underscores are put after that name.
    """
    if by not in ("passages", "lines"):
        raise ValueError(f"by must be passages or lines, not {by!r}")
    least = (1 if by == "lines" else LEAST) if least is None else least
    arrow_limits(docs.sparkSession)
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in ("doc_id", "text")], F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    cut = durable(rows.select("doc_id", "row", "text").mapInArrow(_cut(by), _KINDS), "units")  # read again and again
    spread = cut.select("doc_id", "row", F.explode(F.arrays_zip("digest", "at", "size")).alias("u")).select("doc_id", "row", "u.digest", "u.at", "u.size")
    first = cut.select("doc_id", F.explode("digest").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("a_doc"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    first = durable(first.where("a_doc != last or (unnamed and a_doc is not null)").select("digest", "a_doc"), "first")
    again = spread.join(first, "digest").where(~F.col("doc_id").eqNullSafe(F.col("a_doc"))).select("doc_id", "row", "at", "size", "a_doc", "digest")
    again = again.withColumn("key", F.xxhash64("doc_id", "row")).repartition("key").groupBy("key", "doc_id", "row").agg(F.collect_list(F.struct("at", "size", "a_doc", "digest")).alias("repeats"))
    again = durable(again, "repeats")
    edge = "struct<at:int,left:boolean,beside:binary>"
    facts = cut.select("doc_id", "row", "own", "n_units", F.lit(None).cast("array<int>").alias("repeats"), F.lit(None).cast(edge).alias("edge"))
    facts = facts.unionAll(again.select("doc_id", "row", F.lit(None).cast("boolean"), F.lit(None).cast("long"), "repeats.at", F.lit(None).cast(edge)))
    if by == "passages":
        asks = durable(again.select("doc_id", "row", "repeats").mapInArrow(_ask, "doc_id long, row long, at int, left boolean, a_doc long, digest binary"), "asks")
        asked = asks.groupBy(F.col("a_doc").alias("doc_id")).agg(F.collect_set(F.struct("digest", "left")).alias("asked"))
        held = cut.select("doc_id", "digest", "at", "size", "words").join(asked, "doc_id").select("digest", "at", "size", "words", "asked")
        answers = held.mapInArrow(_answer, "digest binary, left boolean, beside binary")
        told = asks.join(answers, ["digest", "left"]).select("doc_id", "row", F.struct("at", "left", "beside").alias("edge"))
        facts = facts.unionAll(told.select("doc_id", "row", F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("array<int>"), "edge"))
    facts = facts.withColumn("key", F.xxhash64("doc_id", "row")).repartition("key").groupBy("key", F.col("doc_id").alias("d"), F.col("row").alias("r"))
    facts = facts.agg(F.max("own").alias("own"), F.max("n_units").alias("n_units"), F.transform(F.flatten(F.collect_list("repeats")), lambda x: F.struct(x.alias("at"))).alias("repeats"), F.collect_list("edge").alias("edges"))
    own = rows.withColumn("key ", F.xxhash64("doc_id", "row")).repartition("key ")  # by document: even, so there is nothing to split in many small tasks
    same = (F.col("row").bitwiseXOR(F.col("r")) == 0) & F.coalesce(F.col("doc_id").bitwiseXOR(F.col("d")) == 0, F.col("doc_id").isNull() & F.col("d").isNull())  # no keys of the join, which would shuffle again
    joined = own.join(facts, (F.col("key ") == F.col("key")) & same, "left").drop("key ", "key", "d", "r", "row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "own", "repeats", "edges"))
    out = joined.mapInArrow(_drop(least, by, within), f"{kinds}, clean string, removed array<struct<start:bigint,end:bigint>>")
    back = {"text": F.col("clean"), "doc_id": F.col("doc_id"), **{c: F.col(f"c{i}") for i, c in enumerate(names) if c not in ("doc_id", "text")}}
    if "n_chars" in names:
        back["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    told = []
    for m in more:
        while m.lower() in {c.lower() for c in [*names, *told]}:
            m += "_"
        told.append(m)
    return out.select(*[back[c].alias(c) for c in names], F.col("removed").alias(told[0]), F.col("n_units").alias(told[1]))
