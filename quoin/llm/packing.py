"""Best-fit packing of documents into sequences, in bulk-synchronous supersteps.

Documents become ids (a word-level BPE, then id 0) and, where longer than a sequence, pieces. As many sequences are open as the ids need at least. A superstep sorts pieces and gaps
together by size, the largest first, a gap before a piece of its size, and sweeps: each piece takes the smallest gap that holds it and that no larger piece has taken. In the sorted
order that is a matching of brackets, a gap opening one and a piece closing the last that is open, so it is found in parts: sizes are whole numbers up to the capacity, counts of each
size give the depth at which it begins (a window over at most two rows a size), a row's rank within its size gives its own depth, and a piece goes to the gap that opened its depth
last. Ranks are what resolves pieces that want one gap; they are counted over salted groups, so that a size shared by a third of all pieces is no single task. A superstep takes the pieces over half the size of the largest (all, from a 32nd of the
capacity down). A gap that holds several of that largest piece takes part with as many slots, each smaller by that piece. Then gaps shrink, and the next superstep begins with what wasn't placed; when a
sweep places nothing, sequences are opened for it. Each superstep ends in written tables, so a lost executor loses one at most. All state is in tables; the driver knows only how
many ids are left and the largest piece.

Null and empty texts are one piece that holds id 0 alone. doc_id may be null or repeated; rows are then packed one by one like others. An empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, durable, worker_cache

CACHE = 600_000
SHARE, SMALL = 0.5, 32
_LOADED: dict = {}
_ODD = re.compile("[\x1c-\x1f]")  # Python splits at these, the tokenizer does not
_USUAL = "\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0386-\u03ff\u0400-\u0481\u1e00-\u1eff\u2010-\u2027\u20ac"
_RARE = re.compile(f"[^{_USUAL}]")  # beyond these, Python's letters aren't surely those of the tokenizer
_LETTERS = "".join(c for c in map(chr, range(0x2000)) if c.isalpha() and not _RARE.match(c))
_PARTS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTERS}]+")  # where the tokenizer cuts, for the usual characters


def _tokenizer(path: str):
    """The tokenizer, and which ids end a word."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        suffix = t.model.end_of_word_suffix
        ends = np.zeros(t.get_vocab_size(), bool)
        if suffix:
            for token, i in t.get_vocab(with_added_tokens=False).items():
                ends[i] = token.endswith(suffix)
        _LOADED[path] = t, ends
    return _LOADED[path]


def _parts(text: str) -> list[str] | None:
    """What the tokenizer encodes each for itself: its own cuts of the lower-cased text. None for texts with rare characters."""
    if not text.isascii():
        if _RARE.search(text) or not unicodedata.is_normalized("NFC", text):
            return None
        text = text.replace("Σ", "σ")
    return None if _ODD.search(text) else _PARTS.findall(text.lower())


def _learn(new: list[str], known: dict[str, bytes], tok, ends: np.ndarray) -> None:
    """Encode words and keep their ids. Words are encoded many at once, and cut at the ids that end one; where that doesn't give as many, one by one."""
    ids = np.array(tok.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
    cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
    if len(cuts) == len(new) and cuts[-1] == 4 * len(ids):
        data = ids.tobytes()
        known.update(zip(new, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
    else:
        for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers; its parts are encoded once and kept."""
    tok, ends = _tokenizer(path)
    known = worker_cache(f"ids of {path}", CACHE)
    out = []
    for text in texts:
        parts = _parts(text)
        if parts is None:
            out.append(np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            continue
        own = list(map(known.get, parts))
        if None in own:
            new = [i for i, x in enumerate(own) if x is None]
            _learn(list({parts[i] for i in new}), known, tok, ends)
            for i in new:
                own[i] = known[parts[i]]
        out.append(b"".join(own))
    return out


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), encoded([t or "" for t in batch.column(1).to_pylist()], path), strict=True):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE, strict=True)], schema=_PIECE)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _ranked(rows: DataFrame, salts: int) -> DataFrame:
    """rows (kind, size, id) with their rank from 0 within kind and size."""
    own = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    inner = F.row_number().over(Window.partitionBy("kind", "size", "salt").orderBy("id")) - 1
    n = own.groupBy("kind", "size", "salt").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return own.withColumn("inner", inner).join(before, ["kind", "size", "salt"]).withColumn("rank", F.col("before") + F.col("inner")).drop("salt", "before", "inner")


def sweep(pieces: DataFrame, slots: DataFrame, salts: int) -> DataFrame:
    """(id, size, seq, slot): pieces (id, size) in slots (id, size, seq, slot) of gaps, each the smallest that holds it and that is left by larger ones; pieces without one aren't in it."""
    none = F.lit(None)
    rows = slots.select(F.lit(0).alias("kind"), "size", "id", "seq", "slot").unionAll(pieces.select(F.lit(1), "size", "id", none.cast("long"), none.cast("int")))
    counts = rows.groupBy("size", "kind").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("size"), "kind")  # two rows a size at most
    run = counts.withColumn("after", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(order))
    run = run.withColumn("depth", F.col("after") - F.least(F.lit(0), F.min("after").over(order)))
    run = run.withColumn("begins", F.coalesce(F.lag("depth").over(order), F.lit(0))).withColumn("place", F.row_number().over(order))
    own = _ranked(rows, salts).join(F.broadcast(run.select("size", "kind", "begins", "place")), ["size", "kind"])
    own = own.withColumn("level", F.when(F.col("kind") == 0, F.col("begins") + F.col("rank") + 1).otherwise(F.col("begins") - F.col("rank"))).where("level > 0")
    at = Window.partitionBy("level").orderBy("place")
    met = own.withColumn("to", F.lag(F.struct("seq", "slot")).over(at))
    return met.where("kind = 1").select("id", "size", "to.seq", "to.slot")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with their sequence_id and offset. Equal pieces are placed in any order; all of them are."""
    cut = durable(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")
    left = cut.select("id", F.col("length").alias("size"))
    facts = left.agg(F.count("*").alias("n"), F.sum("size").alias("ids"), F.max("size").alias("top"), F.min("size").alias("least")).first()
    salts = max(16, facts["n"] // 20_000)  # gaps and pieces of one size may be nearly all
    files = max(4, facts["n"] // 200_000)  # of the small tables
    gaps, opened, placed = None, 0, []
    moved = 0
    while facts["n"]:
        over = int(facts["top"] * SHARE) if facts["top"] * SMALL > capacity else 0  # pieces of this superstep are larger; small ones are all taken at once
        now = left.where(F.col("size") > over)
        if not moved:
            new = -(-(facts["ids"] if gaps is None else now.agg(F.sum("size")).first()[0]) // capacity)
            fresh = cut.sparkSession.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("room"))
            gaps, opened = (fresh if gaps is None else gaps.unionAll(fresh)), opened + new
        times = F.greatest(F.lit(1), F.floor(F.col("room") / facts["top"])).cast("int")
        slots = gaps.where((F.col("room") > over) & (F.col("room") >= facts["least"])).select("seq", "room", F.explode(F.sequence(F.lit(0), times - 1)).alias("slot"))
        slots = slots.select((F.col("seq") * capacity + F.col("slot")).alias("id"), (F.col("room") - F.col("slot") * facts["top"]).alias("size"), "seq", "slot")
        got = sweep(now, slots, salts).join(gaps, "seq")
        before = F.sum("size").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        got = durable(got.select("id", "size", "seq", (capacity - F.col("room") + F.coalesce(before, F.lit(0))).alias("offset")), "placed", files)
        moved = got.count()
        if moved:
            placed.append(got)
            used = got.groupBy("seq").agg(F.sum("size").alias("used"))
            gaps = durable(gaps.join(used, "seq", "left").select("seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0"), "gaps", files)
            left = durable(left.join(got.select("id"), "id", "left_anti"), "left", files)
            facts = left.agg(F.count("*").alias("n"), F.sum("size").alias("ids"), F.max("size").alias("top"), F.min("size").alias("least")).first()
    if not placed:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = placed[0]
    for p in placed[1:]:
        at = at.unionAll(p)
    return cut.join(at.select("id", F.col("seq").alias("sequence_id"), "offset"), "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
