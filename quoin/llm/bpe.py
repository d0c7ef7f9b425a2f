"""Byte-level BPE: encoding and decoding whole texts.

Documents are cut by the pattern into words. In Arrow batches, each Python worker folds ranked merges over the bytes of each distinct word that it meets, once (words are kept up to
CACHE of them): the leftmost adjacent pair of lowest rank merges until none has a rank. A document's ids are its words' ids one after another, and decoding concatenates
the ids' binary pieces. Nothing is shuffled.

encode_words and decode_ids are the same in Spark's higher-order functions. A word is handled as a string with a character for each of its bytes, and ranks come from a literal map, cut into small maps by a checksum, as Spark looks through a map in order. They serve tables
of words; for whole corpora they cost more than the limits allow (figures in the README), as does taking the distinct words of all documents there and back. The
fold's work grows with the square of a word's length; words over LONG bytes are merged with a heap of pairs instead, with the same result.

Null and empty texts have no tokens. Rows are handled one by one; ids may be null or repeated. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits

BUCKETS, LONG, CACHE = 1 << 14, 96, 600_000


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of small maps from pieces (a character for each byte) to ranks, by the checksum of the piece."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        s = piece.decode("latin-1")
        buckets[zlib.crc32(s.encode()) % BUCKETS][s] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def piece_list(ranks: dict[bytes, int]) -> Column:
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def encode_word(word: Column, maps: Column) -> Column:
    """Ids of a word of one character a byte. Null ranks are pairs that don't merge."""
    rank = lambda p: maps[F.pmod(F.crc32(p.cast("binary")), F.lit(BUCKETS)).cast("int")][p]
    chars = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(state: Column, _: Column) -> Column:
        parts = state["parts"]

        def merged(r: Column) -> Column:
            least = F.array_min(r)
            at = F.array_position(r, least).cast("int")
            joined = lambda p: F.concat(F.slice(parts, F.lit(1), p - 1), F.array(F.concat(parts[p - 1], parts[p])), F.slice(parts, p + 2, F.size(parts)))
            return F.when(least.isNull(), F.struct(parts.alias("parts"), F.lit(True).alias("done"))).otherwise(F.struct(_bound(at, joined).alias("parts"), F.lit(False).alias("done")))

        n = F.size(parts) - 1
        pairs = F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), lambda a, b: rank(F.concat(a, b)))
        return F.when(state["done"] | (n < 1), state).otherwise(_bound(pairs, merged))

    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    folded = F.aggregate(steps, F.struct(chars.alias("parts"), F.lit(False).alias("done")), step, lambda s: F.transform(s["parts"], rank))
    whole = rank(word)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(folded)


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids."""
    return F.encode(F.aggregate(ids, F.lit(""), lambda s, i: F.concat(s, pieces[i])), "ISO-8859-1")


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word's bytes. The fold keeps the rank of each adjacent pair; long words keep pairs in a heap."""
    if not word:
        return []
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merged_long(word, ranks)
    rank, none = ranks.get, len(ranks) + 1
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(joined + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + joined, none)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a linked list and a heap of (rank, place): n log n in the word's length."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(p := joined + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, p))
        if before[i] >= 0 and (r := ranks.get(p := parts[before[i]] + joined)) is not None:
            heapq.heappush(heap, (r, before[i], p))
    return [ranks[p] for p in parts if p is not None]


def _long(path: str):
    def run(words: pd.Series) -> pd.Series:
        ranks = ranks_of(path)
        return pd.Series([merged(bytes(w), ranks) for w in words])

    return F.pandas_udf(run, "array<int>")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word binary, ids, piece binary) of distinct words (column word, binary)."""
    ranks = ranks_of(path)
    maps, pieces = rank_map(ranks), piece_list(ranks)
    latin = F.decode("word", "ISO-8859-1")
    short = words.where(F.octet_length("word") <= LONG).withColumn("ids", encode_word(latin, maps))
    long = words.where(F.octet_length("word") > LONG).withColumn("ids", _long(path)("word"))
    return short.unionAll(long).withColumn("piece", decode_ids(F.col("ids"), pieces))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])


def _encode(path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        pieces = {v: k for k, v in ranks.items()}
        words, known = regex.compile(pattern), {}
        for batch in batches:
            out: list[list] = [[] for _ in _OUT]
            for text in batch.column(1):
                own = words.findall(text.as_py() or "")
                if len(known) > CACHE:
                    known.clear()
                for w in set(own).difference(known):
                    known[w] = np.array(merged(w.encode(), ranks), "<u4").tobytes()
                coded = b"".join(map(known.__getitem__, own))
                decoded = b"".join(map(pieces.__getitem__, np.frombuffer(coded, "<u4").tolist()))
                for c, v in zip(out[1:], (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest(), coded if keep else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out[1:], list(_OUT)[1:], strict=True))], schema=_OUT)

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if kept, ids (little-endian 32-bit) of every row."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_encode(path, pattern, keep), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if keep else out.drop("ids")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids array<int>) with their bytes in decoded."""
    return rows.select("doc_id", decode_ids(F.col("ids"), piece_list(ranks_of(path))).alias("decoded"))
