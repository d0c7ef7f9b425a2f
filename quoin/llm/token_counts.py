"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined by a newline and encoded once as a whole by a byte-level BPE, so no token depends on where a field or section begins. Each token covers
characters [start, end): from the character that holds its first byte to the one that holds its last. Sections are the lines of text fields, with their newline; a field's
other sections are the field as a whole. Token spans are joined with section spans (a merge of two sorted lists), and a token over a boundary is allocated by rule:
  first: it counts for the section that holds its first character (n_tokens);
  share: each section gets the part of its bytes that lie there (token_share; shares of a token add up to 1).
crossing counts the tokens that begin in the section and end in another. Counts of all sections of a document add up to its tokens.

Null and empty fields are empty; a document whose joined text is empty has one section without tokens. Rows are handled one by one; ids may be null or repeated.
A very long text is encoded whole, by one task that holds it and its spans; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, worker_cache

CACHE = 250_000
_LOADED: dict = {}


def _load(path: str, pattern: str):
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern), {v: len(k) for k, v in ranks.items()}
    return _LOADED[path]


def token_bytes(text: str, path: str, pattern: str) -> np.ndarray:
    """Length in bytes of each token; they tile the text. The pattern's matches tile it too and are encoded each for itself, once."""
    enc, cut, size = _load(path, pattern)
    known = worker_cache(f"lengths of {path}", CACHE)
    out: list[int] = []
    for m in cut.findall(text):
        n = known.get(m)
        if n is None:
            n = known[m] = tuple(size[i] for i in enc.encode_ordinary(m))
        out += n
    return np.array(out, np.int64)


def sections(text: str) -> list[int]:
    """Characters where lines begin."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def attribute(text: str, starts: list[int], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by the first rule, byte shares and crossing tokens of each section."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = token_bytes(text, path, pattern).cumsum()
    if len(ends) == 0:
        return (np.zeros(len(starts), np.int64), np.zeros(len(starts)), np.zeros(len(starts), np.int64))
    begins = np.append(0, ends[:-1])
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each character begins
    bounds = heads[np.array(starts)] if len(heads) == len(text) else np.array(starts)
    char_at = lambda b: np.searchsorted(heads, b, side="right") - 1
    edge = np.array(starts)
    own = np.searchsorted(edge, char_at(begins), side="right") - 1
    last = np.searchsorted(edge, char_at(ends - 1), side="right") - 1
    n = np.bincount(own, minlength=len(starts))
    share = np.bincount(own[own == last], minlength=len(starts)).astype(float)
    limits = np.append(bounds, len(raw))
    for i in np.flatnonzero(own != last):
        for s in range(own[i], last[i] + 1):
            share[s] += (min(ends[i], limits[s + 1]) - max(begins[i], limits[s])) / (ends[i] - begins[i])
    return n, share, np.bincount(own[own != last], minlength=len(starts))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("token_share", pa.float64()), ("crossing", pa.int64())])


def _count(fields: list[str], lined: set[str], path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SCHEMA]
            for doc, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, starts, names = "", [], []
                for i, (f, v) in enumerate(zip(fields, values, strict=True)):
                    v = (v or "") + ("\n" if i + 1 < len(fields) else "")
                    own = sections(v) if f in lined else [0]
                    starts += [len(whole) + s for s in own] if v or not whole and i + 1 == len(fields) else []
                    names += [(f, j) for j in range(len(own))] if v or not whole and i + 1 == len(fields) else []
                    whole += v
                n, share, crossing = attribute(whole, starts, path, pattern)
                ends = [*starts[1:], len(whole)]
                for c, v in zip(out, ([doc] * len(starts), [f for f, _ in names], [j for _, j in names], starts, ends, n.tolist(), share.tolist(), crossing.tolist()), strict=True):
                    c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def token_counts(docs: DataFrame, fields: list[str], tokenizer: str, pattern: str, lined: tuple[str, ...] = ("text",)) -> DataFrame:
    """A row for each section: doc_id, field, section (from 0 in its field), start, end (characters of the joined text), n_tokens, token_share, crossing."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{f}`").cast("string").alias(f"field_{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(_count(fields, set(lined), tokenizer, pattern), "doc_id long, field string, section int, start long, end long, n_tokens long, token_share double, crossing long")
