"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections.

Leaves are clauses (a run of words up to a delimiter, at most about 24 characters); they tile the text, so equal roots mean equal texts.
A paragraph is the clauses of a line, a section a run of paragraphs that ends at a blank line, or after a paragraph whose digest says so,
or after 64 paragraphs: an insertion changes the digests of its own branch alone. The fingerprint is the tree: the root's hex digits, then for each section its code, and for each
paragraph its code and its leaves' codes. Trees are compared from the root down: equal branches count whole and aren't opened, so roots test equality, likeness() counts what is
shared below branches that differ, and edits() tells where they are. It takes about a quarter of the text's length, as its leaves have to tell edits within a line.

Null text counts as empty. Documents are in the order of doc_id (null first; rows with one doc_id by their text's hash); the one after the last is the first.
A table of one document has itself as the next. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
A very long text is cut by one task, which holds it and its edited form.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits

LEAF = re.compile(r"[^.,;:!?\n]{0,23}[\s.,;:!?]+|[^.,;:!?\n]{1,24}")
SECTION_MOST = 64
RANGES_MOST, RANGE_ROWS = 65_536, 1000
Tree = tuple[bytes, list]


def tree(text: str) -> Tree:
    """Root digest; sections as (digest, characters, paragraphs); paragraphs as (digest, characters, leaf digests one after another, 32 bytes each)."""
    sha = hashlib.sha256
    sections, paragraphs, leaves = [], [], []
    chars = 0

    def close_paragraph() -> bytes:
        nonlocal leaves, chars
        joined = b"".join(leaves)
        digest = sha(b"\1" + joined).digest()
        paragraphs.append((digest, chars, joined))
        leaves, chars = [], 0
        return digest

    def close_section() -> None:
        nonlocal paragraphs
        sections.append((sha(b"\2" + b"".join(p[0] for p in paragraphs)).digest(), sum(p[1] for p in paragraphs), paragraphs))
        paragraphs = []

    for piece in LEAF.findall(text):
        leaves.append(sha(b"\0" + piece.encode("utf-8", "surrogatepass")).digest())
        chars += len(piece)
        if "\n" in piece:
            digest = close_paragraph()
            if piece.count("\n") > 1 or digest[0] < 32 or len(paragraphs) >= SECTION_MOST:
                close_section()
    if leaves:
        close_paragraph()
    if paragraphs:
        close_section()
    return sha(b"\3" + b"".join(s[0] for s in sections)).digest(), sections


def printed(t: Tree) -> str:
    """The fingerprint of a tree: root, then sections parted by / as a code and paragraphs parted by comma, each a code and its leaves' codes. Codes are 24 bits, of sections 48."""
    code = lambda d: base64.b64encode(d, b"-_").decode()
    leaves = lambda joined: b"".join([joined[i : i + 3] for i in range(0, len(joined), 32)])
    return t[0].hex() + ":" + "/".join(code(s[0][:6]) + ",".join(code(p[0][:3] + leaves(p[2])) for p in s[2]) for s in t[1])


def fingerprint(text: str | None) -> str:
    return printed(tree(text or ""))


def _parsed(print_: str) -> list[tuple[str, list[str]]]:
    """A fingerprint's sections: code, and paragraphs as they stand."""
    return [(s[:8], s[8:].split(",")) for s in print_[65:].split("/")] if len(print_) > 65 else []


def _unshared(x: list, y: list, key) -> tuple[list, list, list]:
    """What only x and only y have by a key, one for one, and what of x is shared."""
    left = Counter(map(key, y))
    shared, own = [], []
    for v in x:
        if left[key(v)] > 0:
            left[key(v)] -= 1
            shared.append(v)
        else:
            own.append(v)
    other = []
    for v in reversed(y):  # the last of equal ones are left over
        if left[key(v)] > 0:
            left[key(v)] -= 1
            other.append(v)
    return own, other[::-1], shared


def likeness(a: str, b: str) -> float:
    """Leaves that two fingerprints share, twice, over all their leaves: 1 for equal texts and for no others. Equal sections count whole, then equal paragraphs of the others, then leaves of the rest."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = _parsed(a), _parsed(b)
    size = lambda paragraphs: sum(len(p) // 4 - 1 for p in paragraphs)
    total = sum(size(s[1]) for s in x) + sum(size(s[1]) for s in y)
    if not x or not y:
        return 0.0
    x, y, same = _unshared(x, y, lambda s: s[0])
    shared = sum(size(s[1]) for s in same)
    p, q, same = _unshared([p for s in x for p in s[1]], [p for s in y for p in s[1]], lambda p: p[:4])
    shared += size(same)
    cut = lambda paragraphs: [p[i : i + 4] for p in paragraphs for i in range(4, len(p), 4)]
    shared += len(_unshared(cut(p), cut(q), lambda c: c)[2])
    return min(2.0 * shared / total, 0.999999)


def edits(a: Tree | str | None, b: Tree | str | None) -> list[tuple[int, int]]:
    """Spans of characters of b (texts or their trees) in paragraphs that a doesn't have; branches with equal digests aren't opened."""
    a, b = (x if isinstance(x, tuple) else tree(x or "") for x in (a, b))
    if a[0] == b[0]:
        return []
    sections = {s[0] for s in a[1]}
    paragraphs = {p[0] for s in a[1] for p in s[2]}
    out, at = [], 0
    for digest, chars, own in b[1]:
        if digest not in sections:
            place = at
            for p, n, _ in own:
                if p not in paragraphs:
                    if out and out[-1][1] == place:
                        out[-1] = (out[-1][0], place + n)
                    else:
                        out.append((place, place + n))
                place += n
        at += chars
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def beside_next(docs: DataFrame) -> DataFrame:
    """(b, mark, doc_id, text) in partitions and order such that each row's next row in its b is its next document; mark is 1 for copies that only close a b.

    Ranges of doc_id come from its approximate quantiles, RANGE_ROWS documents each (more from 65 million documents on, as the driver holds at most RANGES_MOST bounds), so texts are
    shuffled once and no range holds an unbounded share of the ids. Ranges are sorted, which spills, and streamed; rows without an id are one range.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = max(1, min(RANGES_MOST, n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))

    placed = docs.select("doc_id", "text", bucket_of(cuts)("doc_id").alias("b"))
    order = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")
    firsts = sorted((r["b"], r["f"]["doc_id"]) for r in placed.groupBy("b").agg(F.min(order).alias("f")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    closing = F.lit(None).cast("int")
    if firsts:
        rows = docs.sparkSession.createDataFrame([(b, before[b], f) for b, f in firsts], "b int, before int, f long")
        placed = placed.join(F.broadcast(rows), "b", "left")
        closing = F.when(F.col("doc_id").eqNullSafe(F.col("f")), F.col("before"))
    both = placed.withColumn("closing", closing).select(
        F.explode(F.filter(F.array(F.struct(F.col("b"), F.lit(0).alias("mark")), F.struct(F.col("closing").alias("b"), F.lit(1).alias("mark"))), lambda x: x["b"].isNotNull())).alias("to"), "doc_id", "text"
    )
    return both.select("to.b", "to.mark", "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 16), "b").sortWithinPartitions("b", "mark", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def bucket_of(cuts: list[int]):

    @F.pandas_udf("int")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or x != x else bisect_right(cuts, x) for x in v.tolist()], dtype="int32")

    return bucket


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<start:bigint,end:bigint>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []  # held: b, mark, doc_id, text, tree, fingerprint

    def flush() -> pa.RecordBatch:
        nonlocal out
        made = pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], schema=_ARROW)
        out = []
        return made

    for batch in batches:
        for b, mark, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0] == b and held[1] == 1:
                continue  # more rows of the closing id
            own = tree(text)
            own_print = printed(own)
            if held and held[0] == b:
                _, _, at, was, before, print_ = held
                new = edited(was, text)
                after = tree(new)
                changed = printed(after)
                out.append((at, len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, own_print), [{"start": i, "end": j} for i, j in edits(before, after)]))
                if len(out) >= 500:
                    yield flush()
            held = (b, mark, doc_id, text, own, own_print)
    if out:
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, its likeness to the edited text and to the next document, and the spans of the edited text that differ (edits)."""
    arrow_limits(docs.sparkSession)
    return beside_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_compare, SCHEMA)
