"""Vector code compression: whole-number codebooks for each part of the vectors, found by segment-mean lower bounds.

Components become whole numbers floor(scale * x); vectors are cut into PARTS equal consecutive parts. Every part position has a codebook of ENTRIES entries, which starts as that part of
the vectors with the smallest ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the componentwise
floor(sum / count) of its parts; entries without parts stay.

Distances are not all computed. With mean m and residual norm r of a block of s components, |x - e|^2 over the block is at least s * (m_x - m_e)^2 + (r_x - r_e)^2. Such bounds are summed over one
block, then over two, four ... blocks of a part; a pair whose bound is beyond the exact distance to the entry with the least first bound is dropped (with a margin for the
rounding of doubles, so no nearest entry and no tie is lost), and survivors get exact distances of whole numbers.

A round is one pass over the vectors: each task adds up what its parts come to, and Spark adds up a row for each part, entry and component. Only these PARTS * ENTRIES entries are ever at the
driver or in a closure, whatever the number of vectors; they are made anew from the table, so a lost executor loses a task's work and no more.

Rows whose vector is null, or holds null or non-finite components, are dropped. Shorter vectors count as if filled with zeros, up to the greatest length, rounded up to a multiple of PARTS.
Whole numbers so large that sums of squared distances could leave a long (for 64 components 1.9e8, for 1,024 of them 4.7e7) count as that bound. Of rows of one vec_id that with the smallest vector
starts an entry, but each row has its code; a null vec_id comes after all others. Fewer ids than ENTRIES give fewer entries. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.knn import _dense
from quoin.runtime import arrow_limits, durable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _bounds(width: int, blocks: int) -> np.ndarray:
    """Where each of so many blocks of a part begins."""
    return np.unique(np.arange(blocks) * width // blocks)


def _summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and residual norm of every block of each row."""
    size = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def nearest(x: np.ndarray, book: np.ndarray, told: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, for whole numbers. told: gets the number of pairs left after each level, and that of exact distances."""
    n, width = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    fx, fe, blocks = x.astype(float), book.astype(float), 1
    i = j = least = slack = None
    while blocks < max(2, width):
        starts = _bounds(width, blocks)
        size = np.diff(np.append(starts, width))
        (mx, rx), (me, re) = _summary(fx, starts), _summary(fe, starts)
        if i is None:
            low = size[0] * (mx - me.T) ** 2 + (rx - re.T) ** 2
            guess = low.argmin(1)
            least = ((x - book[guess]) ** 2).sum(1)
            slack = 1e-9 * ((fx * fx).sum(1) + (fe * fe).sum(1).max() + 1)
            i, j = np.nonzero(low <= (least + slack)[:, None])
        else:
            low = (size * (mx[i] - me[j]) ** 2 + (rx[i] - re[j]) ** 2).sum(1)
            stays = low <= (least + slack)[i]
            i, j = i[stays], j[stays]
        if told is not None:
            told.append(len(i))
        blocks *= 2
    exact = np.full((n, len(book)), np.iinfo(np.int64).max)
    exact[i, j] = ((x[i] - book[j]) ** 2).sum(1)
    if told is not None:
        told.append(len(i))
    best = exact.argmin(1)
    return best, exact[np.arange(n), best]


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, within the bound that keeps sums of squares in a long."""
    most = float(int((2.0**61 / width) ** 0.5)) if width else 0.0
    return np.clip(np.floor(SCALE * _dense(column, width)), -most, most).astype(np.int64)


def _books(starts: list[np.ndarray], width: int) -> np.ndarray:
    """(part, entry, component) of whole vectors."""
    return np.array(starts, np.int64).reshape(len(starts), PARTS, width // PARTS).transpose(1, 0, 2)


def codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """The final entries, by part, entry and component; rows: (vec_id, embedding) of sound vectors."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest ids of a task, each with its smallest vector."""
        held: dict = {}
        for batch in batches:
            x = _whole(batch.column(1), width)
            for i, v in zip(batch.column(0).to_pylist(), x, strict=True):
                key = (i is None, i or 0)
                if key not in held or v.tolist() < held[key]:
                    held[key] = v.tolist()
            held = {k: held[k] for k in sorted(held)[:ENTRIES]}
        yield pa.RecordBatch.from_pydict({"none": pa.array([k[0] for k in held], pa.bool_()), "vec_id": pa.array([k[1] for k in held], pa.int64()), "v": pa.array(list(held.values()), pa.list_(pa.int64()))})

    first = rows.select("vec_id", "embedding").mapInArrow(smallest, "none boolean, vec_id long, v array<long>").groupBy("none", "vec_id").agg(F.min("v").alias("v")).orderBy("none", "vec_id").limit(ENTRIES).collect()
    books = _books([r["v"] for r in first], width)
    for _ in range(ROUNDS):
        sums = _moved(rows, books, width)
        for r in sums:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return books


def _moved(rows: DataFrame, books: np.ndarray, width: int) -> list:
    """(part, entry, place, n, total): what the parts nearest to each entry come to; at most PARTS * ENTRIES * width / PARTS rows."""
    each = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = _whole(batch.column(0), width)
            for p in range(PARTS):
                own = x[:, p * each : (p + 1) * each]
                at, _ = nearest(own, books[p])
                n[p] += np.bincount(at, minlength=books.shape[1])
                np.add.at(total[p], at, own)
        part, entry, place = np.nonzero(np.broadcast_to((n > 0)[:, :, None], books.shape))
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "place": pa.array(place, pa.int32()), "n": pa.array(n[part, entry]), "total": pa.array(total[part, entry, place])})

    told = rows.select("embedding").mapInArrow(run, "part int, entry int, place int, n long, total long")
    return told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def sha256_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is there and finite throughout."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits for each part), error (squared distances summed over parts), label_error (errors of its label), codebooks_sha256."""
    arrow_limits(vectors.sparkSession, 4096)
    rows = sound(vectors)
    width = -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS) * PARTS
    books = codebooks(rows, width)
    each = width // PARTS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(2), width)
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                at, far = nearest(x[:, p * each : (p + 1) * each], books[p])
                codes[:, p], error = at, error + far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = durable(rows.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors", 1 + coded.select("label").distinct().count() // 100_000)
    joined = coded.join(sums.withColumnRenamed("label", "its label"), F.col("label").eqNullSafe(F.col("its label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha256_of(books)).alias("codebooks_sha256"))
