"""Vector codes by exact integer codebooks, screened in float32 with rounding-error intervals (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import hot_join, hot_keys
from .common import tidied, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond these bounds count as the bound: every one is a float32, and squared distances of 8,000 components fit 63 bits.
TOP = 1 << 24
#: Unit roundoff of float32; distances that are worked out together.
UNIT, CELLS = 2.0**-24, 1 << 18


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vectors: pa.Array, length: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, within TOP; vectors shorter than ``length`` end in zeros."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale).clip(-TOP, TOP).astype(np.int64)
    out = np.zeros((len(vectors), length), dtype=np.int64)
    out[np.arange(length) < sizes[:, None]] = values
    return out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` to each of ``points``, ties to the lower index, and its squared distance; all exact.

    ``points`` and ``book`` are rows of int64 within TOP, so they are float32 without loss. The products p.e come from a float32
    matrix product; with w components, in whatever order they are summed, each is off by w u / (1 - w u) |p| |e| at most. What
    float64 adds to |e|^2 - 2 p.e is under 2^-50 of its terms. Entries whose interval reaches below the least upper end are worked out again in
    int64, the others can't be nearest."""
    n, w = points.shape
    index, distance = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    norms = (book * book).sum(axis=1)
    book32, lengths = book.astype(np.float32).T, np.sqrt(norms.astype(np.float64))
    relative = w * UNIT / (1 - w * UNIT)
    step = max(1, CELLS // (len(book) * max(w, 1)))
    for at in range(0, n, step):
        p = points[at : at + step]
        dots = (p.astype(np.float32) @ book32).astype(np.float64)
        score = norms - 2 * dots
        own = np.sqrt((p * p).sum(axis=1).astype(np.float64))[:, None]
        half = 2.0001 * relative * own * lengths + 2.0**-50 * (norms + 2 * np.abs(dots))
        near = score - half <= (score + half).min(axis=1)[:, None]
        best = near.argmax(axis=1)  # where one entry is near, that is it
        open_ = np.flatnonzero(near.sum(axis=1) > 1)
        if len(open_):
            r, e = np.nonzero(near[open_])
            exact = np.full((len(open_), len(book)), np.iinfo(np.int64).max)
            exact[r, e] = ((p[open_[r]] - book[e]) ** 2).sum(axis=1)
            best[open_] = exact.argmin(axis=1)  # the first of equal ones
        index[at : at + step], distance[at : at + step] = best, ((p - book[best]) ** 2).sum(axis=1)
    return index, distance


def first_books(kept: DataFrame, length: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ties by vector: at most ``entries`` rows come to the driver."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    whole = integers(rows.column(0).combine_chunks(), length, scale)
    return whole.reshape(len(whole), parts, length // parts).transpose(1, 0, 2)


def refined(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round: each entry the floor of its parts' mean, an unused one unchanged.

    A task adds up what it assigns; sums of one entry, part and component are all that is shuffled, and one codebook comes back."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            x = integers(batch.column(0), parts * width, scale)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                index, _ = nearest(mine, books[p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, mine)
        p, e = np.nonzero(count)
        sums = pa.array(list(total[p, e]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    partial = kept.select("v").mapInArrow(tidied(run), "part int, entry int, n long, sums array<long>")
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # a row for each entry of a part
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(key, label, code, error, label_error, codebooks_sha256)`` of every usable vector.

    Rows whose vector is null or has a null or non-finite component are dropped. Components become floor(scale * x), taken as
    +-TOP beyond it. Vectors are filled up with zeros to the longest one's length, and that to a multiple of ``parts``. Codebooks start from the smallest
    keys (null keys last, equal keys by vector) and are refined ``rounds`` times; with fewer vectors than ``entries`` they are
    as much shorter. Repeated rows and rows without a key are coded one by one; null labels are a label of their own; a label whose errors don't fit
    63 bits has a null sum. No usable vectors, no rows.

    The table is read once for the length, once for the first codebooks and once for each round, and coded in a last pass;
    what tasks get is one codebook, parts * entries * width integers whatever the number of vectors."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    books = first_books(kept, parts * width, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = refined(kept, books, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), parts * width, scale)
            code, error = np.full(len(x), "", dtype=f"<U{2 * parts}"), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                index, distance = nearest(x[:, p * width : (p + 1) * width], books[p])
                code, error = np.char.add(code, digits[index]), error + distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code.tolist(), pa.string()), pa.array(error)], ["id", "l", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = written(kept.mapInArrow(tidied(run), f"id {kinds['id']}, l {kinds['l']}, code string, error long"), "codes")
    coded = coded.withColumns({"_none": F.col("l").isNull(), "_text": F.coalesce(F.col("l").cast("string"), F.lit(""))}).withColumn("_key", F.xxhash64("_none", "_text"))
    sums = coded.groupBy("_key", "_none", "_text").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    hot = hot_keys(sums, "_key", "n")  # a label may hold a third of all rows
    out = hot_join(coded, sums.drop("n"), "_key", hot, ("_none", "_text"))
    return out.select(F.col("id").alias(key), F.col("l").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
