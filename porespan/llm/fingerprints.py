"""One-permutation MinHash fingerprints with optimal densification (operator 7, DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, split_words

#: Words in a shingle, bins of the fingerprint (a power of two), low-order bits kept of each bin (one hex digit).
SHINGLE, BINS, BITS = 5, 128, 4
SEED = 7
#: About so many documents share a bucket when each is paired with the next one, and more when there would be over MOST_BUCKETS.
BUCKET_DOCS, MOST_BUCKETS = 500, 1 << 15


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """Add ``out``, the fingerprint of the whole text: one hex digit for each bin.

    Every shingle of lower-cased (A-Z) words is hashed once; the high bits of the hash name its bin, and the bin keeps its
    least hash. An empty bin copies the filled bin that comes first in its probe order, which a hash of the pair of bins
    gives: an independent, uniform choice for each bin, alike for all documents. Texts with fewer words than a shingle
    are one shingle; texts without words (null, empty, blank) have the empty string. Equal texts have equal fingerprints.
    """
    low = 63 - (bins.bit_length() - 1)  # of 63 non-negative bits, those below the bin's number
    w = df.withColumn("_w", split_words(ascii_lower(F.col(text))))
    hashes = F.when(F.size("_w") >= shingle, F.transform(F.sequence(F.lit(1), F.size("_w") - (shingle - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("_w", i, shingle)), 1)))
    hashes = hashes.when(F.size("_w") > 0, F.array(F.shiftrightunsigned(F.xxhash64("_w"), 1))).otherwise(F.array().cast("array<bigint>"))
    # sorted, the hashes of a bin follow each other, its least first
    ordered = w.withColumn("_h", F.sort_array(hashes))
    number = lambda h: F.shiftright(h, low).cast("int")
    least = ordered.withColumn("_m", F.filter("_h", lambda h, i: (i == 0) | (number(F.get("_h", i - 1)) != number(h))))
    filled = least.withColumns({"_b": F.transform("_m", number), "_v": F.transform("_m", lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))})
    at = lambda b: F.array_position("_b", b).cast("int")  # noqa: E731  0: empty

    def donor(b: Column) -> Column:
        return F.array_min(F.transform("_b", lambda j: F.struct(F.xxhash64(F.lit(seed), b, j).alias("h"), j.alias("j"))))["j"]

    value = lambda b: F.get("_v", F.when(at(b) > 0, at(b) - 1).otherwise(at(donor(b)) - 1))
    digits = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.lower(F.hex(value(b))))
    return filled.withColumn(out, F.when(F.size("_h") > 0, F.array_join(digits, "")).otherwise("")).drop("_w", "_h", "_m", "_b", "_v")


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints: equal digits, less those that agree by chance (2**-BITS).

    1 for equal fingerprints, two empty ones included; 0 where only one is empty; always from 0 to 1."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 2.0**-BITS
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance)))


def _buckets(df: DataFrame, key: str, order: str, bucket_docs: int) -> tuple[Column, Column]:
    """Numbers (first, second) of buckets that ascend with the key, nulls first, and with ``order`` (a hash) among equal keys.

    The quantiles of the keys bound them, whatever their distribution; of a key that holds several quantiles, and of the null key, the
    rows are parted by ``order``. No more than MOST_BUCKETS quantiles, and as many parts of the null key."""
    n, every = df.agg(F.count(key), F.count(F.lit(1))).first()
    parts = lambda rows: min(MOST_BUCKETS, -(-rows // bucket_docs))
    bounds = []
    if parts(n) > 1:
        shares = F.split(F.lit(",".join(repr(i / parts(n)) for i in range(1, parts(n)))), ",").cast("array<double>")
        bounds = df.agg(F.percentile_approx(key, shares, 8 * MOST_BUCKETS)).first()[0]
    step = max(1, math.isqrt(len(bounds)))
    listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") if x else F.array().cast("array<bigint>")
    k = F.col(key)

    def count(fits: Callable[[Column], Column]) -> Column:
        """Of the ascending bounds so many fit: looked up by every ``step``-th one, then among the ``step`` from there on."""
        block = F.size(F.filter(listed(bounds[::step]), fits)) - 1
        return F.when(block < 0, F.lit(0)).otherwise(block * step + F.size(F.filter(F.slice(listed(bounds), block * step + 1, step), fits)))

    up_to, below = count(lambda b: b <= k), count(lambda b: b < k)
    m = F.when(k.isNull(), F.lit(max(1, parts(every - n)))).when(up_to - below > 1, up_to - below).otherwise(0).cast("long")
    place = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63))), 33)  # 31 bits that ascend with the hash
    return F.when(k.isNull(), F.lit(-1)).otherwise(up_to).cast("int"), (F.shiftright(place * m, 31) - m).cast("int")


def with_next(df: DataFrame, key: str, value: str, derived: list[str], bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Add to every row the next row's ``value`` and ``derived`` columns, by ascending ``key``, as ``_next_`` and their names.

    The last row's next is the first one. Nulls come first; rows with equal keys follow each other by their values' hashes. Rows are
    dealt to buckets of neighbouring keys, and each bucket's first row, marked as an extra one, also to the bucket before; so
    values move once. Which rows these are follows from keys and hashes alone, a table of MOST_BUCKETS rows or twice as many
    that every task gets. Rows alike in key and value share a bucket. One row is its own next.
    """
    hashed = df.withColumn("_o", F.xxhash64(value))
    first, second = _buckets(df, key, "_o", bucket_docs)
    placed = hashed.withColumns({"_b1": first, "_b2": second})
    least = F.min(F.struct(F.col(key).isNotNull(), F.col(key).alias("k"), F.col("_o").alias("o"))).alias("_k")
    heads = placed.groupBy("_b1", "_b2").agg(least)
    along = Window.orderBy("_b1", "_b2")  # a row for each bucket
    last = F.last(F.struct("_b1", "_b2")).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_b1").alias("_h1"), F.col("_b2").alias("_h2"), F.col("_k.k").alias("_hk"), F.col("_k.o").alias("_ho"), F.coalesce(F.lag(F.struct("_b1", "_b2")).over(along), last).alias("_before"))
    met = placed.join(F.broadcast(heads), (F.col("_b1") == F.col("_h1")) & (F.col("_b2") == F.col("_h2")))  # bounded by MOST_BUCKETS
    own = F.struct(F.lit(False).alias("extra"), F.col("_b1").alias("b1"), F.col("_b2").alias("b2"))
    before = F.struct(F.lit(True).alias("extra"), F.col("_before._b1").alias("b1"), F.col("_before._b2").alias("b2"))
    is_head = F.col(key).eqNullSafe(F.col("_hk")) & (F.col("_o") == F.col("_ho"))
    dealt = met.select(*df.columns, "_o", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))).alias("_t"))
    inside = Window.partitionBy("_t.b1", "_t.b2").orderBy("_t.extra", F.col(key).asc_nulls_first(), "_o", value)
    taken = [value, *derived]
    rows = dealt.withColumn("_next", F.lead(F.struct(*taken)).over(inside)).where(~F.col("_t.extra"))
    return rows.select(*df.columns, *[F.col(f"_next.{c}").alias(f"_next_{c}") for c in taken])


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    cut = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with the likeness of both and that to the next document's.

    Null texts count as empty. Rows with null keys come before all others; an empty table gives an empty result. Texts
    are moved once, to meet the next document; columns other than key and text take no part.
    """
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    pairs = with_next(with_fingerprint(base, "_text", "fingerprint"), key, "_text", ["fingerprint"])
    pairs = pairs.withColumn("_edit", edited(F.col("_text"), F.col("_next__text")))
    both = with_fingerprint(pairs.select(key, F.char_length("_text").cast("long").alias("n_chars"), "_edit", "fingerprint", "_next_fingerprint"), "_edit", "edited_fingerprint")
    return both.select(
        key, "n_chars", F.sha2(F.col("_edit").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next"),
    )
