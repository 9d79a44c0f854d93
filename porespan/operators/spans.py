"""Algebra of run lists by sweeping their ends: levels, unions, differences, projections. No voxel is made.

Runs are rows (row keys, x0, x1), both ends inclusive; what makes a row is the caller's choice, e.g. (scan_index, z, y) for masks or
(scan_index, y) to look along z. A run adds +1 where it begins and -1 behind its end; ends at one place are added up before
the shuffle, so a row's window holds as many ends as there are places in a row, however many runs are put on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose presence one long holds.
BITS = 62


def levels(runs: DataFrame, row: list[str], weights: list[str]) -> DataFrame:
    """The places of each row in maximal segments between ends, with the sums of ``weights`` over the runs that cover them:
    ``(row.., x0, x1, weights..)``. Weights are integer columns; segments that no run covers, with every sum 0, are left out."""
    ends = F.explode(F.array(F.struct(F.col("x0").cast("int").alias("x"), F.lit(1).alias("s")), F.struct((F.col("x1") + 1).cast("int").alias("x"), F.lit(-1).alias("s"))))
    steps = runs.select(*row, *weights, ends.alias("e")).groupBy(*row, F.col("e.x").alias("x0")).agg(*[F.sum(F.col(w).cast("long") * F.col("e.s")).alias(w) for w in weights])
    w = Window.partitionBy(*row).orderBy("x0")
    sums = [F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in weights]
    swept = steps.select(*row, "x0", (F.lead("x0").over(w) - 1).alias("x1"), *sums)
    return swept.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in weights])).where("x1 IS NOT NULL")


def merged(segments: DataFrame, row: list[str], values: list[str] | None = None) -> DataFrame:
    """Disjoint segments of a row made maximal: neighbours that touch and agree in ``values`` become one run."""
    values = values or []
    w = Window.partitionBy(*row).orderBy("x0")
    same = reduce(lambda a, b: a & b, [F.lag(v).over(w).eqNullSafe(F.col(v)) for v in values], F.lag("x1").over(w) + 1 == F.col("x0"))
    islands = segments.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*row, *values, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(*row, "x0", "x1", *values)


def tagged(masks: dict[str, DataFrame], row: list[str]) -> DataFrame:
    """Runs of several masks in one frame, with a column for each mask that is 1 on its own runs."""
    one = [m.select(*row, "x0", "x1", *[F.lit(int(n == name)).alias(n) for n in masks]) for name, m in masks.items()]
    return reduce(DataFrame.unionByName, one)


def select(masks: dict[str, DataFrame], row: list[str], where: Column) -> DataFrame:
    """Maximal runs of the places that ``where`` picks by the masks' names, each the number of that mask's runs there."""
    return merged(levels(tagged(masks, row), row, list(masks)).where(where), row)


def union(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    return select({"_a": a, "_b": b}, row, F.lit(True))


def intersection(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    return select({"_a": a, "_b": b}, row, (F.col("_a") > 0) & (F.col("_b") > 0))


def difference(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    return select({"_a": a, "_b": b}, row, (F.col("_a") > 0) & (F.col("_b") == 0))


def exclusive(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    """Places in one of two masks but not in both."""
    return select({"_a": a, "_b": b}, row, (F.col("_a") > 0) != (F.col("_b") > 0))


def overlay(a: DataFrame, b: DataFrame, row: list[str]) -> DataFrame:
    """Runs of two masks with ``value``: 1 in both, 2 only in the first, 3 only in the second."""
    value = F.when((F.col("_a") > 0) & (F.col("_b") > 0), 1).when(F.col("_a") > 0, 2).otherwise(3)
    return merged(levels(tagged({"_a": a, "_b": b}, row), row, ["_a", "_b"]).withColumn("value", value), row, ["value"])


def covered(runs: DataFrame, row: list[str]) -> DataFrame:
    """Places of a row that any run covers, as maximal runs: the projection along whatever the row leaves out."""
    return merged(levels(runs.select(*row, "x0", "x1", F.lit(1).alias("_n")), row, ["_n"]), row)


def greatest_label(runs: DataFrame, row: list[str], label: str = "label") -> DataFrame:
    """Greatest label at each covered place of a row, as maximal runs ``(row.., x0, x1, label)``.

    Each label's cover is one bit, so a running sum of bits says which labels are on; BITS labels to a long. The labels that occur are
    counted first (at most 65,536 with 16-bit voxels)."""
    labels = sorted(r[0] for r in runs.select(label).where(F.col(label).isNotNull()).distinct().collect())  # the volume's alphabet
    each = covered(runs.where(F.col(label).isNotNull()), [*row, label])
    words = {f"_w{i // BITS}": labels[i : i + BITS] for i in range(0, max(1, len(labels)), BITS)}
    bits = [F.coalesce(F.create_map(*[F.lit(x) for i, v in enumerate(held) for x in (v, 1 << i)])[F.col(label)] if held else F.lit(0), F.lit(0)).cast("long").alias(w) for w, held in words.items()]
    swept = levels(each.select(*row, "x0", "x1", *bits), row, list(words))
    back = F.coalesce(*[F.when(F.col(w) > 0, F.element_at(F.array(*map(F.lit, held or [0])), F.length(F.bin(F.col(w))))) for w, held in reversed(words.items())])
    return merged(swept.withColumn("_label", back.cast(runs.schema[label].dataType)), row, ["_label"]).withColumnRenamed("_label", label)


def shared_length(runs: DataFrame, other: DataFrame, row: list[str], keys: list[str]) -> DataFrame:
    """Places that the runs of each of ``keys`` share with disjoint runs ``other(row.., x0, x1)`` of their row: ``(keys.., n)``; keys
    that share none are left out."""
    met = runs.select(*dict.fromkeys([*keys, *row]), "x0", "x1").join(other.select(*row, F.col("x0").alias("_b0"), F.col("x1").alias("_b1")), row).where("x0 <= _b1 AND x1 >= _b0")
    return met.groupBy(*keys).agg(F.sum((F.least("x1", "_b1") - F.greatest("x0", "_b0") + 1).cast("long")).alias("n"))


def places(runs: DataFrame) -> DataFrame:
    """Runs as single places ``x``: for results that are lists of pixels, at the very end."""
    columns = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*columns, F.explode(F.sequence("x0", "x1")).alias("x"))
