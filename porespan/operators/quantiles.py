"""Exact percentiles of groups of any size, by narrowing histograms: no group is ever in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed

#: Bins of a round's histogram; rows of a range that are ranked at last; rows of the state up to which it is broadcast.
BINS, FEW, SMALL = 4096, 20_000, 100_000
LARGEST = 1.7976931348623157e308


def same(columns: list[str], a: str, b: str) -> Column:
    """Equality of prefixed columns, nulls equal."""
    return reduce(lambda p, q: p & q, [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in columns], F.lit(True))


def place(v: Column, low: Column, high: Column) -> Column:
    """Where a value lies in its range, from 0 to 1 and never falling: by its logarithm (with its sign, from 1e-300 on) where the range spans
    magnitudes, so that one round leaves ranges of like numbers, else by the value. Both ends of a range are always apart."""
    log = lambda x: F.signum(x) * F.greatest(F.log(F.greatest(F.abs(x), F.lit(1e-300))) + 690.7755278982137, F.lit(0.0))
    share = lambda f, by: (f(v) * by - f(low) * by) / (f(high) * by - f(low) * by)
    same_ = lambda x: x
    wide = (F.least(F.abs(low), F.abs(high)) < F.greatest(F.abs(low), F.abs(high)) / 4) | (F.signum(low) != F.signum(high))
    return F.when(wide & (log(low) < log(high)), share(log, 1.0)).when(high / 2 - low / 2 > 1e300, share(same_, 0.5)).otherwise(share(same_, 1.0))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(keys.., names of shares)``: of each group the exact percentiles of ``value``, interpolated between neighbours.

    Nulls and NaN are left out, a group of nothing else has no row; infinities count as the largest numbers; null keys make a group.
    A percentile lies between two ranks. All ranks start in their group's whole range. A round counts the rows of each open range in
    BINS bins, which tasks add up before the shuffle, and each rank moves to the bin that holds it, tightened to the
    least and greatest value there. A range of one value is settled; when no open range has more than FEW rows, those few are
    ranked. ``rows`` is read once a round: two or three rounds for most data, seven at most, as 64-bit numbers have no more digits."""
    number = F.col(value).cast("double")
    v = rows.where(number.isNotNull() & ~F.isnan(number)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.least(F.greatest(number, F.lit(-LARGEST)), F.lit(LARGEST)).alias("__v"))
    base = v.groupBy(*[f"_{k}" for k in keys]).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).withColumnsRenamed({f"_{k}": k for k in keys})
    position = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("__name"), F.lit(side).alias("__side"), F.least(F.floor(position(p)) + side, F.col("__n") - 1).alias("__k"), (position(p) - F.floor(position(p))).alias("__frac")) for name, p in shares.items() for side in (0, 1)]))
    state = checkpointed(base.withColumn("r", ranks).select(*keys, "r.*", "__lo", "__hi", "__n"))
    cell = [*keys, "__lo", "__hi"]

    def in_ranges() -> DataFrame:
        open_ = state.where("__lo < __hi").select(*cell).distinct()
        met = F.broadcast(open_) if open_.limit(SMALL + 1).count() <= SMALL else open_
        return v.join(met, same(keys, "_", "") & F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(*cell, "__v")

    def moved(found: DataFrame) -> DataFrame:
        """Ranks in the parts ``found(cell.., __before, __m, __a, __b)`` of their ranges, settled ones as they are."""
        parts = found.withColumnsRenamed({c: f"_{c}" for c in cell})
        met = state.where("__lo < __hi").join(parts, same(cell, "", "_") & (F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__m")))
        return checkpointed(state.where("__lo = __hi").unionByName(met.select(*keys, "__name", "__side", (F.col("__k") - F.col("__before")).alias("__k"), "__frac", F.col("__a").alias("__lo"), F.col("__b").alias("__hi"), F.col("__m").alias("__n"))))

    while most := state.where("__lo < __hi").agg(F.max("__n")).first()[0]:
        if most <= FEW:
            ranked = in_ranges().withColumn("__before", (F.row_number().over(Window.partitionBy(*cell).orderBy("__v")) - 1).cast("long"))
            state = moved(ranked.select(*cell, "__before", F.lit(1).cast("long").alias("__m"), F.col("__v").alias("__a"), F.col("__v").alias("__b")))
        else:
            bins = in_ranges().withColumn("__bin", F.least(F.floor(place(F.col("__v"), F.col("__lo"), F.col("__hi")) * BINS), F.lit(BINS - 1))).groupBy(*cell, "__bin").agg(F.count("*").alias("__m"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
            before = F.coalesce(F.sum("__m").over(Window.partitionBy(*cell).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            state = moved(bins.withColumn("__before", before))
    pick = lambda name, side: F.max(F.when((F.col("__name") == name) & (F.col("__side") == side), F.col("__lo")))
    frac = lambda name: F.max(F.when(F.col("__name") == name, F.col("__frac")))
    between = {name: F.when(frac(name) == 0, pick(name, 0)).otherwise(pick(name, 0) * (1 - frac(name)) + pick(name, 1) * frac(name)) for name in shares}
    return state.groupBy(*keys).agg(*[c.alias(name) for name, c in between.items()])
