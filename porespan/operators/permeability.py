"""Relative permeability tables, error bars, curve forms and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import K_REFERENCE
from ..functions.names import darcy, millidarcy
from ..scratch import checkpointed
from .quantiles import percentiles, same

TRACK = ["run_id", "track_id", "connectivity", "simulator"]


def kr_table(results: DataFrame) -> DataFrame:
    """kr = K of the phase over the track's K_abs, which holds for all scans; null where K_abs is missing or 0."""
    kabs = results.where("sim_type = 'absolute'").groupBy(*TRACK).agg(F.max("k_z").alias("k_abs"))
    return results.where("sim_type <> 'absolute'").join(kabs, TRACK, "left").withColumn("kr", F.try_divide("k_z", F.nullif("k_abs", F.lit(0.0))))


def kr_wide(results: DataFrame) -> DataFrame:
    """One row a track and scan, with gas and brine side by side."""
    k = kr_table(results)
    pick = lambda t: F.max(F.when(F.col("sim_type") == t, F.col("kr")))
    return k.groupBy(*TRACK, "scan_index").agg(F.max("sw").alias("sw"), pick("gas").alias("kr_gas"), pick("water").alias("kr_brine"))


def back_fill(results: DataFrame, simulator: str) -> DataFrame:
    """The results with kr of one simulator's phases filled from the track's K_abs in that run, whatever the connectivity; where
    several connectivities have a positive one, the greatest of them."""
    kabs = results.where((F.col("simulator") == simulator) & (F.col("sim_type") == "absolute") & (F.col("k_z") > 0)).groupBy("run_id", "track_id").agg(F.max("k_z").alias("_k"))
    mine = (F.col("simulator") == simulator) & (F.col("sim_type") != "absolute") & F.col("_k").isNotNull()
    return results.join(kabs, ["run_id", "track_id"], "left").withColumn("kr", F.when(mine, F.col("k_z") / F.col("_k")).otherwise(F.col("kr"))).select(*results.columns)


def write_back(results: DataFrame, wide: DataFrame) -> DataFrame:
    """The results with the points' kr on the rows of their phases, for every simulator; null kr changes nothing."""
    key = ["run_id", "scan_index", "track_id", "connectivity"]
    sides = F.explode(F.array(*[F.struct(F.lit(t).alias("sim_type"), F.col(c).alias("kr")) for t, c in (("gas", "kr_gas"), ("water", "kr_brine"))]))
    new = wide.select(*key, sides.alias("p")).select(*key, "p.sim_type", F.col("p.kr").alias("_kr")).where("_kr IS NOT NULL")
    return results.join(new, [*key, "sim_type"], "left").withColumn("kr", F.coalesce("_kr", "kr")).select(*results.columns)


def complete_cases(wide: DataFrame, outliers: list[int] | None = None) -> DataFrame:
    """Rows with saturation and both phases, without the tracks named as outliers."""
    return wide.where("sw IS NOT NULL AND kr_gas IS NOT NULL AND kr_brine IS NOT NULL").where(~F.col("track_id").isin(outliers or []) if outliers else F.lit(True))


def per_timestep(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of saturation and both phases, by scan."""
    return wide.groupBy(*keys, "scan_index").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in ("sw", "kr_gas", "kr_brine") for p, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def error_bars(points: DataFrame, keys: list[str], value: str, snr: float = 0.39) -> DataFrame:
    """Bars of a scan's points: their range, of lone or equal points the median of the positive ranges (1e-6 if none);
    50 times that beyond the residual saturation 1 - snr. Adds ``sigma``."""
    scan = [*keys, "scan_index"]
    ranges = points.groupBy(*scan).agg((F.max(value) - F.min(value)).alias("_r"))
    middle = percentiles(ranges.where("_r > 0"), keys, "_r", {"_m": 0.5})
    r, m = ranges.withColumnsRenamed({k: f"_{k}" for k in scan}), middle.withColumnsRenamed({k: f"__{k}" for k in keys})
    p = points.join(r, same(scan, "", "_"), "left").join(m, same(keys, "", "__"), "left")
    bar = F.when(F.col("_r") > 0, F.col("_r")).otherwise(F.coalesce("_m", F.lit(1e-6)))
    return p.withColumn("sigma", bar * F.when(F.col("sw") > 1 - snr, 50.0).otherwise(1.0)).select(*points.columns, "sigma")


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def gas_base(sw: Column, swc: float = 0.0, snr: float = 0.39) -> Column:
    return clip01((1 - sw - snr) / (1 - swc - snr))


def brine_base(sw: Column, swc: float = 0.0, snr: float = 0.39) -> Column:
    return clip01((sw - swc) / (1 - swc - snr))


def corey(base: Column, k0: float, n: float, c: float = 0.0) -> Column:
    """Corey curve k0 b^n + c / (1 + c) b; the basic form has c = 0."""
    return k0 * F.pow(base, F.lit(n)) + F.lit(c / (1 + c)) * base


def kabs_summary(results: DataFrame, reference: float = K_REFERENCE) -> DataFrame:
    """Absolute permeability by track in m2, mD and D, with its deviation from a reference in per cent."""
    a = results.where("sim_type = 'absolute'")
    return a.select(*TRACK, F.col("k_z").alias("k_m2"), millidarcy(F.col("k_z")).alias("k_md"), darcy(F.col("k_z")).alias("k_d"), (100 * (F.col("k_z") - reference) / reference).alias("dev_reference"), (100 * (F.col("k_z") / F.avg("k_z").over(Window.partitionBy("run_id", "simulator")) - 1)).alias("dev_mean"))


#: Saturations in a range of the nearest-saturation join: what one task sorts.
RANGE_ROWS = 500_000


def nearest_points(ours: DataFrame, theirs: DataFrame, value: str, order: str, rows: int | None = None) -> DataFrame:
    """For each distinct ``value`` of ours the row of ``theirs(value, order, ..)`` whose value is nearest: ``(value, near)``. Between the one
    below and the one above a tie, to 12 decimals, goes to the lower ``order``, as it does among equal values.

    Both sides are sorted in ranges of about ``rows`` values, cut at approximate quantiles. In a range the last row of theirs before a
    value and the first one after it are its neighbours; where a range has none they are carried over from the ranges beside
    it. Nulls of either side are left out; with no rows of theirs ``near`` is null."""
    rows = rows or RANGE_ROWS
    mine = ours.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")).distinct()
    row = F.struct(*theirs.columns)
    base = theirs.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.min_by(row, F.col(order)).alias("_b"))
    line = checkpointed(base.select("_v", "_b", F.lit(0).alias("_own")).unionByName(mine.select("_v", F.lit(None).cast(base.schema["_b"].dataType).alias("_b"), F.lit(1).alias("_own"))))
    ranges = max(1, -(-line.count() // rows))
    cuts = sorted(set(line.approxQuantile("_v", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_v"))) if cuts else F.lit(0)
    line = line.withColumn("_part", part)
    # the least and greatest row of theirs in each range: a row a range
    edges = line.where("_own = 0").groupBy("_part").agg(F.min_by("_b", "_v").alias("_first"), F.max_by("_b", "_v").alias("_last"))
    w = Window.orderBy("_part")
    carried = line.select("_part").distinct().join(edges, "_part", "left").select("_part", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_to"))
    in_part = Window.partitionBy("_part").orderBy("_v", "_own")
    below = F.last("_b", True).over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_b", True).over(in_part.rowsBetween(0, Window.unboundedFollowing))
    found = line.withColumns({"_below": below, "_above": above}).where("_own = 1").join(F.broadcast(carried), "_part")
    far = lambda b: F.when(b.isNotNull(), F.struct(F.round(F.abs(b[value] - F.col("_v")), 12).alias("d"), b[order].alias("o"), b.alias("b")))
    sides = F.array_compact(F.array(far(F.coalesce("_below", "_from")), far(F.coalesce("_above", "_to"))))
    return found.select(F.col("_v").alias(value), F.array_min(sides)["b"].alias("near"))


def nearest_saturation(ours: DataFrame, theirs: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """For each of our rows the baseline row with the nearest saturation, and the deviations in per cent.

    Rows may share one; ties, to 12 decimals, go to the lower ``ordinal``. Deviations from 0 or null are null. Rows of one
    saturation meet its neighbours by a join on it."""
    near = nearest_points(ours, theirs.select("ordinal", "sw", "kr_gas", "kr_brine"), "sw", "ordinal", rows)
    n = ours.where("sw IS NOT NULL").withColumn("_v", F.col("sw").cast("double")).join(near.select(F.col("sw").alias("_v"), F.col("near").alias("n")), "_v", "left")
    dev = lambda c: 100 * F.try_divide(F.col(c) - F.col(f"n.{c}"), F.nullif(F.col(f"n.{c}"), F.lit(0.0)))
    return n.select(*keys, "sw", F.col("n.ordinal").alias("ordinal"), F.col("n.sw").alias("sw_baseline"), dev("kr_gas").alias("dev_gas"), dev("kr_brine").alias("dev_brine"))


def rev_effect(boxes: DataFrame, results: DataFrame) -> DataFrame:
    """Correlation and trend of box extent against K_abs, with and without outliers beyond 1.5 interquartile ranges."""
    one = F.row_number().over(Window.partitionBy("run_id", "track_id", "connectivity").orderBy(F.col("is_x").cast("int").desc(), "scan_index"))
    b = boxes.withColumn("_r", one).where("_r = 1").select("run_id", "track_id", "connectivity", "extent_z")
    p = b.join(results.where("sim_type = 'absolute'"), ["run_id", "track_id", "connectivity"]).select("run_id", "simulator", F.col("extent_z").cast("double").alias("x"), millidarcy(F.col("k_z")).alias("y"))
    keys = ["run_id", "simulator"]
    q = percentiles(p, keys, "y", {"q1": 0.25, "q3": 0.75})
    i = p.join(q, keys).withColumn("inlier", F.col("y").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    part = lambda c: [F.count(F.when(c, F.col("y"))), F.corr(F.when(c, F.col("x")), F.when(c, F.col("y"))), F.regr_slope(F.when(c, F.col("y")), F.when(c, F.col("x")))]
    names = ("n", "r", "slope")
    return i.groupBy(*keys).agg(*[a.alias(f"{n}_all") for n, a in zip(names, part(F.lit(True)), strict=True)], *[a.alias(f"{n}_inliers") for n, a in zip(names, part(F.col("inlier")), strict=True)])


def cross_solver(results: DataFrame, first: str, second: str, within: float = 20.0) -> DataFrame:
    """Deviation of one simulator's permeability from another's, per result, in per cent; both in m2."""
    keys = ["run_id", "scan_index", "track_id", "connectivity", "sim_type"]
    side = lambda s, n: results.where(F.col("simulator") == s).select(*keys, F.col("k_z").alias(n))
    j = side(first, "k_first").join(side(second, "k_second"), keys).withColumn("deviation", 100 * F.try_divide(F.col("k_second") - F.col("k_first"), F.nullif("k_first", F.lit(0.0))))
    return j.withColumn("within", F.abs("deviation") <= within)


def curve_rmse(points: DataFrame, value: str, curve: Column) -> DataFrame:
    return points.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col(value) - curve, F.lit(2.0)))).alias("rmse"))
