"""Three-segment regime fit of a saturation series, and the time step that it selects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _indexed(points: DataFrame, keys: list[str], origin: bool) -> DataFrame:
    """One row a series: its points (i, x, y) in the order of scan_index; points without x or y take no part."""
    ok = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("scan_index", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    if origin:
        pts = F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), pts)
    return ok.groupBy(*keys).agg(pts.alias("p"))  # a series has some tens of scans


def segments(points: DataFrame, keys: list[str], origin: bool = True) -> DataFrame:
    """Least-squares line through the points a .. b of each series: sse, slope and intercept, for all a <= b.

    Without variance in x the slope is null and the error that about the mean."""
    s = _indexed(points, keys, origin).withColumn("a", F.explode(F.sequence(F.lit(0), F.size("p") - 1))).withColumn("b", F.explode(F.sequence(F.col("a"), F.size("p") - 1)))
    one = s.select(*keys, "a", "b", F.explode(F.slice("p", F.col("a") + 1, F.col("b") - F.col("a") + 1)).alias("q"))
    y, x = F.col("q.y"), F.col("q.x")
    g = one.groupBy(*keys, "a", "b").agg(F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    return g.select(*keys, "a", "b", F.greatest(F.lit(0.0), F.col("syy") - F.coalesce(slope * F.col("sxy"), F.lit(0.0))).alias("sse"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def three_segments(points: DataFrame, keys: list[str], share_breakpoints: bool = True, origin: bool = True) -> DataFrame:
    """The best pair of breakpoints of each series ``points(keys, scan_index, x, y)``: i, j, bp1, bp2, sse, three slopes.

    All pairs are tried. Shared: lines through [0..i], [i..j], [j..end], i from 1 to n - 3, j from i + 1 to n - 2, the breakpoints
    being points. Disjoint: [0..i-1], [i..j-1], [j..end] of two points or more, the breakpoints halfway between neighbours.
    Ties, to 12 decimals, go to the lower i, then j. Series too short for it give no row."""
    seg = segments(points, keys, origin)
    base = _indexed(points, keys, origin).withColumn("n", F.size("p"))
    step = 0 if share_breakpoints else 1
    if share_breakpoints:
        ij = base.where("n >= 4").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 3))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 2)))
    else:
        ij = base.where("n >= 6").withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n") - 4))).withColumn("j", F.explode(F.sequence(F.col("i") + 2, F.col("n") - 2)))
    side = lambda name: seg.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("a").alias(f"_{name}_a"), F.col("b").alias(f"_{name}_b"), F.col("sse").alias(f"sse_{name}"), F.col("slope").alias(f"slope_{name}"))

    def meet(df: DataFrame, name: str, a, b) -> DataFrame:
        on = (F.col(f"_{name}_a") == a) & (F.col(f"_{name}_b") == b)
        for k in keys:
            on &= F.col(k) == F.col(f"_{name}_{k}")
        return df.join(side(name), on)

    j = meet(ij, "1", F.lit(0), F.col("i") - step)
    j = meet(j, "2", F.col("i"), F.col("j") - step)
    j = meet(j, "3", F.col("j"), F.col("n") - 1)
    at = lambda c: F.element_at("p", F.col(c) + 1)["x"] if share_breakpoints else (F.element_at("p", F.col(c))["x"] + F.element_at("p", F.col(c) + 1)["x"]) / 2
    full = j.select(*keys, "i", "j", (F.col("sse_1") + F.col("sse_2") + F.col("sse_3")).alias("sse"), at("i").alias("bp1"), at("j").alias("bp2"), F.col("slope_1").alias("slope1"), F.col("slope_2").alias("slope2"), F.col("slope_3").alias("slope3"))
    best = F.min_by(F.struct(*[c for c in full.columns if c not in keys]), F.struct(F.round("sse", 12), "i", "j"))
    return full.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def timestep_x(points: DataFrame, fit: DataFrame, keys: list[str], cutoff: str = "displacement", override: float | None = None, min_scans: int = 3) -> DataFrame:
    """The last scan at or before the cutoff, per series: ``(keys, cutoff, x_scan)``.

    The cutoff is bp1 (displacement), bp2 (transition) or ``override``. Without a fit, with fewer than ``min_scans`` scans, or
    with none before the cutoff, it is the last scan."""
    value = F.lit(override) if override is not None else F.col("bp1" if cutoff == "displacement" else "bp2")
    j = points.join(fit.select(*keys, value.alias("cutoff")), keys, "left")
    g = j.groupBy(*keys).agg(F.first("cutoff").alias("cutoff"), F.max("scan_index").alias("last"), F.max(F.when(F.col("x") <= F.col("cutoff"), F.col("scan_index"))).alias("within"), F.count("x").alias("n"))
    return g.select(*keys, "cutoff", F.when(F.col("n") >= min_scans, F.coalesce("within", "last")).otherwise(F.col("last")).alias("x_scan"))


def mark_scans(points: DataFrame, step: DataFrame, keys: list[str]) -> DataFrame:
    """qualifying (by index, whatever x) and is_x of each scan."""
    return points.join(F.broadcast(step.select(*keys, "x_scan")), keys).withColumns({"qualifying": F.col("scan_index") <= F.col("x_scan"), "is_x": F.col("scan_index") == F.col("x_scan")}).drop("x_scan")


def regime_tags(points: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """D up to bp1, T up to bp2, X beyond."""
    return points.join(F.broadcast(fit.select(*keys, "bp1", "bp2")), keys).withColumn("regime", F.when(F.col("x") <= F.col("bp1"), "D").when(F.col("x") <= F.col("bp2"), "T").otherwise("X")).drop("bp1", "bp2")


def align_reference(scans: DataFrame, reference: DataFrame) -> DataFrame:
    """Join reference rows (row_number, name, sg, elapsed_minutes) to scans(scan_index, file_name) by numeric prefix.

    Of rows with the same prefix the last counts. Scans without one keep nulls; sw_ref is 1 - sg."""
    from ..functions.names import scan_prefix

    ref = reference.withColumn("_p", scan_prefix(F.col("name"))).where("_p <> ''")
    ref = ref.groupBy("_p").agg(F.max_by(F.struct("sg", "elapsed_minutes"), "row_number").alias("r"))
    return scans.withColumn("_p", scan_prefix(F.col("file_name"))).join(ref, "_p", "left").select(*scans.columns, F.col("r.elapsed_minutes").alias("elapsed_minutes"), (1 - F.col("r.sg")).alias("sw_ref"))
