"""Voxel analytics on runs: counts, profiles, crops, boxes, projections, downsampling, domains, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BRINE, GAS
from . import spans
from .runs import length


def label_histogram(runs: DataFrame) -> DataFrame:
    """Voxels of each label that occurs, per scan."""
    return runs.groupBy("scan_index", "label").agg(F.sum(length()).alias("n"))


def sw_series(runs: DataFrame, gas: int = GAS) -> DataFrame:
    """Gas and brine voxels and the saturation brine / (brine + gas) of each scan; null where there is neither."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("label") == v, length())), F.lit(0)).cast("long")
    c = runs.groupBy("scan_index").agg(n(gas).alias("gas"), n(BRINE).alias("brine"))
    return c.withColumn("sw", F.try_divide(F.col("brine").cast("double"), F.col("brine") + F.col("gas")))


def x_density(runs: DataFrame) -> DataFrame:
    """Voxels with a label in each x column: a running sum over the ends of runs, not over their voxels."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d"))))
    steps = runs.where("label > 0").select("scan_index", ends.alias("e")).groupBy("scan_index", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("scan_index").orderBy("x")
    level = steps.select("scan_index", "x", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("x").over(w).alias("to"))
    return level.where("to IS NOT NULL").select("scan_index", F.explode(F.sequence("x", F.col("to") - 1)).alias("x"), "n")


def x_shift(runs: DataFrame, nx: int, least: float = 0.05) -> DataFrame:
    """Columns by which each scan is rolled left to undo a wrap-around in x: ``(scan_index, shift)``, 0 for none.

    A column is above where its density exceeds ``least`` of the densest. Where columns above come before the first gap,
    the shift is the first column above after that gap."""
    d = x_density(runs).withColumn("above", F.col("n") > least * F.max("n").over(Window.partitionBy("scan_index")))
    a = d.where("above").groupBy("scan_index").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # nx values at most
    gap = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(nx - 1)), lambda x: ~F.array_contains("xs", x)))
    after = F.array_min(F.filter("xs", lambda x: x > gap))
    return a.select("scan_index", F.when(gap.isNull() | (gap == 0), 0).otherwise(F.coalesce(after, gap)).cast("int").alias("shift"))


def roll_x(runs: DataFrame, shifts: DataFrame, nx: int) -> DataFrame:
    """Roll every scan left by its shift; a run that crosses the border becomes two."""
    r = runs.join(F.broadcast(shifts), "scan_index", "left").withColumn("s", F.coalesce("shift", F.lit(0)))  # one row a scan
    a, b = F.pmod(F.col("x0") - F.col("s"), F.lit(nx)), F.pmod(F.col("x1") - F.col("s"), F.lit(nx))
    part = lambda x, y: F.struct(x.cast("int").alias("x0"), y.cast("int").alias("x1"))
    parts = F.when(a <= b, F.array(part(a, b))).otherwise(F.array(part(F.lit(0), b), part(a, F.lit(nx - 1))))
    return r.select("scan_index", "z", "y", F.explode(parts).alias("p"), "label").select("scan_index", "z", "y", "p.x0", "p.x1", "label")


def z_profile(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels of each key in each slice that has any."""
    return runs.groupBy(*keys, "z").agg(F.sum(length()).alias("area"))


def flow_crop(profile: DataFrame, keys: list[str], fraction: float = 0.10) -> DataFrame:
    """Half-open z range from the first to the last slice with ``fraction`` of the peak area; slices between may have less."""
    peak = F.max("area").over(Window.partitionBy(*keys))
    return profile.withColumn("p", peak).where(F.col("area") >= F.col("p") * fraction).groupBy(*keys).agg(F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"))


def centre_of_gravity(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean voxel position, by closed-form sums over runs."""
    n = length()
    mean = lambda c: F.sum(n * c) / F.sum(n)
    return runs.groupBy(*keys).agg(F.sum(n).alias("n"), mean(F.col("z")).alias("cog_z"), mean(F.col("y")).alias("cog_y"), mean((F.col("x0") + F.col("x1")) / 2).alias("cog_x"))


def bounding_boxes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open bounds of each key."""
    return runs.groupBy(*keys).agg(F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), (F.max("x1") + 1).alias("x1"))


def stride_sample(runs: DataFrame, step: int) -> DataFrame:
    """Voxels whose coordinates are multiples of ``step``; of a run only those are made."""
    first = F.ceil(F.col("x0") / step).cast("int") * step
    hit = runs.where((F.col("z") % step == 0) & (F.col("y") % step == 0)).withColumn("_f", first).where("_f <= x1")
    return hit.select("scan_index", "z", "y", F.explode(F.sequence(F.col("_f"), F.col("x1"), F.lit(step))).alias("x"), "label")


def block_any(runs: DataFrame, step: int, gas: int = GAS) -> DataFrame:
    """Blocks of ``step`` voxels an edge that have a gas voxel; a run marks its blocks without its voxels being made."""
    spans = F.sequence(F.floor(F.col("x0") / step), F.floor(F.col("x1") / step))
    return runs.where(F.col("label") == gas).select("scan_index", F.floor(F.col("z") / step).cast("int").alias("bz"), F.floor(F.col("y") / step).cast("int").alias("by"), F.explode(spans).alias("bx")).select("scan_index", "bz", "by", F.col("bx").cast("int").alias("bx")).distinct()


def projection(runs: DataFrame, axis: str) -> DataFrame:
    """Greatest label along an axis at every place that has one: of x rows (scan_index, z, y, label), of y and z runs of the image."""
    if axis == "x":
        return runs.groupBy("scan_index", "z", "y").agg(F.max("label").alias("label"))
    return spans.greatest_label(runs, ["scan_index", "y" if axis == "z" else "z"])


def domain_value(kind: str, label: Column, inside: Column | None = None) -> Column:
    """Solver value of a voxel, 0 open and 1 blocked: all fluid, a cluster's gas (``inside``), or brine."""
    if kind == "absolute":
        return F.when(label.isin(BRINE, GAS), 0).otherwise(1)
    if kind == "gas":
        return F.when(inside, 0).otherwise(1)
    if kind == "water":
        return F.when(label == BRINE, 0).otherwise(1)
    raise ValueError(f"no domain {kind}")


def overlap(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of two masks, given as runs, with ``value``: 1 in both, 2 only in a, 3 only in b."""
    return spans.overlay(a, b, [*(keys or []), "z", "y"])


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels in both of two masks, given as runs, in the first alone and in the second alone, for each of ``keys``.

    Runs of a row meet by keys and row, and add the length that they share; no voxel is made. They are merged, as Spark takes runs made by
    functions to be as few as what they are made from, and would broadcast them."""
    row = [*keys, "z", "y"]
    met = a.select(*row, "x0", "x1").hint("merge").join(b.select(*row, F.col("x0").alias("b0"), F.col("x1").alias("b1")), row).where("x0 <= b1 AND x1 >= b0")
    sized = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), length().alias("n"))
    shared = met.select(*keys, F.greatest("x0", "b0").alias("x0"), F.least("x1", "b1").alias("x1"))
    every = sized(a, "a").unionByName(sized(b, "b")).unionByName(sized(shared, "both"))
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return every.groupBy(*keys).agg(n("both").alias("n_both"), (n("a") - n("both")).alias("only_a"), (n("b") - n("both")).alias("only_b"))


def agreement(counts: DataFrame) -> DataFrame:
    """Jaccard agreement of two masks and agreement of their counts, in per cent, added to their ``overlap_counts``."""
    na, nb = F.col("n_both") + F.col("only_a"), F.col("n_both") + F.col("only_b")
    return counts.withColumns({"agreement": 100 * F.try_divide(F.col("n_both").cast("double"), F.col("n_both") + F.col("only_a") + F.col("only_b")), "count_agreement": 100 * F.try_divide(F.least(na, nb).cast("double"), F.greatest(na, nb))})


def register(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of mask a moved so that its bounding box begins where b's does, for each of ``keys``; without b's box there are none."""
    low = lambda d, p: d.groupBy(*keys).agg(*[F.min(c).alias(f"{p}{c}") for c in ("z", "y", "x0")])
    moves = low(a, "a").join(low(b, "b"), keys).select(*keys, *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"by_{c}") for c in ("z", "y", "x0")])
    moved = a.join(F.broadcast(moves), keys)  # one row for each of keys
    return moved.select(*keys, *[(F.col(c) + F.col("by_x0" if c == "x1" else f"by_{c}")).alias(c) for c in ("z", "y", "x0", "x1")])


def shared_canvas(masks: DataFrame, keys: list[str], fixed: str) -> tuple[DataFrame, DataFrame]:
    """Masks(keys.., mask, z, y, x0, x1) in one frame, and the frame: each mask is moved so that its bounding box begins where that of the mask
    ``fixed`` does; the canvas reaches to the farthest end. Keys without the fixed mask have no rows. The moves, a row for each mask, are
    what is broadcast, never the masks."""
    low = masks.groupBy(*keys, "mask").agg(*[F.min(c).alias(f"_{c}") for c in ("z", "y", "x0")])
    at = low.where(F.col("mask") == fixed).select(*keys, *[F.col(f"_{c}").alias(f"_to_{c}") for c in ("z", "y", "x0")])
    by = low.join(F.broadcast(at), keys).select(*keys, "mask", *[(F.col(f"_to_{c}") - F.col(f"_{c}")).alias(f"_by_{c}") for c in ("z", "y", "x0")])
    moved = masks.join(F.broadcast(by), [*keys, "mask"]).select(*keys, "mask", *[(F.col(c) + F.col("_by_x0" if c == "x1" else f"_by_{c}")).alias(c) for c in ("z", "y", "x0", "x1")])
    ends = [F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), (F.max("x1") + 1).alias("x1")]
    return moved, moved.groupBy(*keys).agg(*ends)


def overlay_parts(masks: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Voxels of each combination of the masks ``names`` in one frame: ``(keys.., parts, n)``, parts being the names that cover them, joined
    by "+". All masks are swept together, whatever their number."""
    row = [*keys, "z", "y"]
    on = masks.select(*row, "x0", "x1", *[(F.col("mask") == name).cast("int").alias(f"_{i}") for i, name in enumerate(names)])
    swept = spans.levels(on, row, [f"_{i}" for i in range(len(names))])
    parts = F.concat_ws("+", *[F.when(F.col(f"_{i}") > 0, name) for i, name in enumerate(names)])
    return swept.groupBy(*keys, parts.alias("parts")).agg(F.sum(length()).alias("n"))


def footprint(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Places (y, x) of each key, whatever the slice, as runs (keys.., y, x0, x1)."""
    return spans.covered(runs, [*keys, "y"])


def surface(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a mask's voxels with a face neighbour outside it; a mesh's starting point.

    A voxel is inside where five things cover it: its own run without both ends, and the runs of the four rows beside. So each run is
    put on its own row once whole and once shortened, and on each row beside it, and the rows are swept."""
    row = [*keys, "z", "y"]
    whole = spans.covered(mask, row)
    put = lambda dz, dy, cut, own: F.struct((F.col("z") + dz).alias("z"), (F.col("y") + dy).alias("y"), (F.col("x0") + cut).alias("x0"), (F.col("x1") - cut).alias("x1"), F.lit(own).alias("_own"), F.lit(1 - own).alias("_cover"))
    each = whole.select(*keys, F.explode(F.array(put(0, 0, 0, 1), put(0, 0, 1, 0), *[put(dz, dy, 0, 0) for dz, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("p")).select(*keys, "p.*").where("x0 <= x1")
    return spans.merged(spans.levels(each, row, ["_own", "_cover"]).where("_own > 0 AND _cover < 5"), row)


def surface_voxels(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """``surface`` of a mask that is given as voxels (.., z, y, x), as voxels."""
    at = F.col("x")
    return spans.places(surface(voxels.select(*keys, "z", "y", at.alias("x0"), at.alias("x1")), keys))
