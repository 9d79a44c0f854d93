"""Connected components of gas, percolation, and what is derived from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GAS
from ..scratch import checkpointed
from . import spans
from .graph import connected_components
from .runs import length


def _tolerance(connectivity: int, dz: int, dy: int) -> int | None:
    """By how much x ranges of rows so far apart may miss each other and still touch; None where they never do."""
    if connectivity == 6:
        return 0 if dz + dy == 1 else None
    if connectivity == 18:
        return 1 if dz + dy == 1 else 0
    return 1


def touching_runs(rows: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of touching runs; ``rows`` (z, y, x0, x1) are sorted, and the runs of a row disjoint.

    Runs that touch one are neighbours in the row beside: all whose end isn't before its start and whose start isn't behind its
    end, two searches in one sorted array of rows and places."""
    z, y, x0, x1 = rows.T
    tall, wide = int(y.max()) + 3, int(x1.max()) + 4
    line = z * tall + y + 1  # the lines of two slices never meet, as y stays below tall - 2
    lines, row = np.unique(line, return_inverse=True)
    starts, ends = row * wide + x0 + 1, row * wide + x1 + 1
    here = np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] <= x1[:-1] + 1))
    left, right = [here], [here + 1]
    for dz, dy in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):
        tol = _tolerance(connectivity, -dz, abs(dy))
        if tol is None:
            continue
        beside = line + dz * tall + dy
        at = np.minimum(np.searchsorted(lines, beside), len(lines) - 1)
        there = lines[at] == beside
        first = np.searchsorted(ends, at * wide + np.maximum(x0 + 1 - tol, 0))
        n = np.where(there, np.searchsorted(starts, at * wide + x1 + 1 + tol, side="right") - first, 0).clip(0)
        mine = np.repeat(np.arange(len(rows)), n)
        left.append(mine)
        right.append(np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(mine)))
    return np.concatenate(left), np.concatenate(right)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the least one that the edges (a, b) connect it with: parents hang on the least grandparent of a
    neighbour and jump up until nothing moves (FastSV; Zhang, Azad and Hu, PP 2020)."""
    parent = np.arange(n)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    while True:
        grand = parent[parent]
        before = parent.copy()
        np.minimum.at(parent, before[a], grand[b])
        np.minimum.at(parent, a, grand[b])
        np.minimum(parent, grand, out=parent)
        if (parent == before).all():
            return parent


def local_roots(rows: list[tuple[int, int, int, int]] | np.ndarray, connectivity: int) -> np.ndarray:
    """For runs (z, y, x0, x1), the place of the first run of each one's component, by z, then y, then x."""
    rows = np.asarray(rows, dtype=np.int64).reshape(-1, 4)
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order] - [rows[:, 0].min(), rows[:, 1].min(), rows[:, 2].min(), rows[:, 2].min()]
    root = np.empty(len(rows), dtype=np.int64)
    root[order] = order[least_reachable(len(rows), *touching_runs(ranked, connectivity))]
    return root


def label_components(runs: DataFrame, connectivity: int = 18, slab_depth: int = 64, seam_mode: str = "true", gas: int = GAS, keys: list[str] | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Gas runs with ``component``: the least linear voxel number (z, then y, then x) of their component.

    Slabs of ``slab_depth`` slices are labelled on their own; only runs next to a seam meet those beyond it, by an equi-join on
    row and an overlap of x ranges; the graph of slab components is contracted. The result doesn't depend on the
    depth. ``seam_mode`` "compat26" joins seams by 26 neighbours whatever the connectivity. ``keys`` are further columns that
    part volumes, besides scan_index. ``shape`` (nz, ny, nx) numbers the voxels; without it the gas's own extent does.
    """
    own = ["scan_index", *(keys or [])]
    gas_runs = runs.where(F.col("label") == gas).select(*own, "z", "y", "x0", "x1")
    nz, ny, nx = shape or (v + 1 if v is not None else 1 for v in gas_runs.agg(F.max("z"), F.max("y"), F.max("x1")).first())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gas_runs.schema.fields) + ", slab int, local long"
    columns = [*gas_runs.columns, "slab", "local"]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[["z", "y", "x0", "x1"]].to_numpy(np.int64)
        first = rows[local_roots(rows, connectivity)]
        pdf["local"] = (first[:, 0] * ny + first[:, 1]) * nx + first[:, 2]
        return pdf[columns]

    slabs = gas_runs.withColumn("slab", F.expr(f"CAST(z DIV {slab_depth} AS INT)"))
    labelled = slabs.groupBy(*own, "slab").applyInPandas(label, schema)
    if nz <= slab_depth:
        return labelled.drop("slab").withColumnRenamed("local", "component")
    labelled = checkpointed(labelled)
    volume = F.dense_rank().over(Window.orderBy(*own)) - 1  # volumes are few: one row each
    volumes = labelled.select(*own).distinct().withColumn("volume", volume.cast("long"))
    numbered = labelled.join(F.broadcast(volumes), own).withColumn("vertex", F.col("volume") * (nz * ny * nx) + F.col("local"))
    above = numbered.where(f"z % {slab_depth} = {slab_depth - 1}").select(*own, (F.col("z") + 1).alias("z"), F.explode(F.array(*[F.struct(F.lit(d).alias("dy"), (F.col("y") + d).alias("y")) for d in (-1, 0, 1)])).alias("r"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("vertex").alias("src"))
    above = above.select(*own, "z", "r.y", "r.dy", "a0", "a1", "src")
    below = numbered.where(f"z % {slab_depth} = 0 AND z > 0").select(*own, "z", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("vertex").alias("dst"))
    at_seam = 26 if seam_mode == "compat26" else connectivity
    straight, slanted = _tolerance(at_seam, 1, 0), _tolerance(at_seam, 1, 1)
    tol = F.when(F.col("dy") == 0, F.lit(straight)).otherwise(F.lit(slanted))
    touch = tol.isNotNull() & (F.col("a0") <= F.col("b1") + tol) & (F.col("b0") <= F.col("a1") + tol)
    edges = above.join(below, [*own, "z", "y"]).where(touch).select("src", "dst").distinct()
    roots = connected_components(edges).withColumnRenamed("vertex", "_v")
    return numbered.join(roots, F.col("vertex") == F.col("_v"), "left").withColumn("component", F.coalesce("component", "vertex") - F.col("volume") * (nz * ny * nx)).select(*own, "z", "y", "x0", "x1", "component")


def component_sizes(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return labelled.groupBy("scan_index", *(keys or []), "component").agg(F.sum(length()).alias("n"))


def top_clusters(sizes: DataFrame, n_keep: int = 8, keys: list[str] | None = None) -> DataFrame:
    """The ``n_keep`` largest components of each volume with label_id 1 .., ties to the smaller first voxel."""
    if not 1 <= n_keep <= 255:
        raise ValueError("n_keep must be from 1 to 255")
    rank = F.row_number().over(Window.partitionBy("scan_index", *(keys or [])).orderBy(F.desc("n"), "component"))
    return sizes.withColumn("label_id", rank).where(F.col("label_id") <= n_keep)


def percolation(labelled: DataFrame, keys: list[str], z0: int | str, z1: int | str) -> DataFrame:
    """Per volume: components, those that reach both the first and the last slice (z0 .. z1 - 1), voxels of the largest."""
    low, high = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (z0, z1))
    extra = [c for c in (z0, z1) if isinstance(c, str)]
    per = labelled.groupBy(*keys, *extra, "component").agg(F.sum(length()).alias("n"), (F.bool_or(F.col("z") == low) & F.bool_or(F.col("z") == high - 1)).alias("spans"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_components"), F.count_if("spans").alias("spanning_count"), F.max("n").alias("largest"))


def matched_component(labelled: DataFrame, footprint: DataFrame, keys: list[str]) -> DataFrame:
    """The component with most voxels over a footprint, disjoint runs (y, x0, x1); the largest where none is over it. Ties: first voxel."""
    own = [*keys, "component"]
    sizes = labelled.groupBy(*own).agg(F.sum(length()).alias("n"))
    over = spans.shared_length(labelled, footprint, ["y"], own).withColumnRenamed("n", "over")
    per = sizes.join(over, own, "left").withColumn("over", F.coalesce("over", F.lit(0)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("over"), F.desc("n"), "component"))
    return per.withColumn("r", best).where("r = 1").drop("r")


def route_overlap(labelled: DataFrame, route: DataFrame, keys: list[str], z0: int, z1: int) -> DataFrame:
    """For each spanning component, Jaccard of its inlet and outlet faces with those of ``route(face, y, x)``, and their sum.

    Faces are 0 (slice z0) and 1 (slice z1 - 1). Ranked by score, then size, then first voxel."""
    faces = labelled.where(F.col("z").isin(z0, z1 - 1)).select(*keys, "component", F.when(F.col("z") == z0, 0).otherwise(1).alias("face"), "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    if z1 - z0 == 1:
        faces = faces.withColumn("face", F.explode(F.array(F.lit(0), F.lit(1))))
    sizes = labelled.groupBy(*keys, "component").agg(F.sum(length()).alias("n"))
    both = faces.groupBy(*keys, "component").agg(F.count_distinct("face").alias("f")).where("f = 2").drop("f")
    mine = faces.join(both, [*keys, "component"])
    inter = mine.join(route.select("face", "y", "x", F.lit(1).alias("hit")), ["face", "y", "x"], "left").groupBy(*keys, "component", "face").agg(F.count("*").alias("a"), F.coalesce(F.sum("hit"), F.lit(0)).alias("i"))
    per_face = route.groupBy("face").agg(F.count("*").alias("b"))
    j = inter.join(per_face, "face", "left").withColumn("j", F.coalesce(F.try_divide(F.col("i").cast("double"), F.col("a") + F.coalesce("b", F.lit(0)) - F.col("i")), F.lit(0.0)))
    s = j.groupBy(*keys, "component").agg(F.max(F.when(F.col("face") == 0, F.col("j"))).alias("j_inlet"), F.max(F.when(F.col("face") == 1, F.col("j"))).alias("j_outlet"))
    s = s.withColumn("score", F.col("j_inlet") + F.col("j_outlet")).join(sizes, [*keys, "component"])
    return s.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("n"), "component")))


def disagreement_shapes(labelled: DataFrame, only_a: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Shape of each component of a disagreement mask: counts, bounds, fill, elongation, centroid and class.

    ``only_a(keys.., z, y, x0, x1)`` are disjoint runs of the first mask alone. Sums over a run are closed forms, and what it shares
    with the first mask is the overlap of their ends."""
    own, n = [*keys, "component"], length()
    extent = lambda low, high, name: (F.max(high) - F.min(low) + 1).alias(f"extent_{name}")
    mean = lambda c, name: (F.sum(c) / F.sum(n)).alias(f"c{name}")
    bounds = [extent("z", "z", "z"), extent("y", "y", "y"), extent("x0", "x1", "x")]
    means = [mean(n * F.col("z"), "z"), mean(n * F.col("y"), "y"), mean(F.expr("(CAST(x0 AS BIGINT) + x1) * (CAST(x1 AS BIGINT) - x0 + 1) DIV 2"), "x")]
    sizes = labelled.groupBy(*own).agg(F.sum(n).alias("n_vox"), *bounds, *means).where(F.col("n_vox") >= least)
    of_a = spans.shared_length(labelled, only_a, [*keys, "z", "y"], own).withColumnRenamed("n", "n_a")
    g = sizes.join(of_a, own, "left").withColumn("n_a", F.coalesce("n_a", F.lit(0)))
    big, small = F.greatest("extent_z", "extent_y", "extent_x"), F.least("extent_z", "extent_y", "extent_x")
    rf, fill, elong = F.col("n_a") / F.col("n_vox"), F.col("n_vox") / (F.col("extent_z") * F.col("extent_y") * F.col("extent_x")), big / small
    # fixed values: the classes, their limits and their order
    kind = F.when((elong > 8) & (fill < 0.25), "boundary_strip").when((F.abs(rf - 0.5) < 0.2) & (elong > 3), "interleaved_boundary").when(rf > 0.75, "raw_dominant").when(rf < 0.25, "tif_dominant").otherwise("mixed_boundary")
    return g.select(*own, "n_vox", "n_a", (F.col("n_vox") - F.col("n_a")).alias("n_b"), "extent_z", "extent_y", "extent_x", F.round(fill, 3).alias("fill"), F.round(elong, 2).alias("elongation"), F.round(rf, 3).alias("share_a"), kind.alias("kind"), *[F.round(f"c{c}", 1).alias(f"c{c}") for c in "zyx"])
