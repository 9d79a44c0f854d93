"""Matching and comparison of clusters across connectivities, set memberships, and picks of a series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_greedy(left: list[tuple], right: list[tuple], tolerance: float) -> list[tuple[int | None, int | None, float | None]]:
    """One-to-one matches of (id, size, z, y, x): the largest left one first takes the nearest free right one in reach.

    Leftovers of both sides come with None."""
    free, out = {r[0]: r[2:] for r in right}, []
    for name, _, *cog in sorted(left, key=lambda r: (-r[1], r[0])):
        d, at = min(((math.dist(cog, c), r) for r, c in free.items()), default=(math.inf, None))
        if d <= tolerance:
            del free[at]
            out.append((name, at, d))
        else:
            out.append((name, None, None))
    return out + [(None, r, None) for r in sorted(free)]


def match_clusters(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 80.0) -> DataFrame:
    """Greedy matches of clusters(keys, label_id, n, cog_z, cog_y, cog_x) of two labellings, per key (n_keep rows a side)."""
    types = dict(a.select(*keys).dtypes)
    columns = ["label_id", "n", "cog_z", "cog_y", "cog_x"]

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = match_greedy(list(x[columns].itertuples(index=False, name=None)), list(y[columns].itertuples(index=False, name=None)), tolerance)
        out = pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, "label_a", "label_b", "distance"])
        return out.astype({"label_a": "Int32", "label_b": "Int32", "distance": "Float64"})

    head = "".join(f"{k} {types[k]}, " for k in keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, f"{head}label_a int, label_b int, distance double")


def latest_run_by_connectivity(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run that has boxes of a connectivity; ties to the greater run id."""
    had = boxes.select("run_id", "connectivity").distinct().join(runs.select("run_id", "started_at"), "run_id")
    return had.groupBy("connectivity").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def connectivity_comparison(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Compare the evolutions ``(.., scan_index, gas_voxels, percolates)`` of clusters under two connectivities.

    For each of ``keys``: gas at the last scan of either, the difference, also in per cent of the second (null where that is 0),
    and, position by position as far as the shorter one goes, how often they disagree on percolation."""
    at = Window.partitionBy(*keys).orderBy("scan_index")
    last = lambda d, p: d.groupBy(*keys).agg(F.coalesce(F.max_by("gas_voxels", "scan_index"), F.lit(0)).alias(f"gas_{p}"))
    numbered = lambda d, p: d.select(*keys, F.row_number().over(at).alias("_at"), F.coalesce("percolates", F.lit(False)).alias(f"_{p}"))
    pairs = numbered(a, "a").join(numbered(b, "b"), [*keys, "_at"]).groupBy(*keys).agg(F.count("*").alias("n_compared"), F.count_if(F.col("_a") != F.col("_b")).alias("n_disagree"))
    both = last(a, "a").join(last(b, "b"), keys).join(pairs, keys)
    diff = F.col("gas_a") - F.col("gas_b")
    return both.select(*keys, "gas_a", "gas_b", diff.alias("difference"), (100 * F.try_divide(diff.cast("double"), F.col("gas_b"))).alias("relative"), "n_compared", "n_disagree")


def memberships(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Intersection and differences of two sets of rows in one pass: each distinct row with ``side`` both, a or b."""
    rows = a.select(*on, F.lit(1).alias("_s")).unionByName(b.select(*on, F.lit(2).alias("_s")))
    mask = rows.groupBy(*on).agg(F.bit_or("_s").alias("_m"))
    return mask.select(*on, F.when(F.col("_m") == 3, "both").when(F.col("_m") == 1, "a").otherwise("b").alias("side"))


def panel_picks(series: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Rows of each series (scan_index, is_x) to show: all where there are ``most`` or fewer, else ``most`` - 1 at even places,
    rounded half to even, and the one at X (the last one where none is)."""
    w, whole = Window.partitionBy(*keys).orderBy("scan_index"), Window.partitionBy(*keys)
    p = series.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    p = p.withColumn("_x", F.coalesce(F.min(F.when(F.col("is_x"), F.col("_at"))).over(whole), F.col("_n") - 1))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 2)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(most - 2))).cast("int"))
    return p.where((F.col("_n") <= most) | F.array_contains(places, F.col("_at")) | (F.col("_at") == F.col("_x"))).drop("_at", "_n", "_x")
