"""Frozen boxes, what they hold in every scan, and cluster tracks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BRINE, GAS
from .runs import length
from .voxels import flow_crop, z_profile


def frozen_boxes(clusters: DataFrame, ny: int, nx: int, fraction: float = 0.20, keys: list[str] | None = None) -> DataFrame:
    """Z range of each track's cluster at X by the flow crop, with full y and x: half-open bounds.

    ``clusters`` are runs with ``track_id``."""
    on = [*(keys or []), "track_id"]
    crop = flow_crop(z_profile(clusters, on), on, fraction)
    zero = F.lit(0).cast("int")
    return crop.select(*on, "z0", "z1", zero.alias("y0"), F.lit(ny).alias("y1"), zero.alias("x0"), F.lit(nx).alias("x1"))


def box_counts(runs: DataFrame, boxes: DataFrame, scans: DataFrame, gas: int = GAS) -> DataFrame:
    """Gas, brine, local saturation, gas z extent and gas centre of every box in every scan, empty ones included.

    Boxes have full y and x, so slices are counted first: one row a slice, then a range of slices for each box. The centre
    of a box without gas is the box's."""
    n = length()
    g, b = F.col("label") == gas, F.col("label") == BRINE
    per = runs.groupBy("scan_index", "z").agg(F.sum(F.when(g, n)).alias("g"), F.sum(F.when(b, n)).alias("b"), F.sum(F.when(g, n * F.col("y"))).alias("gy"), F.sum(F.when(g, n * (F.col("x0") + F.col("x1")) / 2)).alias("gx"))
    planes = boxes.select("track_id", "z0", "z1", "y0", "y1", "x0", "x1", F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"))
    inside = planes.join(per, "z").groupBy("track_id", "scan_index").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("g", "b")], F.sum(F.col("g") * F.col("z")).alias("gz"), F.sum("gy").alias("gy"), F.sum("gx").alias("gx"),
        (F.max(F.when(F.col("g") > 0, F.col("z"))) - F.min(F.when(F.col("g") > 0, F.col("z"))) + 1).alias("extent_gas"),
    )
    every = boxes.join(F.broadcast(scans.select("scan_index").distinct()))  # a row for each scan of a run: tens
    full = every.join(inside, ["track_id", "scan_index"], "left")
    gas_n, brine_n = F.coalesce("g", F.lit(0)).cast("long"), F.coalesce("b", F.lit(0)).cast("long")
    mid = lambda s, lo, hi: F.coalesce(F.try_divide(F.col(s).cast("double"), F.nullif("g", F.lit(0))), (F.col(lo) + F.col(hi) - 1) / 2)
    return full.select(
        "track_id", "scan_index", "z0", "z1", (F.col("z1") - F.col("z0")).alias("extent_z"), gas_n.alias("gas_voxels"), brine_n.alias("brine_voxels"),
        F.try_divide(brine_n.cast("double"), gas_n + brine_n).alias("sw_local"), F.coalesce("extent_gas", F.lit(0)).cast("int").alias("extent_gas"),
        mid("gz", "z0", "z1").alias("cog_z"), mid("gy", "y0", "y1").alias("cog_y"), mid("gx", "x0", "x1").alias("cog_x"),
    )


def with_cluster_at_x(counts: DataFrame, clusters: DataFrame, x_scan: DataFrame) -> DataFrame:
    """Rows of the box table: at X the gas is the whole cluster's, tails outside the box included, and the box percolates.

    ``clusters(track_id, n)`` are the clusters at X; ``x_scan`` has one row. Other scans keep their own counts."""
    j = counts.join(F.broadcast(x_scan.select("x_scan"))).join(F.broadcast(clusters.select("track_id", F.col("n").alias("gas_voxels_at_x"))), "track_id")  # n_keep rows
    at = F.col("scan_index") == F.col("x_scan")
    gas = F.when(at, F.col("gas_voxels_at_x")).otherwise(F.col("gas_voxels"))
    return j.withColumns({"is_x": at, "gas_voxels": gas, "sw_local": F.try_divide(F.col("brine_voxels").cast("double"), F.col("brine_voxels") + gas), "percolates": F.when(at, True), "spanning_count": F.when(at, 1), "cluster_voxels": F.when(at, gas)}).drop("x_scan")


def corrected_saturation(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Add sw_corrected: at X the gas is what the track's largest total of gas and brine leaves, so that scans agree."""
    total = F.max(F.col("gas_voxels") + F.col("brine_voxels")).over(Window.partitionBy(*keys))
    gas = F.when(F.col("is_x"), total - F.col("brine_voxels")).otherwise(F.col("gas_voxels"))
    return boxes.withColumn("sw_corrected", F.try_divide(F.col("brine_voxels").cast("double"), F.col("brine_voxels") + gas))


TRACKS = "status string, first_seen int, last_seen int, timesteps_seen int, timesteps_lost int, final_voxels bigint, cog_z double, cog_y double, cog_x double"


class Tracker:
    """Nearest-centre tracker: clusters come in their order, each takes the nearest active track of earlier steps."""

    def __init__(self, distance: float = 1000.0):
        self.distance, self.tracks = distance, {}

    def step(self, scan: int, clusters: list[tuple[int, float, float, float]], seed: bool) -> list[int | None]:
        """Update with clusters (voxels, z, y, x); the track of each, None where none is near and ``seed`` is false."""
        before = [t for t, s in self.tracks.items() if s["status"] == "active"]
        matched, out = set(), []
        for voxels, *cog in clusters:
            best, at = self.distance, None
            for t in before:
                d = math.dist(cog, self.tracks[t]["cog"])
                if d < best:
                    best, at = d, t
            if at is not None:
                s = self.tracks[at]
                s.update(cog=cog, final_voxels=voxels, last_seen=scan, timesteps_seen=s["timesteps_seen"] + 1, timesteps_lost=0)
                matched.add(at)
            elif seed:
                at = len(self.tracks)
                self.tracks[at] = {"status": "active", "first_seen": scan, "last_seen": scan, "timesteps_seen": 1, "timesteps_lost": 0, "final_voxels": voxels, "cog": cog}
            out.append(at)
        for t in before:
            if t not in matched:
                self.tracks[t]["status"] = "lost"
                self.tracks[t]["timesteps_lost"] += 1
        return out


def track_clusters(clusters: DataFrame, keys: list[str], distance: float = 1000.0, backwards: bool = True) -> DataFrame:
    """Tracks of ``clusters(keys, scan_index, label_id, n, cog_z, cog_y, cog_x)``, one row for each track.

    Scans are taken from the last back (as boxes are), or forwards; new tracks are made in the first and last only; a lost
    track never returns. A series has at most n_keep clusters a scan, so it fits one task."""
    types = dict(clusters.select(*keys).dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, order = Tracker(distance), sorted(pdf["scan_index"].unique(), reverse=backwards)
        for scan in order:
            part = pdf[pdf["scan_index"] == scan].sort_values("label_id")
            tracker.step(int(scan), list(part[["n", "cog_z", "cog_y", "cog_x"]].itertuples(index=False, name=None)), scan in (order[0], order[-1]))
        rows = [(*key, t, s["status"], s["first_seen"], s["last_seen"], s["timesteps_seen"], s["timesteps_lost"], int(s["final_voxels"]), *map(float, s["cog"])) for t, s in tracker.tracks.items()]
        return pd.DataFrame(rows, columns=[*keys, "track_id", *[c.split()[0] for c in TRACKS.split(", ")]])

    head = "".join(f"{k} {types[k]}, " for k in keys)
    return clusters.groupBy(*keys).applyInPandas(run, f"{head}track_id int, {TRACKS}")


def pct_change(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Change of gas voxels from the scan before, in per cent; null for the first and after an empty one."""
    w = Window.partitionBy(*keys).orderBy("scan_index")
    before = F.lag("gas_voxels").over(w)
    return boxes.select(*keys, "scan_index", "gas_voxels", (100 * F.try_divide((F.col("gas_voxels") - before).cast("double"), before)).alias("pct_change"))


def coherence(boxes: DataFrame, scans: DataFrame) -> DataFrame:
    """Mean, range, spread and population deviation of local saturations by scan, and the offset from the global one."""
    g = boxes.groupBy("scan_index").agg(F.count("sw_local").alias("n"), F.avg("sw_local").alias("mean_sw"), F.min("sw_local").alias("min_sw"), F.max("sw_local").alias("max_sw"), F.stddev_pop("sw_local").alias("sd_sw"))
    return g.join(scans.select("scan_index", "sw"), "scan_index").withColumns({"spread": F.col("max_sw") - F.col("min_sw"), "offset": F.col("mean_sw") - F.col("sw")})


def section_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """z_rank of each track by the middle of its box, from 1; the middle is z0 where z1 is null."""
    mid = (F.min("z0") + F.coalesce(F.min("z1"), F.min("z0"))) / 2
    part = Window.partitionBy(*[k for k in keys if k != "track_id"]).orderBy("z_mid", "track_id") if len(keys) > 1 else Window.orderBy("z_mid", "track_id")
    return boxes.groupBy(*keys).agg(mid.alias("z_mid")).withColumn("z_rank", F.row_number().over(part))


def with_section(rows: DataFrame, order: DataFrame, keys: list[str], unknown: int = 999) -> DataFrame:
    """Rows with their track's ``z_rank``; tracks without a box come last, with ``unknown``."""
    return rows.join(order.select(*keys, "z_rank"), keys, "left").withColumn("z_rank", F.coalesce("z_rank", F.lit(unknown)))


def section_pivot(boxes: DataFrame, order: DataFrame, n_keep: int = 8) -> DataFrame:
    """Scans by sections s1 .. in z order, with their mean and population deviation."""
    j = boxes.join(order.select("track_id", "z_rank"), "track_id")
    return j.groupBy("scan_index").agg(*[F.max(F.when(F.col("z_rank") == i, F.col("sw_local"))).alias(f"s{i}") for i in range(1, n_keep + 1)], F.avg("sw_local").alias("mean_sw"), F.stddev_pop("sw_local").alias("sd_sw"))
