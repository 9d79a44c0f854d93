"""Deterministic inputs derived from the driver's tables: a volume series and a small catalogue of runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import K_REFERENCE
from .functions.names import domain_name
from .operators import boxes as B
from .operators import components as C
from .operators import regime as R
from .operators import runs as RL
from .operators import voxels as V
from .operators.permeability import brine_base, gas_base
from .scratch import checkpointed

#: Scans, slices, rows and columns of the fixture volume.
SHAPE = (7, 16, 12, 12)
#: Slices of the growing volume in a task: what a worker holds at a time doesn't grow with the volume.
SLICES = 128
MINUTES = (40.0, 53.0, 59.0, 70.0, 100.0, 160.0, 230.0)
RUNS = (("r1", "2026-01-01 00:00:00"), ("r2", "2026-01-02 00:00:00"), ("r3", "2026-01-03 00:00:00"))
CONNECTIVITY = "1"
#: Published parameters of the modified gas curve and the standard brine curve.
GAS_CURVE, BRINE_CURVE = (0.7699, 3.339, 0.2946), (0.1381, 3.861)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume: every voxel of the grid, labelled by the quantities of the order lines that fall on it."""
    ns, nz, ny, nx = SHAPE
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber BETWEEN 1 AND 7").select(
        (F.col("l_linenumber") - 1).cast("int").alias("scan_index"), (F.col("l_orderkey") % nz).cast("int").alias("z"), (F.col("l_partkey") % ny).cast("int").alias("y"), (F.col("l_suppkey") % nx).cast("int").alias("x"), F.floor("l_quantity").cast("long").alias("q"))
    m = m.groupBy("scan_index", "z", "y", "x").agg((F.sum("q") % 100).alias("m"))
    part = lambda d, n: F.expr(f"CAST(id DIV {d} % {n} AS INT)")
    grid = spark.range(ns * nz * ny * nx).select(part(nz * ny * nx, ns).alias("scan_index"), part(ny * nx, nz).alias("z"), part(nx, ny).alias("y"), part(1, nx).alias("x"))
    label = F.when(F.col("m").isNull(), 0).when(F.col("m") < 46 - 5 * F.col("scan_index"), 2).when(F.col("m") < 70, 1).otherwise(0)
    return grid.join(m, ["scan_index", "z", "y", "x"], "left").select("scan_index", "z", "y", "x", label.cast("int").alias("label"))


def grown_depth(spark: SparkSession, sf_dir: str, lines: int = 9375) -> int:
    """Slices of the growing volume: one for so many order lines, four at least."""
    return max(4, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // lines)


def grown_slices(spark: SparkSession, sf_dir: str, side: int = 128, lines: int = 9375) -> DataFrame:
    """Slices of a volume that grows with the tables: seven scans, one slice of ``side`` x ``side`` voxels for so many order lines
    each (four at least). Boxes of 3 x 4 x 6 voxels have one label, by a hash of their place; gas recedes from scan to scan."""
    nz = grown_depth(spark, sf_dir, lines)
    tasks = max(spark.sparkContext.defaultParallelism, -(-SHAPE[0] * nz // SLICES))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.arange(side, dtype=np.int64)[:, None] // 4, np.arange(side, dtype=np.int64)[None, :] // 6
        for b in batches:
            for i in b["id"]:
                scan, z = divmod(int(i), nz)
                m = (z // 3 * 73856093 ^ y * 19349663 ^ x * 83492791) % 101
                labels = np.where(m < 46 - 5 * scan, 2, np.where(m < 70, 1, 0)).astype(np.uint8)
                yield pd.DataFrame({"scan_index": [scan], "z": [z], "ny": [side], "nx": [side], "labels": [labels.tobytes()]})

    return spark.range(0, SHAPE[0] * nz, 1, tasks).mapInPandas(draw, "scan_index int, z int, ny int, nx int, labels binary")


class Catalogue:
    """The fixture's tables. Those that queries read as stored tables are written once for each session and scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def voxels(self) -> DataFrame:
        return checkpointed(voxels(self.spark, self.sf_dir))

    @cached_property
    def runs_x(self) -> DataFrame:
        return checkpointed(RL.runs_from_voxels(self.voxels))

    @cached_property
    def points(self) -> DataFrame:
        """The saturation series with its times, as the regime fit takes it."""
        times = self.spark.createDataFrame([(i, m) for i, m in enumerate(MINUTES)], "scan_index int, x double")
        return checkpointed(V.sw_series(self.runs_x).join(times, "scan_index").select(F.lit("r1").alias("series"), "scan_index", "x", F.col("sw").alias("y")))

    @cached_property
    def fit(self) -> DataFrame:
        return checkpointed(R.three_segments(self.points, ["series"]))

    @cached_property
    def step(self) -> DataFrame:
        return checkpointed(R.timestep_x(self.points, self.fit, ["series"]))

    @cached_property
    def runs(self) -> DataFrame:
        return self.spark.createDataFrame(list(RUNS), "run_id string, started_at string").withColumn("started_at", F.to_timestamp("started_at"))

    @cached_property
    def scans(self) -> DataFrame:
        s = R.mark_scans(self.points, self.step, ["series"]).select("scan_index", F.concat(F.lit("8_"), F.col("scan_index").cast("string"), F.lit("_sub.am")).alias("file_name"), F.col("y").alias("sw"), "qualifying", "is_x", F.col("x").alias("elapsed_minutes"))
        return checkpointed(self.runs.select("run_id").join(F.broadcast(s)))

    @cached_property
    def labelled(self) -> DataFrame:
        """6N components of every scan."""
        return checkpointed(C.label_components(self.runs_x, 6, slab_depth=4, shape=SHAPE[1:]))

    @cached_property
    def clusters(self) -> DataFrame:
        """Runs of the largest components at X, with track_id = label_id, 1 .."""
        at_x = self.labelled.join(F.broadcast(self.step.select(F.col("x_scan").alias("scan_index"))), "scan_index")
        top = C.top_clusters(C.component_sizes(at_x)).select("scan_index", "component", F.col("label_id").alias("track_id"))
        return checkpointed(at_x.join(F.broadcast(top), ["scan_index", "component"]))

    @cached_property
    def boxes(self) -> DataFrame:
        return checkpointed(B.frozen_boxes(self.clusters, SHAPE[2], SHAPE[3]))

    @cached_property
    def counts(self) -> DataFrame:
        return checkpointed(B.box_counts(self.runs_x, self.boxes, self.points))

    @cached_property
    def fixed_boxes(self) -> DataFrame:
        sizes = self.clusters.groupBy("track_id").agg(F.sum(RL.length()).alias("n"))
        at = B.with_cluster_at_x(self.counts, sizes, self.step).join(F.broadcast(self.step.select("x_scan"))).where("scan_index <= x_scan").drop("x_scan")
        return checkpointed(self.runs.select("run_id").join(F.broadcast(at)).withColumn("connectivity", F.lit(CONNECTIVITY)))

    @cached_property
    def simulation_results(self) -> DataFrame:
        """Synthetic solver results with known curves for the first two runs; the second simulator is 8 % above the first."""
        b = B.corrected_saturation(self.fixed_boxes.where("run_id <> 'r3'"), ["run_id", "track_id", "connectivity"])
        kabs = K_REFERENCE * (1 + 0.1 * F.col("track_id"))
        sw = F.col("sw_corrected")
        rows = F.explode(F.array(
            F.struct(F.lit("absolute").alias("t"), kabs.alias("k"), F.col("is_x").alias("ok")),
            F.struct(F.lit("gas").alias("t"), (kabs * 0.9 * F.pow(gas_base(sw), F.lit(2.5))).alias("k"), (~F.col("is_x")).alias("ok")),
            F.struct(F.lit("water").alias("t"), (kabs * 0.14 * F.pow(brine_base(sw), F.lit(3.9))).alias("k"), (~F.col("is_x")).alias("ok")),
        ))
        sims = F.explode(F.array(F.struct(F.lit("LIR").alias("s"), F.lit(1.0).alias("f")), F.struct(F.lit("lbm_MRT").alias("s"), F.lit(1.08).alias("f"))))
        one = b.withColumn("r", rows).where("r.ok").withColumn("m", sims)
        note = F.concat(F.lit('{"flag": "'), F.when(F.col("track_id") % 3 == 0, "time").otherwise("converged"), F.lit('", "bound": '), (0.004 * F.col("track_id")).cast("decimal(6,3)").cast("string"), F.lit("}"))
        return checkpointed(one.select("run_id", "scan_index", "track_id", "connectivity", F.col("r.t").alias("sim_type"), F.col("m.s").alias("simulator"), (F.col("r.k") * F.col("m.f")).alias("k_z"), F.lit(None).cast("double").alias("kr"), F.col("sw_corrected").alias("sw"), note.alias("notes")))

    @cached_property
    def baseline(self) -> DataFrame:
        sw = (F.col("id") * 0.05).cast("double")
        k0, n, c = GAS_CURVE
        g, w = gas_base(sw), brine_base(sw)
        return self.spark.range(0, 21).select(F.col("id").cast("int").alias("ordinal"), sw.alias("sw"), (k0 * F.pow(g, F.lit(n)) + F.lit(c / (1 + c)) * g).alias("kr_gas"), (BRINE_CURVE[0] * F.pow(w, F.lit(BRINE_CURVE[1]))).alias("kr_brine"))

    @cached_property
    def names(self) -> DataFrame:
        """Domain names of the boxes' domains, and malformed ones."""
        b = self.fixed_boxes.where("run_id = 'r1'").select("track_id", "scan_index", "extent_z", F.explode(F.array(F.lit("absolute"), F.lit("gas"), F.lit("water"))).alias("kind"))
        good = b.select(domain_name(F.col("kind"), F.col("track_id"), F.col("scan_index"), F.lit(4.99684e-6), F.lit(SHAPE[3]), F.lit(SHAPE[2]), F.col("extent_z")).alias("name"))
        odd = ["domain_gas_03-7_5um_8bu_12x12.raw", "DOMAIN_GAS_03-2_5um_8bu_12x12x9.RAW", "domain_gas_03-8_2_5um_8bu_12x12x9.raw", "domain_gas_03-7_5_8bu_12x12x9.raw", "notes.txt"]
        return good.unionByName(self.spark.createDataFrame([(x,) for x in odd], "name string"))


@lru_cache(maxsize=8)
def _catalogue(spark: SparkSession, app: str, sf_dir: str) -> Catalogue:
    return Catalogue(spark, sf_dir)


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return _catalogue(spark, spark.sparkContext.applicationId, sf_dir)
