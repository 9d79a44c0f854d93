"""Catalogue of runs: selection, job lists, checks, upserts and reports."""

from __future__ import annotations

import json

import re
import socket
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import parse_domain, scan_prefix
from .quantiles import percentiles

BOX = ["run_id", "scan_index", "track_id", "connectivity"]
JOB = [*BOX, "sim_type", "simulator"]


def new_run_id(now: datetime | None = None, host: str | None = None) -> str:
    """Time stamp and the first 16 characters of the host's name."""
    name = re.sub(r"[^A-Za-z0-9_-]", "", host or socket.gethostname())[:16]
    return f"{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}_{name}"


def latest_run(runs: DataFrame, having: DataFrame | None = None) -> DataFrame:
    """The run that started last, of those with rows in ``having`` where it is given; ties to the greater run_id."""
    r = runs.join(having.select("run_id"), "run_id", "left_semi") if having is not None else runs
    return r.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")).where("run_id IS NOT NULL")


def run_listing(runs: DataFrame, scans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs with counts of scans and qualifying scans, connectivities, tracks and scan names; counts are pre-aggregated."""
    s = scans.groupBy("run_id").agg(F.count("*").alias("n_scans"), F.count_if("qualifying").alias("n_qualifying"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scan_index", "file_name"))), lambda x: scan_prefix(x["file_name"], whole=True)), ",").alias("scan_names"))
    b = boxes.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("connectivity")), ",").alias("connectivities"), F.count_distinct("track_id").alias("n_tracks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(s, "run_id", "left").join(b, "run_id", "left").select("run_id", "started_at", zero("n_scans"), zero("n_qualifying"), F.coalesce("connectivities", F.lit("?")).alias("connectivities"), zero("n_tracks"), "scan_names")


def track_profile(boxes: DataFrame, thin: int = 200) -> DataFrame:
    """Scans, extent range, saturation range and thinness of each track."""
    return boxes.groupBy("run_id", "connectivity", "track_id").agg(F.count_distinct("scan_index").alias("n_scans"), F.min("extent_z").alias("min_extent"), F.max("extent_z").alias("max_extent"), F.min("sw_local").alias("min_sw"), F.max("sw_local").alias("max_sw")).withColumn("thin", F.col("max_extent") < thin)


def domains(boxes: DataFrame) -> DataFrame:
    """A row for each domain file of each box."""
    return boxes.select(*BOX, "is_x", "extent_z", "gas_voxels", "brine_voxels", F.explode(F.array(*[F.lit(k) for k in ("absolute", "gas", "water")])).alias("sim_type"))


def select_domains(all_domains: DataFrame, scans: DataFrame, tracks: list[int] | None = None, only: list[int] | None = None, kinds: list[str] | None = None, qualifying: bool = True, exclude_thin: int | None = None) -> DataFrame:
    """Domains that a selection leaves; absolute ones at X only. None selects everything."""
    d = all_domains.where(F.col("is_x") | (F.col("sim_type") != "absolute"))
    for column, values in (("track_id", tracks), ("scan_index", only), ("sim_type", kinds)):
        if values is not None:
            d = d.where(F.col(column).isin(values))
    if exclude_thin is not None:
        d = d.where(F.col("extent_z") >= exclude_thin)
    return d.join(scans.where("qualifying").select("run_id", "scan_index"), ["run_id", "scan_index"], "left_semi") if qualifying else d


def job_list(all_domains: DataFrame) -> DataFrame:
    """Jobs of the second solver: absolute once a track at X, gas and water at the other scans, with their fluid voxels."""
    fluid = F.when(F.col("sim_type") == "absolute", F.col("gas_voxels") + F.col("brine_voxels")).when(F.col("sim_type") == "gas", F.col("gas_voxels")).otherwise(F.col("brine_voxels"))
    return all_domains.where(F.col("is_x") == (F.col("sim_type") == "absolute")).dropDuplicates([*BOX, "sim_type"]).select(*BOX, "sim_type", fluid.alias("fluid_voxels"))


def todo(wanted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What has no permeability yet; to run again after an interruption."""
    return wanted.join(results.where("k_z IS NOT NULL").select(*keys), keys, "left_anti")


def preflight(files: DataFrame, summaries: DataFrame, boxes: DataFrame) -> DataFrame:
    """Gate of each domain file ``files(name)``: bad_name, bad_scan, stale, done, run, or run_no_box.

    ``summaries(name, nx, ny, nz, voxel_m, permeability)`` are results on disk; stale where the dimensions or the voxel (by more
    than 1e-3 micrometres) differ from the name's. ``boxes(track_id, scan_index)``."""
    p = files.withColumn("p", parse_domain(F.col("name"))).withColumn("scan_no", F.when(F.col("p.scan").rlike(r"^\d+$"), F.col("p.scan").cast("int")))
    s = summaries.select("name", *[F.col(c).alias(f"s_{c}") for c in ("nx", "ny", "nz", "voxel_m", "permeability")])
    j = p.join(s, "name", "left").join(boxes.select(F.col("track_id").alias("b_track"), F.col("scan_index").alias("b_scan"), F.lit(True).alias("has_box")).distinct(), (F.col("p.track") == F.col("b_track")) & (F.col("scan_no") == F.col("b_scan")), "left")
    differs = F.coalesce(F.abs(F.col("s_voxel_m") * 1e6 - F.col("p.voxel_um")) > 1e-3, F.lit(False))
    for c in ("nx", "ny", "nz"):
        differs |= F.coalesce(F.col(f"s_{c}") != F.col(f"p.{c}"), F.lit(False))
    gate = F.when(F.col("p").isNull(), "bad_name").when(F.col("scan_no").isNull(), "bad_scan").when(F.col("s_permeability").isNotNull() & differs, "stale").when(F.col("s_permeability").isNotNull(), "done").when(F.col("has_box"), "run").otherwise("run_no_box")
    return j.select("name", gate.alias("gate"))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows whose keys it lacks; of new rows with one key the least by their other columns, in their order."""
    rest = [c for c in table.columns if c not in keys]
    new = rows.join(table.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")) if rest else rows.join(table.select(*keys), keys, "left_anti").distinct()
    return table.unionByName(new.select(*keys, *([F.col(f"_r.{c}").alias(c) for c in rest])).select(*table.columns))


def fit_records(fits: DataFrame, values: list[str], dataset: str, form: str) -> DataFrame:
    """Rows of the table of fits, for ``upsert`` by run, dataset, form and phase: parameter names and values as JSON arrays."""
    as_json = lambda items: F.to_json(F.array(*items))
    return fits.select("run_id", F.lit(dataset).alias("dataset"), F.lit(form).alias("form"), "phase", F.lit(json.dumps(values, separators=(",", ":"))).alias("param_names"), as_json([F.col(v) for v in values]).alias("param_values"), "n_points")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with ``rows`` in place of those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def update(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The table with non-null values of ``rows`` in ``columns``."""
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def orphans(runs: DataFrame, scans: DataFrame, boxes: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of rows without a parent; all 0 in a sound catalogue."""
    lost = lambda name, child, parent, keys: child.join(parent.select(*keys), keys, "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
    return lost("scans_runs", scans, runs, ["run_id"]).unionByName(lost("boxes_runs", boxes, runs, ["run_id"])).unionByName(lost("boxes_scans", boxes, scans, ["run_id", "scan_index"])).unionByName(lost("results_boxes", results, boxes, BOX))


def provenance(results: DataFrame, boxes: DataFrame, scans: DataFrame) -> DataFrame:
    """Every result with its box and scan."""
    b = boxes.select(*BOX, "z0", "z1", "gas_voxels", "brine_voxels")
    return results.join(b, BOX).join(scans.select("run_id", "scan_index", "file_name", F.col("sw").alias("sw_global")), ["run_id", "scan_index"]).select(*JOB, "k_z", "z0", "z1", "gas_voxels", "brine_voxels", "file_name", "sw_global")


def convergence(results: DataFrame) -> DataFrame:
    """Flags and error bounds of the solver's notes, by simulator."""
    j = results.select("simulator", F.get_json_object("notes", "$.flag").alias("flag"), F.get_json_object("notes", "$.bound").try_cast("double").alias("bound"))
    per = j.groupBy("simulator").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "converged").alias("n_converged"), F.min("bound").alias("min_bound"), F.max("bound").alias("max_bound"), F.avg((F.col("bound") < 0.01).cast("double")).alias("share_below"))
    middle = percentiles(j, ["simulator"], "bound", {"median_bound": 0.5}).withColumnRenamed("simulator", "_simulator")
    return per.join(middle, F.col("simulator").eqNullSafe(F.col("_simulator")), "left").select("simulator", "n", "n_converged", "median_bound", "min_bound", "max_bound", "share_below")


def inventory(runs: DataFrame, scans: DataFrame, boxes: DataFrame, results: DataFrame) -> DataFrame:
    """Rows by run in each table, and results by simulator family (the name up to the first underscore)."""
    n = lambda df, c: df.groupBy("run_id").agg(F.count("*").alias(c))
    fam = results.groupBy("run_id").agg(F.count_if(F.lower(F.split_part("simulator", F.lit("_"), F.lit(1))) == "lir").alias("n_lir"), F.count_if(F.lower(F.split_part("simulator", F.lit("_"), F.lit(1))) == "lbm").alias("n_lbm"))
    out = runs.select("run_id")
    for part in (n(scans, "n_scans"), n(boxes, "n_boxes"), fam):
        out = out.join(part, "run_id", "left")
    return out.na.fill(0)


def empty_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    return runs.join(results.select("run_id"), "run_id", "left_anti").select("run_id")


def delete_runs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the runs of ``gone``; children first when they are written one after the other."""
    return {name: df.join(gone, "run_id", "left_anti") for name, df in tables.items()}


def output_summary(boxes: DataFrame) -> DataFrame:
    """Per run and connectivity: boxes, percolating, empty, and voxels."""
    return boxes.groupBy("run_id", "connectivity").agg(F.count("*").alias("n_boxes"), F.count_if("percolates").alias("n_percolating"), F.count_if(F.col("gas_voxels") == 0).alias("n_empty"), F.sum("gas_voxels").alias("gas"), F.sum("brine_voxels").alias("brine"))


def overview(tables: dict[str, DataFrame], run_id: str) -> DataFrame:
    """(field, value) rows of one run: its counts in every table."""
    parts = [df.where(F.col("run_id") == run_id).agg(F.lit(name).alias("field"), F.count("*").cast("string").alias("value")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_number_latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last by ``order``: a replacing insert's result."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
