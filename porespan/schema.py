"""Tables of the catalogue: columns, types and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names and types of the catalogue's columns.
TABLES: dict[str, str] = {
    "slices": "scan_index int, z int, ny int, nx int, labels binary",
    "voxels": "scan_index int, z int, y int, x int, label int",
    "runs_x": "scan_index int, z int, y int, x0 int, x1 int, label int",
    "runs": "run_id string, started_at timestamp, crop_mode string, connectivity string, n_keep int, regime_cutoff string, out_dir string",
    "scans": "run_id string, scan_index int, file_name string, sw double, qualifying boolean, is_x boolean, elapsed_minutes double, sw_ref double",
    "tracks": "run_id string, track_id int, connectivity string, status string, first_seen int, last_seen int, timesteps_seen int, timesteps_lost int, final_voxels bigint, cog_z double, cog_y double, cog_x double",
    "fixed_boxes": "run_id string, scan_index int, track_id int, connectivity string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, extent_z int, extent_y int, extent_x int, gas_voxels bigint, gas_voxels_at_x bigint, brine_voxels bigint, gas_volume_mm3 double, sw_local double, percolates boolean, spanning_count int, cluster_voxels bigint, domain_absolute string, domain_gas string, domain_water string",
    "cluster_properties": "run_id string, scan_index int, label_id int, connectivity string, track_id int, voxel_count bigint, volume_mm3 double, clustermask_raw string, clustermask_z0 int, clustermask_z1 int",
    "simulation_results": "run_id string, scan_index int, track_id int, connectivity string, sim_type string, simulator string, k_x double, k_y double, k_z double, k_eff double, kr double, sw double, domain_path string, raw_output_path string, notes string",
    "provenance_steps": "run_id string, scan_file string, step_order int, module string, label string, version string, step_date string, parameters map<string,string>",
    "corey_fits": "run_id string, dataset string, form string, phase string, n_points int, rmse double, chi2 double, param_names array<string>, param_values array<double>, param_errors array<double>, at_bound array<string>",
    "baseline_points": "section string, scan int, sw_a double, sw_b double, kr_gas double, kr_brine double, k_abs_md double",
}
KEYS: dict[str, list[str]] = {
    "runs": ["run_id"],
    "scans": ["run_id", "scan_index"],
    "tracks": ["run_id", "track_id", "connectivity"],
    "fixed_boxes": ["run_id", "scan_index", "track_id", "connectivity"],
    "cluster_properties": ["run_id", "scan_index", "label_id", "connectivity"],
    "simulation_results": ["run_id", "scan_index", "track_id", "connectivity", "sim_type", "simulator"],
    "provenance_steps": ["run_id", "scan_file", "step_order"],
    "corey_fits": ["run_id", "dataset", "form", "phase"],
}


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The frame with the table's columns and types; columns that an older version lacks come as nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table)])


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their count: empty where the primary key holds."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")
