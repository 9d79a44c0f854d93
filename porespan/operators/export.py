"""The sheets of one run's export: overview, computed summaries, and its rows of every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import darcy, millidarcy
from .catalog import latest_run


def _of_run(df: DataFrame, run_id: str, connectivity: str | None) -> DataFrame:
    rows = df.where(F.col("run_id") == run_id)
    return rows.where(F.col("connectivity") == connectivity) if connectivity is not None else rows


def _k(kinds: tuple[str, ...]) -> Column:
    """Mean permeability of the rows of these kinds, whatever their case."""
    return F.avg(F.when(F.lower("sim_type").isin(*kinds), F.col("k_z")))


def summary_kabs(results: DataFrame, run_id: str, connectivity: str | None = None) -> DataFrame:
    """Absolute permeability of each track in m2, mD and D: the mean of its results."""
    per = _of_run(results, run_id, connectivity).where("lower(sim_type) = 'absolute' AND k_z IS NOT NULL").groupBy("track_id").agg(F.avg("k_z").alias("k_abs_m2"))
    return per.select(F.col("track_id").alias("track"), "k_abs_m2", millidarcy(F.col("k_abs_m2")).alias("k_abs_md"), darcy(F.col("k_abs_m2")).alias("k_abs_d"))


def summary_kr(results: DataFrame, boxes: DataFrame, run_id: str, connectivity: str | None = None) -> DataFrame:
    """Each track and scan with gas or brine results: saturation of its box, permeabilities in mD, and both over the track's absolute one.

    Results of several solvers or connectivities are averaged; water and brine are one phase; a missing or zero absolute
    permeability leaves the relative ones null; of boxes with one track and scan the greatest saturation."""
    found = _of_run(results, run_id, connectivity).where("k_z IS NOT NULL")
    per = found.where("lower(sim_type) IN ('gas', 'water', 'brine')").groupBy("track_id", "scan_index").agg(_k(("gas",)).alias("_gas"), _k(("water", "brine")).alias("_brine"))
    kabs = found.where("lower(sim_type) = 'absolute'").groupBy("track_id").agg(F.nullif(F.avg("k_z"), F.lit(0.0)).alias("_abs"))
    sw = _of_run(boxes, run_id, connectivity).groupBy("track_id", "scan_index").agg(F.max("sw_local").alias("sw_local"))
    j = per.join(kabs, "track_id", "left").join(sw, ["track_id", "scan_index"], "left")
    md = [millidarcy(F.col(f"_{p}")).alias(f"k_{p}_md") for p in ("abs", "gas", "brine")]
    return j.select(F.col("track_id").alias("track"), F.col("scan_index").alias("scan"), "sw_local", *md, *[(F.col(f"_{p}") / F.col("_abs")).alias(f"kr_{p}") for p in ("gas", "brine")])


def run_overview(tables: dict[str, DataFrame], run_id: str, connectivity: str | None = None) -> DataFrame:
    """(field, value) rows: the run, the filter, the columns of its row in ``runs``, its rows in every table, and its results that have a
    permeability. A field without a value is null."""
    facts = lambda df, *f: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in f])).alias("f")).select("f.*")
    spark = next(iter(tables.values())).sparkSession
    out = [facts(spark.range(1), ("run_id", F.lit(run_id)), ("connectivity_filter", F.lit(connectivity or "(all)")))]
    for name, df in tables.items():
        own = df.where(F.col("run_id") == run_id)
        if name == "runs":
            out.append(facts(own.limit(1), *[(f"runs.{c}", F.col(c)) for c in df.columns]))
        counted = own.agg(F.count("*").alias("n"), F.count("k_z" if name == "simulation_results" else F.lit(1)).alias("m"))
        out.append(facts(counted, (f"n_rows.{name}", F.col("n")), *([("n_sim_results", F.col("m"))] if name == "simulation_results" else []), *([("n_scans", F.col("n"))] if name == "scans" else [])))
    return reduce(DataFrame.unionByName, out)


def run_sheets(tables: dict[str, DataFrame], run_id: str | None = None, connectivity: str | None = None) -> dict[str, DataFrame]:
    """The sheets of a run's workbook in their order, for ``write_sheets``: overview, summaries that have rows, and the run's rows of
    each table with a run_id. Without ``run_id`` the latest run with results. ``connectivity`` filters the summaries alone."""
    results, boxes = tables["simulation_results"], tables["fixed_boxes"]
    if run_id is None:
        found = latest_run(tables["runs"], results).first()
        if found is None:
            raise ValueError("no run has results")
        run_id = found.run_id
    scoped = {n: df for n, df in tables.items() if "run_id" in df.columns}
    sheets = {"run_overview": run_overview(scoped, run_id, connectivity)}
    for name, df in (("summary_kr", summary_kr(results, boxes, run_id, connectivity)), ("summary_kabs", summary_kabs(results, run_id, connectivity))):
        if not df.isEmpty():
            sheets[name] = df
    return sheets | {n: df.where(F.col("run_id") == run_id) for n, df in scoped.items()}
