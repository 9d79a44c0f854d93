"""The registered queries: each applies one operator to the fixture catalogue or to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import SHAPE, Catalogue, catalogue
from ..functions import names as N
from ..operators import boxes as B
from ..operators import catalog as R
from ..operators import compare, export, fitting
from ..operators import components as C
from ..operators import permeability as P
from ..operators import regime as T
from ..operators import runs as RL
from ..operators import spans as A
from ..operators import voxels as V
from ..operators.quantiles import percentiles
from ..scratch import checkpointed, table_path
from ..sources import tiff
from ..sources.versions import VersionedTable
from ..streaming import windows
from . import oracles, volumes

NS, NZ, NY, NX = SHAPE
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Catalogue], DataFrame]) -> Callable:
    """Register a query on the fixture catalogue under its function's name."""
    FOUND[f.__name__] = lambda spark, sf_dir: f(catalogue(spark, sf_dir))
    return f


def on_tables(f: Callable[..., DataFrame]) -> Callable:
    """Register a query on the driver's tables: f gets a function that reads one."""
    FOUND[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return f


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- voxels


@query
def label_histogram(c):
    return V.label_histogram(c.runs_x)


@query
def sw_series(c):
    return rounded(V.sw_series(c.runs_x), "sw")


@query
def x_density(c):
    return V.x_density(c.runs_x)


@query
def z_profile(c):
    return V.z_profile(c.runs_x.where("label = 2"), ["scan_index"])


@query
def flow_crop(c):
    return V.flow_crop(V.z_profile(c.runs_x.where("label = 2"), ["scan_index"]), ["scan_index"])


@query
def runs_encode(c):
    return RL.runs_from_voxels(c.voxels)


@query
def runs_roundtrip(c):
    return RL.voxels_from_runs(c.runs_x)


@query
def slices_roundtrip(c):
    slices = RL.slices_from_runs(c.runs_x, NZ, NY, NX)
    return V.label_histogram(RL.runs_from_slices(slices))


def stacks(c: Catalogue) -> DataFrame:
    """A TIFF stack of every scan."""
    return tiff.stack_files(RL.slices_from_runs(c.runs_x, NZ, NY, NX), "scan_index")


@query
def tiff_slices(c):
    slices = tiff.stack_slices(stacks(c)).withColumn("scan_index", F.col("name").cast("int"))
    return V.label_histogram(RL.runs_from_slices(slices.drop("name")))


@query
def tiff_info(c):
    return tiff.stack_info(stacks(c))


def wrapped(c: Catalogue) -> DataFrame:
    """Columns 4 .. 11 of the fixture on a 16-wide grid, folded over its border."""
    v = c.voxels.where("label > 0 AND x >= 4").withColumn("x", F.pmod(F.col("x") + 9, F.lit(16)))
    return RL.runs_from_voxels(v)


@query
def x_shift(c):
    return V.x_shift(wrapped(c), 16)


@query
def unwrap_x(c):
    w = wrapped(c)
    r = V.roll_x(w, V.x_shift(w, 16), 16)
    return r.groupBy("scan_index", "label").agg(F.sum(RL.length()).alias("n"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"))


@query
def mip_z(c):
    return A.places(V.projection(c.runs_x, "z"))


@query
def mip_y(c):
    return A.places(V.projection(c.runs_x, "y"))


@query
def mip_x(c):
    return V.projection(c.runs_x, "x")


@query
def stride_sample(c):
    return V.stride_sample(c.runs_x, 3)


@query
def or_downsample(c):
    return V.block_any(c.runs_x, 4)


@query
def domain_counts(c):
    n = RL.length()
    open_ = lambda kind: F.sum(F.when(V.domain_value(kind, F.col("label"), F.col("label") == 2) == 0, n).otherwise(0)).alias(f"{kind}_open")
    return c.runs_x.groupBy("scan_index").agg(*[open_(k) for k in ("absolute", "gas", "water")])


@query
def box_crop(c):
    return RL.clip(c.runs_x, c.boxes, []).groupBy("track_id", "scan_index", "label").agg(F.sum(RL.length()).alias("n"))


def gas_runs(c: Catalogue, shift: int = 0) -> DataFrame:
    """Runs of gas without their label, each scan under the number ``shift`` lower."""
    return c.runs_x.where("label = 2").select((F.col("scan_index") - shift).alias("scan_index"), "z", "y", "x0", "x1")


@query
def overlap_agreement(c):
    a, b = gas_runs(c).where(F.col("scan_index") < NS - 1), gas_runs(c, 1).where("scan_index >= 0")
    return rounded(V.agreement(V.overlap_counts(a, b, ["scan_index"])), "agreement", "count_agreement", places=6)


@query
def registration(c):
    """Every scan but the last moved to where the inner part of the next one begins."""
    return V.register(gas_runs(c), gas_runs(c, 1).where("z >= 5 AND y >= 2"), ["scan_index"])


@query
def surface_voxels(c):
    return A.places(V.surface(gas_runs(c), ["scan_index"]))


@query
def footprint(c):
    return A.places(V.footprint(c.clusters, ["track_id"]))


# -- regime


@query
def regime_fit_shared(c):
    return rounded(T.three_segments(c.points, ["series"]).drop("series"), "sse", "slope1", "slope2", "slope3")


@query
def regime_fit_disjoint(c):
    f = T.three_segments(c.points, ["series"], share_breakpoints=False, origin=False)
    return rounded(f.select("i", "j", "sse"), "sse")


@query
def timestep_x(c):
    return T.timestep_x(c.points, T.three_segments(c.points, ["series"]), ["series"]).drop("series")


@query
def timestep_x_transition(c):
    return T.timestep_x(c.points, c.fit, ["series"], "transition").drop("series")


@query
def timestep_x_override(c):
    return T.timestep_x(c.points, c.fit, ["series"], override=55.0).drop("series")


@query
def qualifying_scans(c):
    return T.mark_scans(c.points, c.step, ["series"]).select("scan_index", "qualifying", "is_x")


@query
def regime_tags(c):
    return T.regime_tags(c.points, c.fit, ["series"]).select("scan_index", "regime")


# -- components


@query
def cca_6n(c):
    return C.component_sizes(C.label_components(c.runs_x, 6, slab_depth=4, shape=SHAPE[1:]))


@query
def cca_18n(c):
    return C.component_sizes(C.label_components(c.runs_x, 18, slab_depth=4, shape=SHAPE[1:]))


@query
def cca_26n(c):
    return C.component_sizes(C.label_components(c.runs_x, 26, slab_depth=4, shape=SHAPE[1:]))


@query
def topn_clusters(c):
    return C.top_clusters(C.component_sizes(c.labelled)).select("scan_index", "label_id", "component", "n")


@query
def cluster_cog(c):
    return rounded(V.centre_of_gravity(c.clusters, ["track_id"]), "cog_z", "cog_y", "cog_x", places=6)


@query
def cluster_bbox(c):
    return V.bounding_boxes(c.clusters, ["track_id"])


@query
def largest_component(c):
    return C.top_clusters(C.component_sizes(C.label_components(c.runs_x, 18, slab_depth=16, shape=SHAPE[1:])), 1).drop("label_id")


@query
def percolation_6n(c):
    return C.percolation(c.labelled, ["scan_index"], 0, NZ)


@query
def percolation_26n(c):
    return C.percolation(C.label_components(c.runs_x, 26, slab_depth=5, shape=SHAPE[1:]), ["scan_index"], 0, NZ)


@query
def split_check(c):
    """Whether a crop makes scan 3 percolate: slices 5 .. 10, alone and with two more on either side."""
    crops = F.explode(F.array(F.struct(F.lit(0).alias("pad"), F.lit(5).alias("z0"), F.lit(11).alias("z1")), F.struct(F.lit(2).alias("pad"), F.lit(3).alias("z0"), F.lit(13).alias("z1"))))
    r = c.runs_x.where("scan_index = 3").withColumn("c", crops).where("z >= c.z0 AND z < c.z1").select("*", "c.pad", "c.z0", "c.z1")
    lab = C.label_components(r, 26, slab_depth=4, shape=SHAPE[1:], keys=["pad", "z0", "z1"])
    return C.percolation(lab, ["pad"], "z0", "z1").drop("largest")


@query
def matched_component(c):
    place = V.footprint(c.runs_x.where("scan_index = 6 AND label = 2 AND z < 3"), [])
    return C.matched_component(c.labelled, place, ["scan_index"])


@query
def x_route_overlap(c):
    lab = C.label_components(c.runs_x, 26, slab_depth=4, shape=SHAPE[1:])
    largest = C.top_clusters(C.component_sizes(lab.where("scan_index = 3")), 1).select("scan_index", "component")
    route = lab.join(F.broadcast(largest), ["scan_index", "component"]).where(F.col("z").isin(0, NZ - 1))
    route = route.select(F.when(F.col("z") == 0, 0).otherwise(1).alias("face"), "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct()
    r = C.route_overlap(lab, route, ["scan_index"], 0, NZ)
    return rounded(r.select("scan_index", "component", "n", "score", "place"), "score", places=6)


@query
def disagreement_components(c):
    a, b = (gas_runs(c).where(F.col("scan_index") == i).withColumn("scan_index", F.lit(0)) for i in (3, 4))
    row = ["scan_index", "z", "y"]
    lab = C.label_components(A.exclusive(a, b, row).withColumn("label", F.lit(2)), 26, slab_depth=4, shape=SHAPE[1:])
    return C.disagreement_shapes(lab, A.difference(a, b, row), ["scan_index"])


# -- boxes, tracks


@query
def frozen_boxes(c):
    return B.frozen_boxes(c.clusters, NY, NX).select("track_id", "z0", "z1")


@query
def box_counts(c):
    n = B.box_counts(c.runs_x, c.boxes, c.points)
    return rounded(rounded(n, "sw_local"), "cog_z", "cog_y", "cog_x", places=6)


@query
def domain_files(c):
    """Size and open voxels of the gas domain file of every box and scan."""
    from ..sources.writers import domain_files as files

    blocked = F.char_length(F.replace(F.hex("content"), F.lit("0"), F.lit("")))
    f = files(c.runs_x, c.boxes, "gas")
    return f.select("track_id", "scan_index", "nz", "ny", "nx", (F.octet_length("content") - blocked).alias("n_open"))


@query
def cluster_masks(c):
    """Bounds and set voxels of the mask file of every cluster at X, with a margin of two slices."""
    from ..sources.writers import cluster_mask

    m = cluster_mask(c.clusters, NY, NX, NZ, margin=2)
    return m.select("track_id", "z0", "z1", F.octet_length("content").alias("n_bytes"), F.char_length(F.replace(F.hex("content"), F.lit("0"), F.lit(""))).alias("n_set"))


@query
def box_occupancy(c):
    return c.counts.select("track_id", "scan_index", F.round(100.0 * F.col("gas_voxels") / (F.col("extent_z") * NY * NX), 6).alias("occupancy"))


@query
def sw_local_x(c):
    return rounded(c.fixed_boxes.select("run_id", "track_id", "scan_index", "gas_voxels", "brine_voxels", "sw_local", "percolates"), "sw_local")


@query
def sw_corrected(c):
    return rounded(B.corrected_saturation(c.fixed_boxes, ["run_id", "track_id", "connectivity"]).select("run_id", "track_id", "scan_index", "sw_corrected"), "sw_corrected")


def all_clusters(c: Catalogue) -> DataFrame:
    top = C.top_clusters(C.component_sizes(c.labelled)).select("scan_index", "component", "label_id")
    return V.centre_of_gravity(c.labelled.join(top, ["scan_index", "component"]), ["scan_index", "label_id"]).withColumn("series", F.lit("r1"))


@query
def track_clusters(c):
    return rounded(B.track_clusters(all_clusters(c), ["series"], distance=4.0), "cog_z", "cog_y", "cog_x", places=6)


@query
def match_across_connectivity(c):
    lab = C.label_components(c.runs_x, 18, slab_depth=4, shape=SHAPE[1:])
    top = C.top_clusters(C.component_sizes(lab)).select("scan_index", "component", "label_id")
    other = V.centre_of_gravity(lab.join(top, ["scan_index", "component"]), ["scan_index", "label_id"])
    return rounded(compare.match_clusters(all_clusters(c), other, ["scan_index"], 5.0), "distance", places=6)


def spans(c: Catalogue, connectivity: int) -> DataFrame:
    """Evolution of the whole volume under a connectivity: scans with their gas and whether it percolates."""
    lab = c.labelled if connectivity == 6 else C.label_components(c.runs_x, connectivity, slab_depth=4, shape=SHAPE[1:])
    p = C.percolation(lab, ["scan_index"], 0, NZ).select("scan_index", (F.col("spanning_count") > 0).alias("percolates"))
    return V.sw_series(c.runs_x).select("scan_index", F.col("gas").alias("gas_voxels")).join(p, "scan_index", "left")


@query
def connectivity_comparison(c):
    """6N against 26N, of the whole volume and of its scans from the third on."""
    part = F.explode(F.array(F.struct(F.lit("whole").alias("part"), F.lit(0).alias("low")), F.struct(F.lit("late").alias("part"), F.lit(2).alias("low"))))
    cut = lambda d: d.withColumn("_p", part).where("scan_index >= _p.low").select("_p.part", "scan_index", "gas_voxels", "percolates")
    return rounded(compare.connectivity_comparison(cut(spans(c, 6)), cut(spans(c, 26)), ["part"]), "relative", places=6)


@query
def latest_run_by_connectivity(c):
    boxes = c.fixed_boxes.unionByName(c.fixed_boxes.where("run_id = 'r2'").withColumn("connectivity", F.lit("26")))
    return compare.latest_run_by_connectivity(boxes, c.runs)


@query
def face_memberships(c):
    """Components that reach the first slice, the last one, or both."""
    at = lambda z: c.labelled.where(F.col("z") == z).select("scan_index", "component").distinct()
    return compare.memberships(at(0), at(NZ - 1), ["scan_index", "component"])


@query
def panel_picks(c):
    return compare.panel_picks(c.scans.select("run_id", "scan_index", "is_x"), ["run_id"], 5).unionByName(compare.panel_picks(c.scans.where("run_id = 'r1'").select(F.lit("all").alias("run_id"), "scan_index", "is_x"), ["run_id"], 7))


@query
def gas_pct_change(c):
    return rounded(B.pct_change(c.fixed_boxes, ["run_id", "track_id"]).drop("gas_voxels"), "pct_change", places=6)


@query
def sat_coherence(c):
    return rounded(B.coherence(c.counts, V.sw_series(c.runs_x)).drop("sw"), "mean_sw", "min_sw", "max_sw", "sd_sw", "spread", "offset")


@query
def z_rank(c):
    return B.section_order(c.fixed_boxes, ["run_id", "track_id"])


@query
def z_rank_of_results(c):
    order = B.section_order(c.fixed_boxes.where("track_id <> 2"), ["run_id", "track_id"])
    return B.with_section(c.simulation_results.select("run_id", "track_id", "scan_index", "sim_type", "simulator"), order, ["run_id", "track_id"])


@query
def section_pivot(c):
    p = B.section_pivot(c.counts, B.section_order(c.boxes, ["track_id"]))
    return rounded(p, *[f"s{i}" for i in range(1, 9)], "mean_sw", "sd_sw")


# -- names and units


@query
def domain_names(c):
    return c.names


@query
def domain_name_parse(c):
    p = c.names.withColumn("p", N.parse_domain(F.col("name"))).where("p IS NOT NULL")
    return p.select("name", *[F.col(f"p.{f}").alias(f) for f in ("kind", "track", "scan", "voxel_um", "nx", "nz")])


@on_tables
def scan_prefix(read):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat_ws("_", k.cast("string"), F.col("o_custkey").cast("string"), F.lit("sub"))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return read("orders").select(name.alias("name")).withColumns({"prefix": N.scan_prefix(F.col("name")), "prefix_or_name": N.scan_prefix(F.col("name"), whole=True)})


@on_tables
def scan_order(read):
    from ..sources.readers import scan_order as numbered

    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("raw"), k.cast("string"))).otherwise(F.concat_ws("_", (k % 11).cast("string"), k.cast("string"), F.lit("a")))
    return numbered(read("supplier").select(name.alias("name")))


@on_tables
def int_list_parse(read):
    k = F.col("s_suppkey")
    text = F.concat((k % 5).cast("string"), F.lit(", "), (k % 7).cast("string"), F.lit("-"), (k % 7 + 3).cast("string"))
    return read("supplier").select("s_suppkey", N.int_list(text).alias("ids"))


@on_tables
def unit_conversion(read):
    k = F.col("l_quantity") * 1e-13
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(N.darcy(k), 9).alias("darcy"), F.round(N.millidarcy(k), 6).alias("millidarcy"), F.round(N.voxel_edge(F.col("l_extendedprice"), F.col("l_quantity")), 9).alias("edge"))


@query
def job_estimates(c):
    minutes, gb = N.job_estimate(F.col("gas_voxels"), F.col("extent_z"))
    return c.counts.select("track_id", "scan_index", F.round(minutes, 9).alias("minutes"), F.round(gb, 6).alias("gb"))


# -- permeability


@query
def kr_table(c):
    return rounded(P.kr_table(c.simulation_results.drop("kr")).select("run_id", "track_id", "simulator", "scan_index", "sim_type", "kr"), "kr")


def wide(c: Catalogue) -> DataFrame:
    return P.kr_wide(c.simulation_results.drop("kr"))


@query
def kr_wide(c):
    return rounded(wide(c).drop("connectivity"), "sw", "kr_gas", "kr_brine")


@query
def kr_complete(c):
    return P.complete_cases(wide(c), [4]).select("run_id", "track_id", "simulator", "scan_index")


@query
def kr_back_fill(c):
    return rounded(P.back_fill(c.simulation_results, "lbm_MRT").select("run_id", "track_id", "scan_index", "sim_type", "simulator", "kr"), "kr")


@query
def kr_write_back(c):
    points = wide(c).where("simulator = 'LIR' AND run_id = 'r1'")
    return rounded(P.write_back(c.simulation_results, points).select("run_id", "track_id", "scan_index", "sim_type", "simulator", "kr"), "kr")


@query
def fit_records(c):
    """Records of the grid fits in a table that has older ones of the first run."""
    points = fit_points(c).where("simulator = 'LIR'")
    fits = fitting.grid_fit(points, ["run_id"]).join(points.groupBy("run_id").agg(F.count("*").alias("n_points")), "run_id")
    new = R.fit_records(rounded(fits, "n", "k0", places=4), ["n"], "LIR", "grid")
    old = new.where("run_id = 'r1'").unionByName(new.where("run_id = 'r1'").withColumn("form", F.lit("basic"))).withColumn("param_values", F.lit("[0]"))
    return R.upsert(old, new, ["run_id", "dataset", "form", "phase"])


@query
def kr_per_timestep(c):
    t = P.per_timestep(wide(c), ["run_id", "simulator"])
    return rounded(t, *[x for x in t.columns if x.startswith(("mean", "sd"))])


@query
def kabs_summary(c):
    k = P.kabs_summary(c.simulation_results).select("run_id", "track_id", "simulator", "k_md", "k_d", "dev_reference", "dev_mean")
    return rounded(rounded(k, "k_md", "dev_reference", "dev_mean", places=6), "k_d")


def barred(c: Catalogue) -> DataFrame:
    return P.error_bars(P.complete_cases(wide(c)), ["run_id", "simulator"], "kr_gas")


@query
def error_bars(c):
    return rounded(barred(c).select("run_id", "simulator", "track_id", "scan_index", "sigma"), "sigma")


@query
def corey_eval(c):
    b = c.baseline.withColumn("kr_gas_standard", P.corey(P.gas_base(F.col("sw")), 0.9467, 2.154))
    return rounded(b.drop("sw"), "kr_gas", "kr_brine", "kr_gas_standard")


@query
def curve_rmse(c):
    curve = P.corey(P.gas_base(F.col("sw")), 0.7699, 3.339, 0.2946)
    return rounded(P.curve_rmse(wide(c).where("simulator = 'LIR'"), "kr_gas", curve), "rmse")


def fit_points(c: Catalogue) -> DataFrame:
    return barred(c).select("run_id", "simulator", F.lit("gas").alias("phase"), P.gas_base(F.col("sw")).alias("base"), F.col("kr_gas").alias("value"), "sigma")


@query
def corey_grid_fit(c):
    return rounded(fitting.grid_fit(fit_points(c), ["run_id", "simulator"]).drop("sse"), "n", "k0", places=6)


@query
def corey_fit(c):
    f = fitting.fit_curves(fitting.anchor(fit_points(c), ["run_id", "simulator"]), ["run_id", "simulator"], modified=True)
    return rounded(f.withColumn("at_bound", F.array_join("at_bound", ",")), "k0", "n", "c", "rmse", "chi2", "sd_k0", "sd_n", "sd_c", places=4)


@query
def corey_band(c):
    return rounded(fitting.fit_bands(fit_points(c), ["run_id", "simulator"], modified=False), "base", "curve", "low", "high", places=4)


@query
def nearest_sw(c):
    n = P.nearest_saturation(wide(c), c.baseline, ["run_id", "track_id", "simulator", "scan_index"])
    return rounded(n.drop("sw", "sw_baseline"), "dev_gas", "dev_brine", places=6)


@query
def rev_effect(c):
    r = P.rev_effect(c.fixed_boxes, c.simulation_results).select("run_id", "simulator", "n_all", "r_all", "slope_all", "n_inliers")
    return rounded(r, "r_all", "slope_all", places=6)


@on_tables
def iqr_outliers(read):
    li = read("lineitem").select("l_returnflag", "l_extendedprice")
    q = percentiles(li, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q3": 0.75})
    far = (F.col("l_extendedprice") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("l_extendedprice") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return li.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(far).alias("n_outliers"))  # three flags


@query
def cross_solver(c):
    x = P.cross_solver(c.simulation_results, "LIR", "lbm_MRT").select("run_id", "scan_index", "track_id", "sim_type", "deviation")
    return rounded(x, "deviation", places=6)


# -- catalogue


@query
def latest_run(c):
    return R.latest_run(c.runs)


@query
def latest_run_with_results(c):
    return R.latest_run(c.runs, c.simulation_results)


@query
def run_listing(c):
    return R.run_listing(c.runs, c.scans, c.fixed_boxes).drop("started_at")


@query
def track_profile(c):
    return rounded(R.track_profile(c.fixed_boxes, thin=4), "min_sw", "max_sw")


@query
def orphan_counts(c):
    return R.orphans(c.runs, c.scans, c.fixed_boxes.where("track_id <= 5"), c.simulation_results)


@query
def provenance_join(c):
    return rounded(R.provenance(c.simulation_results, c.fixed_boxes, c.scans).drop("connectivity", "k_z"), "sw_global")


@query
def convergence(c):
    return rounded(rounded(R.convergence(c.simulation_results), "share_below"), "median_bound", places=6)


@query
def scan_inventory(c):
    return R.inventory(c.runs, c.scans, c.fixed_boxes, c.simulation_results)


@query
def select_domains(c):
    d = R.select_domains(R.domains(c.fixed_boxes), c.scans, tracks=[1, 2, 3], kinds=["absolute", "gas"], exclude_thin=4)
    return d.select("run_id", "scan_index", "track_id", "sim_type")


@query
def job_list(c):
    return R.job_list(R.domains(c.fixed_boxes)).drop("connectivity")


@query
def resume_todo(c):
    left = R.todo(R.job_list(R.domains(c.fixed_boxes)), c.simulation_results, ["run_id", "scan_index", "track_id", "connectivity", "sim_type"])
    return left.select("run_id", "scan_index", "track_id", "sim_type")


@query
def delete_empty_runs(c):
    left = R.delete_runs({"runs": c.runs, "scans": c.scans, "fixed_boxes": c.fixed_boxes}, R.empty_runs(c.runs, c.simulation_results))
    n = [df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, df in left.items()]
    return n[0].unionByName(n[1]).unionByName(n[2])


@query
def preflight_gates(c):
    done = c.names.where("name LIKE 'domain_gas_01-1_%' OR name LIKE 'domain_water_01-1_%'").withColumn("p", N.parse_domain(F.col("name")))
    s = done.select("name", (F.col("p.nx") + F.when(F.col("p.kind") == "water", 1).otherwise(0)).alias("nx"), "p.ny", "p.nz", F.lit(4.99684e-6).alias("voxel_m"), F.lit(1e-13).alias("permeability"))
    return R.preflight(c.names, s, c.fixed_boxes)


@query
def output_summary(c):
    return R.output_summary(c.fixed_boxes).drop("connectivity")


@query
def overview(c):
    return R.overview({"scans": c.scans, "fixed_boxes": c.fixed_boxes}, "r1")


def _orders(read) -> tuple[DataFrame, DataFrame]:
    o = read("orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.lit(0.0)).unionByName(o.where("o_orderkey % 8 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")).where("o_orderkey < 0"))
    return o, new


@on_tables
def upsert_replace(read):
    return R.upsert(*_orders(read), ["o_orderkey"])


@on_tables
def insert_ignore(read):
    return R.insert_ignore(*_orders(read), ["o_orderkey"])


@on_tables
def update_coalesce(read):
    o, _ = _orders(read)
    new = o.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 8 != 0, F.lit(0.0)))
    return R.update(o, new, ["o_orderkey"], ["o_totalprice"])


def stored_orders(read) -> VersionedTable:
    """Orders in a versioned table of their own."""
    o, _ = _orders(read)
    table = VersionedTable(o.sparkSession, table_path(o.sparkSession, "orders"))
    table.create(o, ["o_orderkey"], 16)
    return table


@on_tables
def versioned_changes(read):
    """Orders after an upsert, an insert and a delete, each a version."""
    o, new = _orders(read)
    table = stored_orders(read)
    table.upsert(new)
    table.insert_ignore(o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.lit(2.0).alias("o_totalprice")))
    table.delete(o.where("o_orderkey % 3 = 0"))
    return table.read()


@on_tables
def versioned_restore(read):
    """Orders as they were, after a delete and its restoration; the version between is still there."""
    o, _ = _orders(read)
    table = stored_orders(read)
    gone = table.delete(o.where("o_orderkey % 2 = 0"))
    table.restore(1)
    n = lambda v: table.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return n(1).unionByName(n(gone)).unionByName(n(3))


@on_tables
def anti_semi_join(read):
    cust, orders = read("customer").select("c_custkey"), read("orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda how, kind: cust.join(orders, "c_custkey", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("left_semi", "with").unionByName(n("left_anti", "without"))


@on_tables
def distinct_list(read):
    return read("lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count_distinct("l_returnflag").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_if(F.col("l_quantity") > 25).alias("n_large"))


@on_tables
def fixed_histogram(read):
    bin_ = F.expr("CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE width_bucket(l_quantity, 0, 50, 10) END")
    return read("lineitem").groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@on_tables
def json_extract(read):
    return read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@on_tables
def latest_rows(read):
    return R.row_number_latest(read("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


def exported(c: Catalogue) -> dict[str, DataFrame]:
    return export.run_sheets({"runs": c.runs, "scans": c.scans, "fixed_boxes": c.fixed_boxes, "simulation_results": c.simulation_results, "names": c.names})


@query
def export_summary_kr(c):
    return rounded(export.summary_kr(c.simulation_results, c.fixed_boxes, "r2"), "sw_local", "k_abs_md", "k_gas_md", "k_brine_md", "kr_gas", "kr_brine", places=6)


@query
def export_summary_kabs(c):
    return rounded(export.summary_kabs(c.simulation_results, "r2").drop("k_abs_m2"), "k_abs_md", "k_abs_d", places=6)


@query
def export_overview(c):
    return exported(c)["run_overview"].where("field <> 'runs.started_at'")


@query
def export_sheets(c):
    """Rows and columns of each sheet."""
    parts = [df.agg(F.lit(name).alias("sheet"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("n_columns")) for name, df in exported(c).items() if name != "run_overview"]
    return reduce(DataFrame.unionByName, parts)


@on_tables
def file_formats(read):
    """Indices out of file names, clock times, short counts and volumes."""
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    name = F.when(k % 4 == 0, F.concat(F.lit("s_"), (k % 97).cast("string"), F.lit("_raw"))).when(k % 4 == 1, F.lit("plain")).otherwise(F.concat(F.lit("s_x"), k.cast("string")))
    volume = N.volume_mm3(q, F.lit(5e-6), F.lit(5e-6), F.lit(5e-6))
    return read("lineitem").select("l_orderkey", "l_linenumber", N.file_index(name).alias("file_index"), N.clock(q * k).alias("clock"), N.short_count((q * k).cast("long")).alias("count"), F.round(volume, 12).alias("volume"))


@on_tables
def latex_table(read):
    from ..sources.writers import latex_rows

    return latex_rows(read("nation").select("n_nationkey", F.concat_ws("_", "n_name", F.lit("x")).alias("name"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") / 8).alias("share")), "n_nationkey")


def text_files(df: DataFrame, label: str) -> str:
    """One text file for each row (k, value), below a folder whose name has its k. Written by a fixed number of tasks: the rows are small, so
    that Spark would deal them to one, but a file takes long."""
    path = table_path(df.sparkSession, label)
    df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "k").write.partitionBy("k").text(path)
    return path


def of_file(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.regexp_extract("file", r"/k=(\d+)/", 1).cast("long")).drop("file")


@on_tables
def solver_results(read):
    """Result summaries of a solver, one JSON file each, some of them broken."""
    from ..sources.readers import solver_summaries

    k = F.col("s_suppkey")
    text = F.format_string('{\n "nx": %d,\n "voxel_m": 5e-6,\n "permeability_z_m2": %d.5e-13,\n "stopping_criteria_flag": "%s"}', k % 90, k % 7, F.when(k % 3 == 0, "time").otherwise("converged"))
    files = read("supplier").select(k.alias("k"), F.when(k % 10 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"))
    found = of_file(solver_summaries(files.sparkSession, text_files(files, "summaries")))
    return found.select("k", "nx", F.round(F.col("permeability_z_m2") * 1e13, 6).alias("k_z"), F.col("stopping_criteria_flag").alias("flag"))


@on_tables
def solver_outputs(read):
    """Key/value outputs of a solver, of which the last value of a key counts, and the last positive number of its log."""
    from ..sources.readers import solver_log, solver_texts, solver_values

    k = F.col("s_suppkey")
    text = F.format_string("Nx %d\n  PERM_Z  %d.25 m2\nperm_z %d.75\nPermeability = -1.0\nstep\npermeability = %d.5e-3\npermeability = 0", k % 50, k, k % 11, k % 9)
    path = text_files(read("supplier").select(k.alias("k"), text.alias("value")), "outputs")
    spark = read("supplier").sparkSession
    texts = checkpointed(solver_texts(spark, path))
    values = of_file(solver_values(spark, texts, ["nx", "PERM_Z", "none"])).groupBy("k").agg(F.max(F.when(F.col("key") == "nx", F.col("value"))).alias("nx"), F.max(F.when(F.col("key") == "perm_z", F.col("value"))).alias("perm_z"))
    return values.join(of_file(solver_log(spark, texts)).withColumnRenamed("value", "logged"), "k", "left")


@on_tables
def saturation_file(read):
    """A reference table of saturations as CSV, read back: rows without a numbered name, a share or minutes are left out."""
    from ..sources.readers import saturation_reference

    k = F.col("s_suppkey")
    cells = F.concat_ws(",", F.when(k % 6 == 0, "name").otherwise(F.concat(k.cast("string"), F.lit("_scan"))), F.lit('"a, b"'), F.lit(""), F.lit("x"), F.when(k % 7 == 0, "1.5").otherwise(F.format_string("0.%02d", k % 100)), F.lit("-"), F.lit("-"), F.when(k % 5 == 0, "12:30").otherwise(k.cast("string")))
    one = read("supplier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), cells.alias("c")))), lambda x: x["c"]), "\n").alias("value")).withColumn("k", F.lit(1))
    found = saturation_reference(one.sparkSession, f"{text_files(one, 'reference')}/*/*")
    return found.select("row_number", "name", "sg", "elapsed_minutes")


def _headers(read) -> DataFrame:
    """Volume headers written from the suppliers' keys."""
    k = F.col("s_suppkey")
    t = lambda c: c.cast("string")
    uid = "UID:12345678-1234-1234-1234-12345678901"
    text = F.concat(
        F.lit("define Lattice "), t(k % 4 + 1), F.lit(" 5 3\n" + uid + "2 { Module:Filter_"), t(k % 3), F.lit(' { Parameter:size "'), t(k), F.lit('" Parameter:kind "a" } Label "L'), t(k), F.lit('" Version "9.1" }\n' + uid + "3 { Module:Crop { } }\nBoundingBox 0 "),
        t(k), F.lit(" 0 "), t(2 * k), F.lit(" 0 "), t(3 * k), F.lit(",\nBoundingBox 0 9 0 9 0 9,\nLattice { ushort Data } @1(HxZip,7)"),
    )
    return read("supplier").select(F.concat(F.lit("s"), t(k)).alias("scan_file"), text.alias("header"))


@on_tables
def am_history(read):
    from ..sources.readers import history

    h = history(_headers(read))
    return h.select("scan_file", "step_order", "module", "label", F.col("version"), F.element_at("parameters", "size").alias("size"))


@on_tables
def am_voxel_size(read):
    from ..sources import readers as S

    header = F.col("header")
    h = _headers(read).select("scan_file", S.header_dtype(header).alias("dtype"), S.header_codec(header).alias("codec"), S.lattice_box(header).alias("b"), S.header_spacing(header, F.lit(4), F.lit(1), F.lit(10)).alias("s"))
    return h.select("scan_file", "dtype", "codec", "b.nz", "b.ny", "b.nx", F.round("b.dz", 6).alias("dz"), F.round("b.dy", 6).alias("dy"), F.round("b.dx", 6).alias("dx"), F.round("s.dz", 6).alias("last_dz"), F.round("s.dy", 6).alias("last_dy"), F.round("s.dx", 6).alias("last_dx"))


@on_tables
def saturation_ref(read):
    """Scans aligned with reference rows by numeric prefix; of repeated prefixes the last row counts."""
    k = F.col("s_suppkey").cast("int")
    scans = read("supplier").select(k.alias("scan_index"), F.concat(F.lit("8_"), k.cast("string"), F.lit("_sub.am")).alias("file_name"))
    ref = read("supplier").select(k.alias("row_number"), F.concat(F.lit("8_"), (k % 40).cast("string")).alias("name"), (k % 100 / 100).alias("sg"), (k * 2.0).alias("elapsed_minutes"))
    return rounded(T.align_reference(scans, ref), "sw_ref", places=6)


@on_tables
def path_resolution(read):
    """Paths stored on one machine, found among the files of another by their longest common end."""
    from ..sources.readers import resolve_paths

    k, p = F.col("s_suppkey"), F.col("p_partkey")
    t = lambda c: c.cast("string")
    stored = read("supplier").select(F.concat(F.lit("D:\\Out\\R"), t(k % 4), F.lit("\\S"), t(k % 7), F.lit("\\Domain_"), t(k), F.lit(".raw")).alias("path"))
    files = read("part").select(F.concat(F.lit("/data/"), F.when(p % 3 == 0, F.concat(F.lit("r"), t(p % 4), F.lit("/"))).otherwise(F.lit("")), F.lit("s"), t(p % 7), F.lit("/domain_"), t(p % 120), F.lit(".raw")).alias("path"))
    return resolve_paths(stored, files)


def stream_sw_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rounded(windows.final_state(windows.windowed_mean(events)), "mean_value", places=6)


FOUND["stream_sw_windows"] = stream_sw_windows


def stream_sw_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation of the growing volume, whose runs arrive dealt over files: every scan in pieces, over several batches."""
    folder = table_path(spark, "arriving")
    volumes.encoded(spark, sf_dir).withColumn("part", (F.col("z") + F.col("y")) % 3).repartition("part").drop("part").write.parquet(folder)
    runs = spark.readStream.schema(RL.RUNS).option("maxFilesPerTrigger", 1).parquet(folder)
    return rounded(windows.latest_rows(windows.arriving_saturation(runs), ["scan_index"]), "sw")


FOUND["stream_sw_arriving"] = stream_sw_arriving


@query
def stream_track_clusters(c):
    """Forward tracks of the largest clusters, whose scans arrive in two batches."""
    folder, found = table_path(c.spark, "clusters"), all_clusters(c)
    for part in (F.col("scan_index") < 3, F.col("scan_index") >= 3):
        found.where(part).coalesce(1).write.mode("append").parquet(folder)
    clusters = c.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    tracks = windows.latest_rows(windows.arriving_tracks(clusters, 4.0), ["series", "track_id"], windows.ROCKS)
    return rounded(tracks, "cog_z", "cog_y", "cog_x", places=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return FOUND | volumes.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | volumes.oracle_sql()


