"""Queries on a volume that grows with the tables, and their SQL forms over the same voxels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import SHAPE, grown_depth, grown_slices
from ..operators import components as C
from ..operators import runs as RL
from ..operators import spans
from ..operators import voxels as V

SIDE, LINES = 128, 9375
ROW = ["scan_index", "z", "y"]


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.runs_from_slices(grown_slices(spark, sf_dir, SIDE, LINES))


def gas(runs: DataFrame, earlier: int = 0) -> DataFrame:
    """Gas runs of every scan, or of the one ``earlier`` scans on under its own number."""
    return runs.where("label = 2").select((F.col("scan_index") - earlier).alias("scan_index"), "z", "y", "x0", "x1").where("scan_index >= 0")


def volume_runs_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir)


def volume_sw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sw_series(encoded(spark, sf_dir)).withColumn("sw", F.round("sw", 9))


def volume_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = encoded(spark, sf_dir)
    return V.overlap_counts(gas(runs), gas(runs, 1), ["scan_index"])


def volume_cca_26n(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = (grown_depth(spark, sf_dir, LINES), SIDE, SIDE)
    return C.component_sizes(C.label_components(encoded(spark, sf_dir), 26, slab_depth=4, shape=shape))


def volume_percolation_6n(spark: SparkSession, sf_dir: str) -> DataFrame:
    nz = grown_depth(spark, sf_dir, LINES)
    return C.percolation(C.label_components(encoded(spark, sf_dir), 6, slab_depth=4, shape=(nz, SIDE, SIDE)), ["scan_index"], 0, nz)


def volume_mip_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest label along z as runs of the image."""
    return V.projection(encoded(spark, sf_dir), "z")


def volume_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over which a scan has gas, as runs."""
    return V.footprint(gas(encoded(spark, sf_dir)), ["scan_index"])


def volume_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels at the gas's surface, by slice."""
    return V.z_profile(V.surface(gas(encoded(spark, sf_dir)), ["scan_index"]), ["scan_index"])


def volume_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which the gas of a scan and of the next one differ: 2 only the first, 3 only the second."""
    runs = encoded(spark, sf_dir)
    last = F.col("scan_index") < SHAPE[0] - 1
    return V.overlap(gas(runs).where(last), gas(runs, 1), ["scan_index"]).where("value > 1")


def volume_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stride_sample(encoded(spark, sf_dir), 5)


def canvas_masks(runs: DataFrame) -> DataFrame:
    """Gas of the first scans as masks whose bounding boxes begin at different places; keyed by the parity of the slices."""
    half = (F.col("z") % 2).alias("half")
    one = lambda name, scan, where: runs.where(f"label = 2 AND scan_index = {scan} AND {where}").select(half, F.lit(name).alias("mask"), "z", "y", "x0", "x1")
    return one("a", 0, "z >= 1 AND y >= 3").unionByName(one("b", 1, "y >= 9")).unionByName(one("c", 2, "x0 >= 20"))


def volume_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the canvas that three masks share."""
    return V.shared_canvas(canvas_masks(encoded(spark, sf_dir)), ["half"], "b")[1]


def volume_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of every combination of three masks on their canvas."""
    moved, _ = V.shared_canvas(canvas_masks(encoded(spark, sf_dir)), ["half"], "b")
    return V.overlay_parts(moved, ["half"], ["a", "b", "c"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (volume_runs_encode, volume_sw_series, volume_overlap, volume_cca_26n, volume_percolation_6n, volume_mip_z, volume_footprint, volume_surface, volume_disagreement, volume_stride_sample, volume_canvas, volume_overlay)
    return {f.__name__: f for f in found}


def islands(of: str, row: str, value: str = "") -> str:
    """Maximal runs of the voxels ``of`` in each row, of equal ``value``."""
    more = f", {value}" if value else ""
    return f"SELECT {row}, min(x)::INT AS x0, max(x)::INT AS x1{more} FROM (SELECT {row}, x{more}, x - row_number() OVER (PARTITION BY {row}{more} ORDER BY x) AS g FROM ({of})) GROUP BY {row}{more}, g"


def oracle_sql() -> dict[str, str]:
    grown = f"""WITH RECURSIVE depth AS (SELECT greatest(4, count(*) // {LINES}) AS nz FROM lineitem),
    vox AS (SELECT s.range::INT AS scan_index, z.range::INT AS z, y.range::INT AS y, x.range::INT AS x, xor(xor(z.range // 3 * 73856093, y.range // 4 * 19349663), x.range // 6 * 83492791) % 101 AS m
      FROM range({SHAPE[0]}) s, range(100000) z, range({SIDE}) y, range({SIDE}) x WHERE z.range < (SELECT nz FROM depth)),
    lab AS (SELECT scan_index, z, y, x, CASE WHEN m < 46 - 5 * scan_index THEN 2 WHEN m < 70 THEN 1 ELSE 0 END AS label FROM vox),
    gas AS (SELECT scan_index, z, y, x FROM lab WHERE label = 2)"""
    later = "SELECT scan_index - 1 AS scan_index, z, y, x FROM gas WHERE scan_index > 0"
    # components of the boxes of one label, each known by its first voxel; the voxels of a box hang together
    linked = lambda level: f""",
    box AS (SELECT scan_index, z // 3 AS bz, y // 4 AS by, x // 6 AS bx, count(*) AS n, min((z * {SIDE} + y) * {SIDE} + x)::BIGINT AS id, bool_or(z = 0) AS lo, bool_or(z = (SELECT nz FROM depth) - 1) AS hi FROM gas GROUP BY ALL),
    near AS (SELECT a.scan_index, a.id, b.id AS other FROM box a JOIN box b ON a.scan_index = b.scan_index AND b.bz BETWEEN a.bz - 1 AND a.bz + 1 AND b.by BETWEEN a.by - 1 AND a.by + 1 AND b.bx BETWEEN a.bx - 1 AND a.bx + 1 WHERE abs(a.bz - b.bz) + abs(a.by - b.by) + abs(a.bx - b.bx) BETWEEN 1 AND {level}),
    reach AS (SELECT scan_index, id, id AS root FROM box UNION SELECT r.scan_index, e.other, r.root FROM reach r JOIN near e ON r.scan_index = e.scan_index AND r.id = e.id AND r.root < e.other),
    rooted AS (SELECT scan_index, id, min(root) AS component FROM reach GROUP BY ALL),
    comp AS (SELECT scan_index, component, sum(n)::BIGINT AS n, bool_or(lo) AND bool_or(hi) AS spans FROM box JOIN rooted USING (scan_index, id) GROUP BY ALL)"""  # noqa: E731
    inside = " AND ".join(f"EXISTS (SELECT 1 FROM gas n WHERE n.scan_index = g.scan_index AND n.z = g.z + {dz} AND n.y = g.y + {dy} AND n.x = g.x + {dx})" for dz, dy, dx in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    # where a run of gas begins from column 20 on, all of it is in the mask
    begins = "SELECT *, x - row_number() OVER (PARTITION BY scan_index, z, y ORDER BY x) AS g FROM gas WHERE scan_index = 2"
    canvas = f"""{grown}, m AS (SELECT z % 2 AS half, 'a' AS mask, z, y, x FROM gas WHERE scan_index = 0 AND z >= 1 AND y >= 3 UNION ALL SELECT z % 2, 'b', z, y, x FROM gas WHERE scan_index = 1 AND y >= 9
      UNION ALL SELECT z % 2, 'c', z, y, x FROM (SELECT *, min(x) OVER (PARTITION BY z, y, g) AS x0 FROM ({begins})) WHERE x0 >= 20),
    low AS (SELECT half, mask, min(z) AS z0, min(y) AS y0, min(x) AS x0 FROM m GROUP BY ALL),
    moved AS (SELECT m.half, m.mask, (m.z + f.z0 - l.z0)::INT AS z, (m.y + f.y0 - l.y0)::INT AS y, (m.x + f.x0 - l.x0)::INT AS x FROM m JOIN low l ON l.half = m.half AND l.mask = m.mask JOIN low f ON f.half = m.half AND f.mask = 'b')"""
    series = f"{grown} SELECT scan_index, count(*) FILTER (label = 2) AS gas, count(*) FILTER (label = 1) AS brine, round(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label > 0), 0)::DOUBLE, 9) AS sw FROM lab WHERE label > 0 GROUP BY 1"
    return {
        "stream_sw_arriving": series,
        "volume_canvas": f"{canvas} SELECT half, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM moved GROUP BY half",
        "volume_overlay": f"{canvas} SELECT half, parts, count(*) AS n FROM (SELECT half, string_agg(mask, '+' ORDER BY mask) AS parts FROM moved GROUP BY half, z, y, x) GROUP BY ALL",
        "volume_runs_encode": f"{grown} {islands('SELECT * FROM lab WHERE label > 0', 'scan_index, z, y', 'label')}",
        "volume_sw_series": series,
        "volume_overlap": f"{grown} SELECT scan_index, count(a) FILTER (b) AS n_both, count(a) FILTER (b IS NULL) AS only_a, count(b) FILTER (a IS NULL) AS only_b FROM (SELECT *, TRUE AS a FROM gas) FULL JOIN (SELECT *, TRUE AS b FROM ({later})) USING (scan_index, z, y, x) GROUP BY 1",
        "volume_cca_26n": f"{grown}{linked(3)} SELECT scan_index, component, n FROM comp",
        "volume_percolation_6n": f"{grown}{linked(1)} SELECT scan_index, count(*) AS n_components, count(*) FILTER (spans) AS spanning_count, max(n) AS largest FROM comp GROUP BY 1",
        "volume_mip_z": f"{grown} {islands('SELECT scan_index, y, x, max(label) AS label FROM lab WHERE label > 0 GROUP BY ALL', 'scan_index, y', 'label')}",
        "volume_footprint": f"{grown} {islands('SELECT DISTINCT scan_index, y, x FROM gas', 'scan_index, y')}",
        "volume_surface": f"{grown} SELECT scan_index, z, count(*) AS area FROM gas g WHERE NOT ({inside}) GROUP BY ALL",
        "volume_disagreement": f"{grown} {islands(f'SELECT scan_index, z, y, x, CASE WHEN b IS NULL THEN 2 ELSE 3 END AS value FROM (SELECT *, TRUE AS a FROM gas WHERE scan_index < {SHAPE[0] - 1}) FULL JOIN (SELECT *, TRUE AS b FROM ({later})) USING (scan_index, z, y, x) WHERE a IS NULL OR b IS NULL', 'scan_index, z, y', 'value')}",
        "volume_stride_sample": f"{grown} SELECT scan_index, z, y, x, label FROM lab WHERE label > 0 AND z % 5 = 0 AND y % 5 = 0 AND x % 5 = 0",
    }
