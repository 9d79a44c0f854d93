"""Versioned tables, nearest saturations, path tails, shared canvases and streams against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from porespan.operators import boxes as B
from porespan.operators import permeability as P
from porespan.operators import voxels as V
from porespan.sources import readers, versions
from porespan.streaming import windows
from tests.test_algebra import mask
from tests.test_plans import plan


@pytest.fixture
def table(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame([(i, f"r{i % 5}", float(i)) for i in range(200)], "k int, run_id string, v double"), ["k"], 16)
    return t


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_share_the_files_they_dont_touch(spark, table):
    before = table.manifest()
    assert table.upsert(spark.createDataFrame([(3, "new", -1.0), (1000, "new", -2.0)], "k int, run_id string, v double")) == 2
    after = table.manifest()
    changed = {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)}
    assert 1 <= len(changed) <= 2 and len(before["buckets"]) == 16
    files = lambda v: set(table.read(v).inputFiles())
    assert len(files(1) & files(2)) >= 14
    assert rows(table.read().where("k IN (3, 1000)")) == [(3, "new", -1.0), (1000, "new", -2.0)] and table.read().count() == 201
    assert rows(table.read(1)) == [(i, f"r{i % 5}", float(i)) for i in range(200)]


def test_inserts_updates_and_deletes(spark, table):
    new = spark.createDataFrame([(5, "x", 50.0), (700, "x", 7.0)], "k int, run_id string, v double")
    table.insert_ignore(new)
    table.update(spark.createDataFrame([(6, None), (7, 70.0)], "k int, v double"), ["v"])
    got = {k: v for k, _, v in rows(table.read())}
    assert (got[5], got[700], got[6], got[7]) == (5.0, 7.0, 6.0, 70.0) and len(got) == 201
    table.delete(spark.createDataFrame([(i,) for i in range(150)], "k int"))
    assert {k for k, _, _ in rows(table.read())} == {*range(150, 200), 700}
    assert table.upsert(new.limit(0)) == table.versions()[-1] == 4  # nothing to do, no version


def test_restore_and_clean(spark, table):
    first = rows(table.read())
    table.delete(spark.createDataFrame([(i,) for i in range(200)], "k int"))
    assert table.read().count() == 0 and table.read().columns == ["k", "run_id", "v"]
    assert table.restore(1) == 3 and rows(table.read()) == first and table.read(2).count() == 0
    table.upsert(spark.createDataFrame([(0, "z", 0.5)], "k int, run_id string, v double"))
    assert len(table.clean(2)) == 1 and table.versions() == [3, 4]  # what the delete wrote; the first version's data are still needed
    assert table.clean(1) == [] and rows(table.read())[0] == (0, "z", 0.5) and table.read().count() == 200
    with pytest.raises(ValueError):
        table.read(1)
    with pytest.raises(ValueError):
        table.clean(0)


def test_changes_from_one_version_conflict(spark, table):
    base = table.manifest()
    one = spark.createDataFrame([(1, "a", 1.5)], "k int, run_id string, v double")
    table.upsert(one, base)
    with pytest.raises(versions.VersionConflict):
        table.upsert(one.withColumn("v", F.lit(9.0)), base)
    assert rows(table.read().where("k = 1")) == [(1, "a", 1.5)]


def test_runs_are_deleted_everywhere_or_nowhere(spark, table, tmp_path):
    doomed = spark.createDataFrame([("r1",), ("r9",)], "run_id string")
    other = versions.VersionedTable(spark, f"file://{tmp_path}/o")
    other.create(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int"), ["run_id"], 4)
    assert versions.delete_runs({"a": table, "b": other}, doomed) == {"a": (1, 2), "b": (1, 2)}
    assert rows(other.read()) == [("r2", 2)] and table.read().where("run_id = 'r1'").count() == 0 and table.read().count() == 160
    broken = versions.VersionedTable(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        versions.delete_runs({"a": table, "b": broken}, spark.createDataFrame([("r2",)], "run_id string"))
    assert table.read().count() == 160  # restored


# -- nearest saturations


@pytest.mark.parametrize("per_range", [None, 7, 1])
def test_nearest_of_sorted_ranges(spark, per_range):
    rng = random.Random(3)
    theirs = [(i, round(rng.uniform(0.3, 0.6), 2), float(i), None) for i in range(40)] + [(40, None, 1.0, 1.0), (41, 0.9, 2.0, 0.0)]
    ours = [(i, s, 1.0, 1.0) for i, s in enumerate([0.0, 0.1, 0.305, 0.5, 0.5, 0.75, 1.0, None, *[rng.uniform(0, 1) for _ in range(60)]])]
    o, t = spark.createDataFrame(ours, "k int, sw double, kr_gas double, kr_brine double"), spark.createDataFrame(theirs, "ordinal int, sw double, kr_gas double, kr_brine double")
    got = {r.k: r.ordinal for r in P.nearest_saturation(o, t, ["k"], per_range).collect()}
    want = {k: min((round(abs(s - b), 12), i) for i, b, _, _ in theirs if b is not None)[1] for k, s, _, _ in ours if s is not None}
    assert got == want
    assert all(r.ordinal is None for r in P.nearest_saturation(o, t.limit(0), ["k"], per_range).collect())
    assert P.nearest_saturation(o.limit(0), t, ["k"]).count() == 0


def test_no_baseline_in_an_array(spark):
    o = spark.createDataFrame([(1, 0.5, 1.0, 1.0)], "k int, sw double, kr_gas double, kr_brine double")
    assert "collect_list" not in plan(P.nearest_saturation(o, o.withColumnRenamed("k", "ordinal"), ["k"]))


# -- paths


def test_longest_tail_wins(spark):
    stored = [r"C:\A\B\c.raw", r"c:\x\B\c.RAW", "q/c.raw", "none.raw", "b/c.raw", r"D:\z\e.raw"]
    files = ["/data/a/b/c.raw", "/data/k/b/c.raw", "/other/c.raw", "/m/z/e.raw", "/n/z/e.raw"]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "path string")
    got = {r.stored: (r.found, r.agreed, r.n_found) for r in readers.resolve_paths(df([*stored, stored[0]]), df([*files, files[0]])).collect()}
    assert got == {stored[0]: (files[0], 3, 1), stored[1]: (files[0], 2, 2), "q/c.raw": (None, None, 0), "none.raw": (None, None, 0), "b/c.raw": (files[0], 2, 2), stored[5]: ("/m/z/e.raw", 2, 2)}
    by_name = {r.stored: r.n_found for r in readers.resolve_paths(df(["q/c.raw"]), df(files), parts=1).collect()}
    assert by_name == {"q/c.raw": 3}


# -- canvas


def test_masks_on_one_canvas(spark):
    rng = random.Random(9)
    grid = [(z, y, x) for z in range(4) for y in range(5) for x in range(9)]
    sets = {n: {v for v in grid if rng.random() < 0.5 and v >= low} for n, low in (("a", (0, 0, 0)), ("b", (1, 2, 0)), ("c", (2, 0, 0)))}
    runs = None
    for n, s in sets.items():
        one = mask(spark, s).selectExpr("1 AS k", f"'{n}' AS mask", "*")
        runs = one if runs is None else runs.unionByName(one)
    moved, canvas = V.shared_canvas(runs, ["k"], "b")
    low = {n: [min(v[i] for v in s) for i in range(3)] for n, s in sets.items()}
    at = {n: {tuple(v[i] + low["b"][i] - low[n][i] for i in range(3)) for v in s} for n, s in sets.items()}
    every = set().union(*at.values())
    c = canvas.first()
    assert (c.z0, c.y0, c.x0) == tuple(low["b"]) and (c.z1, c.y1, c.x1) == tuple(max(v[i] for v in every) + 1 for i in range(3))
    want = {}
    for v in every:
        p = "+".join(n for n in sets if v in at[n])
        want[p] = want.get(p, 0) + 1
    assert {r.parts: r.n for r in V.overlay_parts(moved, ["k"], list(sets)).collect()} == want
    assert V.shared_canvas(runs, ["k"], "none")[1].count() == 0


# -- streams


def test_scans_that_arrive_in_pieces(spark, tmp_path):
    """Every batch tells the scans that it changed; the last row of a scan holds all its pieces."""
    pieces = [[(0, 0, 0, 0, 1, 2), (1, 0, 0, 0, 0, 1)], [(0, 1, 0, 0, 3, 1)], [(1, 1, 0, 5, 9, 2), (0, 2, 0, 0, 0, 2)]]
    for p in pieces:
        spark.createDataFrame(p, "scan_index int, z int, y int, x0 int, x1 int, label int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        windows.stream_saturation(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.batch, r.scan_index): (r.gas, r.brine) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, 0): (2, 0), (0, 1): (0, 1), (1, 0): (2, 4), (2, 0): (3, 4), (2, 1): (5, 1)}
    stream = spark.readStream.schema("scan_index int, z int, y int, x0 int, x1 int, label int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last = windows.latest_rows(windows.arriving_saturation(stream), ["scan_index"])
    assert {r.scan_index: r.sw for r in last.collect()} == {0: pytest.approx(4 / 7), 1: pytest.approx(1 / 6)}


def test_arriving_tracks_equal_the_forward_tracker(spark, tmp_path):
    rng = random.Random(12)
    schema = "series string, scan_index int, label_id int, n bigint, cog_z double, cog_y double, cog_x double"
    made = []
    for series in ("p", "q"):
        centres = [[rng.uniform(0, 40) for _ in range(3)] for _ in range(6)]
        for scan in range(6):
            there = [c for c in centres if rng.random() < 0.8]
            made += [(series, scan, i, rng.randrange(1, 99), *(x + rng.uniform(-1, 1) for x in c)) for i, c in enumerate(there, 1)]
    for scans in ((0,), (1, 2, 3), (4,), (5,)):
        spark.createDataFrame([r for r in made if r[1] in scans], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/c")
    got = {(r.series, r.track_id): tuple(r)[2:] for r in windows.latest_rows(windows.arriving_tracks(stream, 4.0), ["series", "track_id"], windows.ROCKS).collect()}
    want = {}
    for series in ("p", "q"):
        tracker = B.Tracker(4.0)
        for scan in range(6):
            part = [r[3:] for r in sorted(made) if r[0] == series and r[1] == scan]
            tracker.step(scan, part, scan == 0)
        for t, s in tracker.tracks.items():
            want[series, t] = (s["status"], s["first_seen"], s["last_seen"], s["timesteps_seen"], s["timesteps_lost"], s["final_voxels"], *s["cog"])
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in want.items()}
    assert all(math.isclose(a, b) for k in want for a, b in zip(got[k][6:], want[k][6:], strict=True))
    assert any(v[0] == "lost" for v in want.values())


# -- export


def test_sheets_of_a_run(spark):
    from porespan.operators import export
    from porespan.sources import writers

    at = "timestamp '2026-01-01 00:00:00'"
    runs = spark.sql(f"SELECT * FROM VALUES ('a', {at}), ('b', {at} + INTERVAL 1 DAY), ('c', {at} + INTERVAL 2 DAY) t(run_id, started_at)")
    results = spark.createDataFrame(
        [("b", 1, 1, "6", "absolute", 2e-13), ("b", 1, 1, "26", "Absolute", 4e-13), ("b", 2, 1, "6", "gas", 1.5e-13), ("b", 2, 1, "6", "Brine", 3e-14), ("b", 2, 1, "6", "water", 5e-14), ("b", 2, 2, "6", "gas", 1e-13), ("b", 3, 1, "6", "gas", None), ("a", 2, 1, "6", "gas", 9e-13)],
        "run_id string, scan_index int, track_id int, connectivity string, sim_type string, k_z double")
    boxes = spark.createDataFrame([("b", 2, 1, "6", 0.25), ("b", 2, 1, "26", None), ("a", 2, 1, "6", 0.9)], "run_id string, scan_index int, track_id int, connectivity string, sw_local double")
    other = spark.createDataFrame([(1,)], "x int")
    sheets = export.run_sheets({"runs": runs, "fixed_boxes": boxes, "simulation_results": results, "other": other})
    assert list(sheets) == ["run_overview", "summary_kr", "summary_kabs", "runs", "fixed_boxes", "simulation_results"]
    kr = {(r.track, r.scan): r for r in sheets["summary_kr"].collect()}
    assert set(kr) == {(1, 2), (2, 2)} and kr[1, 2].sw_local == 0.25
    assert (kr[1, 2].kr_gas, kr[1, 2].kr_brine) == (pytest.approx(0.5), pytest.approx(4 / 30)) and kr[2, 2].kr_gas is None and kr[2, 2].k_gas_md == pytest.approx(1e-13 / 9.869233e-13 * 1000)
    assert [(r.track, r.k_abs_m2) for r in sheets["summary_kabs"].collect()] == [(1, pytest.approx(3e-13))]
    facts = {r.field: r.value for r in sheets["run_overview"].collect()}
    assert facts["run_id"] == facts["runs.run_id"] == "b" and facts["n_rows.simulation_results"] == "7" and facts["n_sim_results"] == "6" and facts["connectivity_filter"] == "(all)"
    six = export.run_sheets({"runs": runs, "fixed_boxes": boxes, "simulation_results": results}, "b", "6")
    assert {r.track: r.k_abs_m2 for r in six["summary_kabs"].collect()} == {1: 2e-13} and six["simulation_results"].count() == 7
    assert "summary_kr" not in export.run_sheets({"runs": runs, "fixed_boxes": boxes, "simulation_results": results}, "c")
    with pytest.raises(ValueError):
        export.run_sheets({"runs": runs, "fixed_boxes": boxes, "simulation_results": results.limit(0)})
    assert writers.sheet_name("run_overview", set()) == "run_overview"
