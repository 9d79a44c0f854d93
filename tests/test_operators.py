import itertools
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespan.config import Config
from porespan.fixtures import grown_slices
from porespan.functions import names as N
from porespan.operators import boxes as B
from porespan.operators import catalog as R
from porespan.operators import compare, fitting
from porespan.operators import components as C
from porespan.operators import regime as T
from porespan.operators import runs as RL
from porespan.operators import voxels as V
from porespan.schema import KEYS, conform, duplicate_keys
from porespan.sources import readers, tiff, writers
from porespan.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_config_rejects_bad_values():
    assert Config().n_keep == 8
    for bad in ({"n_keep": 0}, {"connectivity": 8}, {"regime_cutoff": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_schema_conform_and_keys(spark):
    df = spark.createDataFrame([("r1", 0), ("r1", 0)], "run_id string, scan_index int")
    full = conform(df, "scans")
    assert full.columns[:2] == ["run_id", "scan_index"] and full.first().sw is None
    assert duplicate_keys(full, "scans").first().n == 2 and KEYS["scans"]


def test_scan_prefix(spark):
    p = lambda x, **k: one(spark, N.scan_prefix(F.lit(x), **k))
    assert (p("8_2_sub"), p("8_2"), p("10_0x"), p("abc"), p("abc", whole=True)) == ("8_2", "8_2", "10", "", "abc")


def test_domain_names_round_trip(spark):
    name = one(spark, N.domain_name(F.lit("gas"), F.lit(3), F.lit(7), F.lit(4.99684e-6), F.lit(750), F.lit(750), F.lit(523)))
    assert name == "domain_gas_03-7_4.99684um_8bu_750x750x523.raw"
    assert one(spark, N.domain_name(F.lit("gas"), F.lit(3), F.lit(7), F.lit(None).cast("double"), F.lit(1), F.lit(2), F.lit(3))).split("_")[3] == "5um"
    p = one(spark, N.parse_domain(F.lit(name.upper())))
    assert (p.kind, p.track, p.scan, p.voxel_um, p.nx, p.nz) == ("gas", 3, "7", 4.99684, 750, 523)
    assert one(spark, N.parse_domain(F.lit("domain_gas_3_5um.raw"))) is None


def test_int_list(spark):
    f = lambda x: one(spark, N.int_list(F.lit(x).cast("string")))
    assert f("1,2, 5") == [1, 2, 5] and f("0-3,2") == [0, 1, 2, 3] and f(" ALL ") is None and f("") is None and f(None) is None


def test_formats(spark):
    assert one(spark, N.clock(F.lit(75.0))) == "1:15" and one(spark, N.clock(F.lit(3661.0))) == "1:01:01"
    assert one(spark, N.short_count(F.lit(1500))) == "1.5K" and one(spark, N.short_count(F.lit(12))) == "12"
    used: set = set()
    assert N.sheet_name("a[b]:c" + "x" * 40, used) == ("a_b__c" + "x" * 40)[:31]
    assert len(N.sheet_name("A[b]:c" + "x" * 40, used)) <= 31 and len(used) == 2


def test_runs_and_slices_round_trip(spark):
    rng = np.random.default_rng(0)
    vol = rng.integers(0, 3, size=(4, 3, 9), dtype=np.uint8)
    vol[2] = 0
    slices = spark.createDataFrame([(0, z, 3, 9, bytearray(vol[z].tobytes())) for z in range(4)], "scan_index int, z int, ny int, nx int, labels binary")
    runs = RL.runs_from_slices(slices)
    voxels = {(r.z, r.y, r.x): r.label for r in RL.voxels_from_runs(runs).collect()}
    assert voxels == {(z, y, x): int(vol[z, y, x]) for z, y, x in np.ndindex(vol.shape) if vol[z, y, x]}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(RL.runs_from_voxels(RL.voxels_from_runs(runs))) == rows(runs)
    back = {r.z: bytes(r.labels) for r in RL.slices_from_runs(runs, 4, 3, 9).collect()}
    assert back == {z: vol[z].tobytes() for z in (0, 1, 3)}


def test_saturation_edges(spark):
    runs = spark.createDataFrame([(0, 0, 0, 0, 4, 1), (1, 0, 0, 0, 4, 2), (2, 0, 0, 0, 0, 7)], RL.RUNS)
    assert {r.scan_index: r.sw for r in V.sw_series(runs).collect()} == {0: 1.0, 1: 0.0, 2: None}


@pytest.mark.parametrize("columns,shift", [([*range(3), *range(13, 16)], 13), (list(range(4, 12)), 0), (list(range(16)), 0)])
def test_wrap_around(spark, columns, shift):
    v = spark.createDataFrame([(0, 0, y, x, 1) for y in range(4) for x in columns], "scan_index int, z int, y int, x int, label int")
    runs = RL.runs_from_voxels(v)
    s = V.x_shift(runs, 16)
    assert s.first().shift == shift
    rolled = V.roll_x(runs, s, 16)
    assert rolled.agg(F.sum(RL.length())).first()[0] == 4 * len(columns)


def test_flow_crop_spans_thin_middle(spark):
    p = spark.createDataFrame([(0, 10), (1, 0), (2, 9), (3, 1)], "z int, area int").withColumn("k", F.lit(1))
    r = V.flow_crop(p, ["k"], 0.5).first()
    assert (r.z0, r.z1) == (0, 3)


def brute_fit(x, y):
    def sse(a, b):
        xs, ys = np.array(x[a : b + 1]), np.array(y[a : b + 1])
        if np.ptp(xs) == 0:
            return float(((ys - ys.mean()) ** 2).sum())
        p = np.polyfit(xs, ys, 1)
        return float(((ys - np.polyval(p, xs)) ** 2).sum())

    n = len(x)
    return min((round(sse(0, i) + sse(i, j) + sse(j, n - 1), 12), i, j) for i in range(1, n - 2) for j in range(i + 1, n - 1))


def test_regime_fit_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = sorted(rng.uniform(1, 200, size=9).tolist())
    y = rng.uniform(0, 1, size=9).tolist()
    pts = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "series string, scan_index int, x double, y double")
    r = T.three_segments(pts, ["series"]).first()
    want = brute_fit([0.0, *x], [0.0, *y])
    assert (r.i, r.j) == want[1:] and abs(r.sse - want[0]) < 1e-9
    assert T.three_segments(pts.where("scan_index < 2"), ["series"]).count() == 0


def test_regime_without_variance_in_x(spark):
    pts = spark.createDataFrame([("a", i, float(i), 0.1 * i) for i in range(6)], "series string, scan_index int, x double, y double")
    seg = T.segments(pts, ["series"]).where("a = 0 AND b = 1").first()
    assert seg.slope is None and seg.sse == pytest.approx(0.0)
    step = T.timestep_x(pts.where("scan_index < 2"), T.three_segments(pts.where("scan_index < 2"), ["series"]), ["series"]).first()
    assert step.x_scan == 1


def test_reference_rows_last_duplicate_wins(spark):
    scans = spark.createDataFrame([(0, "8_2_a.am"), (1, "9_1.am")], "scan_index int, file_name string")
    ref = spark.createDataFrame([(1, "8_2_x", 0.5, 1.0), (2, "8_2", 0.25, 2.0)], "row_number int, name string, sg double, elapsed_minutes double")
    got = {r.scan_index: (r.elapsed_minutes, r.sw_ref) for r in T.align_reference(scans, ref).collect()}
    assert got == {0: (2.0, 0.75), 1: (None, None)}


def test_tracker_rules():
    t = B.Tracker(distance=5)
    assert t.step(3, [(9, 0, 0, 0), (4, 10, 0, 0)], True) == [0, 1]
    assert t.step(2, [(8, 1, 0, 0), (3, 2, 0, 0), (1, 50, 0, 0)], False) == [0, 0, None]
    assert t.tracks[1]["status"] == "lost"
    assert t.step(1, [(4, 10, 0, 0)], False) == [None]
    assert t.tracks[0]["status"] == "lost" and t.tracks[0]["timesteps_seen"] == 3


def test_greedy_match():
    left = [(1, 10, 0, 0, 0), (2, 20, 1, 0, 0)]
    right = [(7, 1, 1, 0, 0), (8, 1, 100, 0, 0)]
    assert compare.match_greedy(left, right, 5) == [(2, 7, 0.0), (1, None, None), (None, 8, None)]


@pytest.mark.parametrize("k0,n,c", [(0.7, 3.0, 0.2), (0.9, 2.2, 0.0), (0.25, 5.5, 0.4)])
def test_fit_recovers_parameters(k0, n, c):
    b = np.linspace(0.02, 1, 25)
    v = k0 * b**n + c / (1 + c) * b
    f = fitting.fit_corey(b, v, np.full(25, 0.01), ((0.2, 1), (2, 6), (0, 0.5)))
    assert (f.k0, f.n, f.c) == (pytest.approx(k0, abs=2e-3), pytest.approx(n, abs=2e-2), pytest.approx(c, abs=2e-3)) and f.rmse < 1e-4


def test_fit_edges():
    bounds = ((0.2, 1), (2, 6), (0, 0.5))
    assert fitting.fit_corey([1, 2], [1, 2], [1, 1], bounds) is None
    f = fitting.fit_corey([0.2, 0.5, 0.9, 1.0], [2, 2, 2, 2], [1, 1, 1, 1], bounds)
    assert {"k0", "n"} & set(f.at_bound)
    assert fitting.band(f, np.linspace(0, 1, 3), bounds) is None or "n" not in f.at_bound
    flat = fitting.fit_corey([0.5] * 4, [0.3, 0.3, 0.31, 0.29], [0.1] * 4, bounds)
    assert flat.cov is None


def test_upserts(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, None), (3, 3.0)], "k int, v double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.insert_ignore(t, new, ["k"])) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert rows(R.upsert(t, new, ["k"])) == [(1, 1.0), (2, None), (3, 3.0)]
    assert rows(R.update(t, new, ["k"], ["v"])) == [(1, 1.0), (2, 2.0)]


def test_run_id():
    from datetime import datetime

    assert R.new_run_id(datetime(2026, 1, 2, 3, 4, 5), "host.with-a-very-long-name") == "20260102_030405_hostwith-a-very-"


HEADER = """# Avizo
define Lattice 5 4 3
UID:12345678-1234-1234-1234-123456789012 { Module:Filter_One { Parameter:size "3" Parameter:size "5" Parameter:kind "x" } Label "L1" Version "9.1" Date "d1" }
UID:12345678-1234-1234-1234-123456789013 { nothing }
UID:12345678-1234-1234-1234-123456789014 { Module:Crop { } }
BoundingBox 0 4 0 3 0 2,
BoundingBox 0 8 0 6 0 4,
Lattice { byte Data } @1%s
@1
"""


def test_headers_and_volumes(spark, tmp_path):
    vol = np.arange(60, dtype=np.uint8).reshape(3, 4, 5) % 3
    (tmp_path / "8_10_a.am").write_bytes(HEADER.replace("%s", "").encode() + vol.tobytes())
    (tmp_path / "8_2_a.am").write_bytes(HEADER.replace("%s", "(HxZip,9)").encode() + zlib.compress(vol.tobytes()))
    rle = b"".join(bytes([1, v]) for v in vol.tobytes())
    (tmp_path / "notes.am").write_bytes(HEADER.replace("%s", "(HxByteRLE,9)").encode() + rle)
    found = readers.discover_scans(spark, str(tmp_path)).orderBy("scan_index").collect()
    assert [r.name for r in found] == ["8_2_a.am", "8_10_a.am", "notes.am"]
    with pytest.raises(FileNotFoundError):
        readers.discover_scans(spark, str(tmp_path), "*.zzz")
    got = {(r.name, r.z): bytes(r.labels) for r in readers.read_volumes(spark, f"{tmp_path}/*.am").collect()}
    assert got == {(n, z): vol[z].tobytes() for n in ("8_10_a.am", "8_2_a.am", "notes.am") for z in range(3)}
    spark.dataSource.register(readers.LabelVolume)
    for name in ("8_10_a.am", "8_2_a.am"):
        df = spark.read.format("labelvolume").option("path", str(tmp_path / name)).option("depth", 1).option("z0", 1).load()
        assert {r.z: bytes(r.labels) for r in df.collect()} == {z: vol[z].tobytes() for z in (1, 2)}
        assert df.rdd.getNumPartitions() == (2 if name == "8_10_a.am" else 1)
    h = readers.headers(spark, str(tmp_path / "8_2_a.am"))
    r = h.select(readers.header_dtype(F.col("header")).alias("d"), readers.header_codec(F.col("header")).alias("c"), readers.header_spacing(F.col("header"), F.lit(3), F.lit(4), F.lit(1)).alias("s"), readers.lattice_box(F.col("header")).alias("b")).first()
    assert (r.d, r.c, tuple(r.s)) == ("byte", "hxzip", (2.0, 2.0, 8.0))
    assert (r.b.nz, r.b.ny, r.b.nx, r.b.dz) == (3, 4, 5, 1.0)
    steps = readers.history(h).orderBy("step_order").collect()
    assert [(s.step_order, s.module, s.label) for s in steps] == [(1, "Filter_One", "L1"), (2, "Crop", None)]
    assert steps[0].parameters == {"size": "5", "kind": "x"}


def test_baseline_workbook(spark, tmp_path):
    """The sheet is found by its name, not by its place; its points, permeabilities and curve are read."""
    import zipfile

    def column(n):
        return (chr(64 + (n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)

    def sheet(rows):
        cells = lambda r, row: "".join(f'<c r="{column(c)}{r}"><v>{v}</v></c>' for c, v in row.items())
        return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in rows.items()) + "</sheetData></worksheet>"

    curve = {55: 0.1, 56: 0.39, 57: 0.14, 58: 0.77, 59: 3.9, 60: 3.3}
    main = {5: {4: 0, 5: 370} | curve, 6: {4: 7, 11: 0.5, 12: 0.1, 13: 0.4, 14: 0.61}, 7: {4: 8, 5: 380, 13: 0.3}}
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="rId1"/><sheet name="Complete tables" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet({5: {4: 9, 5: 1}}))
        z.writestr("xl/worksheets/sheet2.xml", sheet(main))
    path = str(tmp_path / "b.xlsx")
    got = sorted((r.scan, r.kr_gas, r.kr_brine, round(r.sw_a, 9), r.sw_b) for r in readers.baseline_points(spark, path).collect())
    assert got == [(7, 0.5, 0.1, 0.6, 0.61), (8, None, None, 0.7, None)]
    assert sorted(r.k_abs_md for r in readers.baseline_kabs(spark, path).collect()) == [370.0, 380.0]
    assert [r.asDict() for r in readers.baseline_curve(spark, path).collect()] == [{"swc": 0.1, "snr": 0.39, "krw0": 0.14, "krn0": 0.77, "nw": 3.9, "nn": 3.3}]
    assert readers.workbook(spark, path, "No such sheet").count() == 0


def test_raw_volume_source(spark, tmp_path):
    vol = np.arange(24, dtype=np.uint8).reshape(4, 2, 3)
    (tmp_path / "v.raw").write_bytes(vol.tobytes())
    spark.dataSource.register(readers.RawVolume)
    df = spark.read.format("rawvolume").option("path", str(tmp_path / "v.raw")).option("ny", 2).option("nx", 3).option("depth", 3).load()
    assert {r.z: bytes(r.labels) for r in df.collect()} == {z: vol[z].tobytes() for z in range(4)}
    assert df.rdd.getNumPartitions() == 2
    by_any_store = readers.raw_slices(readers.raw_volumes(spark, str(tmp_path / "v.raw"), 2, 3))
    assert {r.z: bytes(r.labels) for r in by_any_store.collect()} == {z: vol[z].tobytes() for z in range(4)}
    with pytest.raises(Exception, match="whole"):
        readers.raw_volumes(spark, str(tmp_path / "v.raw"), 5, 3).collect()


def test_grown_volume(spark, sf):
    """Runs of the growing volume hold its voxels, and components don't depend on slabs."""
    slices = grown_slices(spark, sf, side=24)
    raw = {(r.scan_index, r.z): np.frombuffer(r.labels, np.uint8) for r in slices.collect()}
    encoded = RL.runs_from_slices(slices)
    got = {r.scan_index: (r.gas, r.brine) for r in V.sw_series(encoded).collect()}
    assert len(raw) == 7 * 4 and got == {s: tuple(int(sum((v == k).sum() for (t, _), v in raw.items() if t == s)) for k in (2, 1)) for s in range(7)}
    by_depth = [sorted(map(tuple, C.component_sizes(C.label_components(encoded, 26, slab_depth=d)).collect())) for d in (1, 64)]
    assert by_depth[0] == by_depth[1]


def tiff_file(order, pages, wide=False):
    """A TIFF file of pages (tags, strips): every value as the format says, offsets and counts in arrays."""
    offset, count = ("Q", "Q") if wide else ("I", "H")
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if wide else struct.pack(order + "HI", 42, 0)))
    link = 8 if wide else 4
    for tags, strips in pages:
        starts = []
        for strip in strips:
            starts.append(len(out))
            out += strip
        entries = b""
        for tag, values in sorted((tags | {273: starts, 279: [len(x) for x in strips]}).items()):
            data = struct.pack(f"{order}{len(values)}{'I' if tag in (273, 279) else 'H'}", *values)
            if len(data) > (8 if wide else 4):
                at, data = len(out), out.extend(data) or b""
                data = struct.pack(order + offset, at)
            entries += struct.pack(order + "HH" + offset, tag, 4 if tag in (273, 279) else 3, len(values)) + data.ljust(8 if wide else 4, b"\0")
        out[link : link + (8 if wide else 4)] = struct.pack(order + offset, len(out))
        out += struct.pack(order + count, len(tags) + 2) + entries
        link = len(out)
        out += bytes(8 if wide else 4)
    return bytes(out)


def lzw(data):
    """The format's encoder, cleared where its table is full."""
    codes, table, width, word = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    for i in range(len(data)):
        b = data[i : i + 1]
        if word + b in table:
            word += b
            continue
        codes.append((table[word], width))
        table[word + b] = len(table) + 2
        if len(table) + 2 in (512, 1024, 2048):
            width += 1
        if len(table) + 2 == 4094:
            codes.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = b
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (table[word], width)])
    bits += f"{257:0{width + (len(table) + 3 in (512, 1024, 2048))}b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_tiff_stacks(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (5, 70, 90), dtype=np.uint8)
    rgb = np.stack([a[0], a[1], a[2]], axis=-1)
    base = {256: [90], 257: [70], 258: [8], 262: [1], 277: [1]}
    two = lambda x, f=bytes: [f(x[:40].tobytes()), f(x[40:].tobytes())]
    equal = lambda raw: [(b, len(list(g))) for b, g in itertools.groupby(raw)]
    runs = lambda raw: b"\x80".join(bytes([257 - n, b]) if n > 1 else bytes([0, b]) for b, n in equal(raw))
    diff = np.diff(a[4], axis=1, prepend=np.uint8(0)).astype(np.uint8)
    pages = [
        (base | {259: [1], 278: [40]}, two(a[0])),
        (base | {259: [32773], 278: [70]}, [runs(a[1].tobytes())]),
        (base | {259: [5], 278: [70]}, [lzw(a[2].tobytes())]),
        (base | {259: [8], 258: [16], 278: [40]}, None),
        (base | {259: [8], 317: [2], 278: [40]}, two(diff, zlib.compress)),
        (base | {259: [1], 258: [8, 8, 8], 262: [2], 277: [3], 278: [40]}, two(rgb)),
        (base | {259: [1], 258: [8, 8, 8], 262: [2], 277: [3], 278: [70], 284: [2]}, [a[i].tobytes() for i in (3, 0, 1)]),
        (base | {259: [1], 258: [1], 262: [0], 278: [70]}, [np.packbits(1 - a[0] // 2, axis=1).tobytes()]),
        (base | {259: [1], 262: [0], 278: [70]}, [(255 - a[1]).tobytes()]),
    ]
    want = [a[0], a[1], a[2], a[3], a[4], a[0], a[3], a[0] // 2, a[1]]
    for name, order, wide in (("le.tif", "<", False), ("be.tif", ">", False), ("big.tif", "<", True)):
        own = [(t, s or two(a[3].astype(order + "u2"), zlib.compress)) for t, s in pages]
        (tmp_path / name).write_bytes(tiff_file(order, own, wide))
    spark.dataSource.register(tiff.TiffStack)
    for name in ("le.tif", "be.tif", "big.tif"):
        df = spark.read.format("tiffstack").option("path", str(tmp_path / name)).option("depth", 4).load()
        assert df.rdd.getNumPartitions() == 3
        whole = tiff.read_stacks(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, whole))
        assert {r.z: bytes(r.labels) for r in whole} == {z: v.tobytes() for z, v in enumerate(want)}
    part = spark.read.format("tiffstack").option("path", str(tmp_path / "be.tif")).option("z0", 2).option("z1", 4).load()
    assert sorted(r.z for r in part.collect()) == [2, 3]
    (tmp_path / "wide.tif").write_bytes(tiff_file("<", [(base | {259: [1], 258: [16], 278: [70]}, [np.full((70, 90), 300, "<u2").tobytes()])]))
    with pytest.raises(Exception, match="0 to 255"):
        tiff.read_stacks(spark, str(tmp_path / "wide.tif")).collect()


def test_saturation_reference(spark, tmp_path):
    rows = ['8_2_a,,,,0.5,,,10', '8_3,,,,1.5,,,10', 'x,,,,0.5,,,1', '"8_4, b",,,,0.25,,,3', '8_5,,,,0.5,,,-1', '8_6,,,,0.5,,,10:30', '8_7,,,']
    (tmp_path / "s.csv").write_text("\ufeff" + "\n".join(rows))
    got = readers.saturation_reference(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.name, r.sg, r.elapsed_minutes) for r in got] == [("8_2_a", 0.5, 10.0), ("8_4, b", 0.25, 3.0)] or [(r.name, r.sg) for r in got] == [("8_2_a", 0.5)]


def test_solver_results(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"nx": 3, "permeability_z_m2": 1e-13}')
    (tmp_path / "b.json").write_text("{broken")
    r = readers.solver_summaries(spark, f"{tmp_path}/*.json").collect()
    assert sorted(x.nx or 0 for x in r) == [0, 3]
    (tmp_path / "r.txt").write_text("ReachedErrorBoundZ 0.02\nreachederrorboundz 0.01\nother 3\n")
    assert readers.solver_values(spark, str(tmp_path / "r.txt"), ["ReachedErrorBoundZ"]).first().value == "0.01"
    (tmp_path / "l.log").write_text("permeability = 1e-3\npermeability = 2e-3\npermeability = -1\n")
    assert readers.solver_log(spark, str(tmp_path / "l.log")).first().value == 2e-3


def test_writers(spark, tmp_path):
    runs = spark.createDataFrame([(0, 0, 0, 0, 1, 2), (0, 1, 1, 1, 2, 1)], RL.RUNS)
    box = spark.createDataFrame([(1, 0, 2, 0, 2, 0, 3)], "track_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    r = writers.domain_files(runs, box, "gas").first()
    want = np.ones((2, 2, 3), dtype=np.uint8)
    want[0, 0, :2] = 0
    assert bytes(r.content) == want.tobytes()
    m = writers.cluster_mask(runs.where("label = 2").withColumn("track_id", F.lit(1)), 2, 3, 5, margin=1).first()
    assert (m.z0, m.z1, sum(m.content)) == (0, 1, 2)
    writers.write_files(spark.createDataFrame([("a.raw", bytearray(b"xy"))], "name string, content binary"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "a.raw").read_bytes() == b"xy"
    folder = f"file://{tmp_path}/t"
    writers.save_version(runs, folder)
    writers.save_version(runs.limit(1), folder)
    assert writers.load_latest(spark, folder).count() == 1
    names = writers.write_sheets({"A": runs, "a": runs}, str(tmp_path / "x"))
    assert len(set(v.lower() for v in names.values())) == 2
    t = writers.latex_rows(spark.createDataFrame([("b_1", 1.5), ("a", None)], "k string, v double"), "k").first().latex
    assert t == "a & -- \\\\\nb\\_1 & 1.500 \\\\"


def test_resolve_paths(spark):
    stored = spark.createDataFrame([("C:\\x\\18N\\a.raw",), ("none.raw",)], "path string")
    files = spark.createDataFrame([("/data/18N/a.raw",)], "path string")
    got = {r.stored: r.found for r in readers.resolve_paths(stored, files).collect()}
    assert got == {"C:\\x\\18N\\a.raw": "/data/18N/a.raw", "none.raw": None}


def test_stream_saturation_and_tracks(spark, tmp_path):
    runs = spark.createDataFrame([(0, 0, 0, 0, 1, 2), (0, 1, 1, 1, 1, 1)], RL.RUNS)
    runs.write.parquet(str(tmp_path / "in"))
    windows.stream_saturation(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().sw == pytest.approx(1 / 3)
    schema = "series string, scan_index int, label_id int, n bigint, cog_z double, cog_y double, cog_x double"
    spark.createDataFrame([("s", 0, 1, 5, 0.0, 0.0, 0.0), ("s", 1, 1, 4, 1.0, 0.0, 0.0), ("s", 1, 2, 4, 90.0, 0.0, 0.0)], schema).coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = windows.stream_tracks(spark.readStream.schema(schema).parquet(str(tmp_path / "c")), 5.0)
    q = stream.writeStream.outputMode("append").format("memory").queryName("tracks_test").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.scan_index, r.label_id, r.track_id) for r in spark.table("tracks_test").collect())
    assert got == [(0, 1, 0), (1, 1, 0), (1, 2, None)]


def test_surface_and_blocks(spark):
    cube = [(z, y, x) for z in range(3) for y in range(3) for x in range(3)]
    v = spark.createDataFrame(cube, "z int, y int, x int")
    assert V.surface_voxels(v, []).count() == 26
    runs = spark.createDataFrame([(0, 0, 0, 3, 8, 2)], RL.RUNS)
    assert V.block_any(runs, 4).count() == 3
    assert math.isclose(V.centre_of_gravity(runs, ["scan_index"]).first().cog_x, 5.5)
