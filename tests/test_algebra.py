"""Run algebra, exact percentiles and curve fits against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespan.operators import components as C
from porespan.operators import fitting, quantiles, spans
from porespan.operators import voxels as V
from tests.test_components import as_runs
from tests.test_plans import plan

ROW = ["z", "y"]


def mask(spark, voxels):
    return spark.createDataFrame(as_runs(voxels), "z int, y int, x0 int, x1 int")


def voxels_of(df, *more):
    """Voxels of runs, which have to be disjoint and maximal for equal values."""
    rows = [(r.z, r.y, r.x0, r.x1, *(r[m] for m in more)) for r in df.collect()]
    out = Counter((z, y, x, *v) for z, y, a, b, *v in rows for x in range(a, b + 1))
    assert all(n == 1 for n in out.values())
    starts = {(z, y, a, *v) for z, y, a, _, *v in rows}
    assert not any((z, y, b + 1, *v) in starts for z, y, _, b, *v in rows)
    return set(out)


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(8)
    grid = list(itertools.product(range(5), range(6), range(12)))
    a, b = ({v for v in grid if rng.random() < 0.55} for _ in range(2))
    return a, b, mask(spark, a), mask(spark, b)


def test_sets(two):
    a, b, ra, rb = two
    assert voxels_of(spans.union(ra, rb, ROW)) == a | b
    assert voxels_of(spans.intersection(ra, rb, ROW)) == a & b
    assert voxels_of(spans.difference(ra, rb, ROW)) == a - b
    assert voxels_of(spans.exclusive(ra, rb, ROW)) == a ^ b
    value = lambda v: 1 if v in a and v in b else 2 if v in a else 3
    assert voxels_of(spans.overlay(ra, rb, ROW), "value") == {(*v, value(v)) for v in a | b}
    assert voxels_of(spans.union(ra.unionByName(ra), rb.limit(0), ROW)) == a  # repeated and overlapping runs
    assert spans.union(ra.limit(0), rb.limit(0), ROW).count() == 0


def test_lengths_shared_with_a_mask(two):
    a, b, ra, rb = two
    got = {r.z: r.n for r in spans.shared_length(ra, rb, ROW, ["z"]).collect()}
    assert got == Counter(z for z, _, _ in a & b)


@pytest.mark.parametrize("labels", [[0, 1, 2], [-3, 7], list(range(5, 205))])
def test_greatest_label(spark, labels):
    """Also of more labels than one long has bits."""
    rng = random.Random(len(labels))
    vol = {(z, y, x): rng.choice(labels) for z, y, x in itertools.product(range(7), range(4), range(30)) if rng.random() < 0.6}
    runs = spark.createDataFrame([(0, z, y, x, x, v) for (z, y, x), v in vol.items()] + [(0, 0, 0, 0, 5, None)], "scan_index int, z int, y int, x0 int, x1 int, label int")
    got = spans.greatest_label(runs, ["scan_index", "y"])
    want = {}
    for (_, y, x), v in vol.items():
        want[y, x] = max(v, want.get((y, x), v))
    assert {(r.y, x): r.label for r in got.collect() for x in range(r.x0, r.x1 + 1)} == want
    assert spans.greatest_label(runs.limit(0), ["scan_index", "y"]).count() == 0


def test_surface_and_footprint(two):
    a, _, ra, _ = two
    beside = lambda v: [(v[0] + d[0], v[1] + d[1], v[2] + d[2]) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    assert voxels_of(V.surface(ra, [])) == {v for v in a if not all(n in a for n in beside(v))}
    assert {(r.y, x) for r in V.footprint(ra, []).collect() for x in range(r.x0, r.x1 + 1)} == {(y, x) for _, y, x in a}


def test_shapes_and_matches(spark, two):
    a, b, ra, rb = two
    lab = C.label_components(spans.exclusive(ra, rb, ROW).selectExpr("0 AS scan_index", "*", "2 AS label"), 6, slab_depth=2)
    only = spans.difference(ra, rb, ROW)
    parts = {}
    for r in lab.collect():
        parts.setdefault(r.component, []).extend((r.z, r.y, x) for x in range(r.x0, r.x1 + 1))
    for r in C.disagreement_shapes(lab, only.selectExpr("0 AS scan_index", "*"), ["scan_index"]).collect():
        p = parts[r.component]
        assert (r.n_vox, r.n_a) == (len(p), len(set(p) & a)) and r.extent_x == max(v[2] for v in p) - min(v[2] for v in p) + 1
        assert r.cx == pytest.approx(sum(v[2] for v in p) / len(p), abs=0.051)
    over = {c: len({v for v in p if (v[1], v[2]) in {(y, x) for z, y, x in b if z == 0}}) for c, p in parts.items()}
    best = min(parts, key=lambda c: (-over[c], -len(parts[c]), c))
    m = C.matched_component(lab, V.footprint(rb.where("z = 0"), []), ["scan_index"]).first()
    assert (m.component, m.n, m.over) == (best, len(parts[best]), over[best])


def test_no_voxels_are_made(spark, two):
    """But for those that a result lists."""
    runs = two[2].selectExpr("z % 2 AS scan_index", "*", "y AS label")
    lab = runs.selectExpr("*", "CAST(x0 AS BIGINT) AS component")
    for df in (V.projection(runs, "z"), V.projection(runs, "y"), V.footprint(runs, ["scan_index"]), V.surface(runs, ["scan_index"]), V.overlap(runs, runs, ["scan_index"]), C.matched_component(lab, V.footprint(runs, []), ["scan_index"]), C.disagreement_shapes(lab, runs, ["scan_index"])):
        p = plan(df)
        assert "sequence(" not in p and "InPandas" not in p and "Cartesian" not in p and "NestedLoop" not in p
    assert "sequence(x0" not in plan(V.stride_sample(runs, 3))


def test_local_roots_of_lines_far_apart():
    rows = [(10**6, 5, 3, 4), (0, 10**5, 0, 9), (10**6, 6, 5, 5), (0, 0, 0, 0)]
    assert C.local_roots(rows, 26).tolist() == [0, 1, 0, 3] and C.local_roots(rows, 6).tolist() == [0, 1, 2, 3]
    assert C.local_roots([], 6).tolist() == []


# -- percentiles


@pytest.mark.parametrize("few,bins", [(20_000, 4096), (3, 256)])
def test_percentiles(spark, monkeypatch, few, bins):
    """Ties, outliers over all magnitudes, infinities, one value, null keys, nulls and NaN; few rows and bins make many rounds."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=301), "b": np.exp(rng.normal(0, 40, 100)), "c": np.array([5.0]), "d": rng.integers(0, 3, 200).astype(float), None: np.array([-1e308, 1e308, 0.0, 1.0]), "i": np.array([-math.inf, 1.0, 2.0, 3.0, math.inf])}
    rows = [(k, float(x)) for k, g in groups.items() for x in g] + [("a", None), ("a", math.nan), ("e", None), ("e", math.nan)]
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q": 0.975, "high": 1.0}
    got = {r.k: r for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        g = np.clip(g, -1.7976931348623157e308, 1.7976931348623157e308)
        for name, p in shares.items():
            s = np.sort(g)
            at = p * (len(s) - 1)
            i, f = int(at), at - int(at)
            want = s[i] if f == 0 else s[i] * (1 - f) + s[i + 1] * f
            assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)


def test_percentiles_of_no_groups_and_one(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert quantiles.percentiles(df, [], "v", {"m": 0.5}).first().m == 1.5
    assert quantiles.percentiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).count() == 0
    assert "percentile" not in plan(quantiles.percentiles(df, [], "v", {"m": 0.5}))


# -- fits


@pytest.mark.parametrize("modified", [True, False])
def test_fits_equal_the_search_over_exponents(spark, modified):
    rng = np.random.default_rng(11)
    rows, groups = [], {}
    for name, phase, k0, n, c in (("s", "gas", 0.7, 3.1, 0.2), ("s", "brine", 0.4, 3.9, 0.0), ("railed", "gas", 0.05, 8.0, 0.0), ("t", "gas", 0.95, 2.2, 0.4)):
        b = rng.uniform(0, 1, 40)
        sigma = rng.uniform(0.01, 0.05, 40)
        v = k0 * b**n + c / (1 + c) * b + rng.normal(0, sigma)
        groups[name, phase] = (b, v, sigma)
        rows += [(name, phase, *map(float, x)) for x in zip(b, v, sigma, strict=True)]
    rows += [("s", "gas", 0.5, None, 0.1), ("s", "gas", 0.5, 0.1, 0.0), ("s", "gas", math.nan, 0.1, 1.0), ("two", "gas", 0.5, 0.1, 1.0), ("two", "gas", 0.6, 0.1, 1.0)]
    points = spark.createDataFrame(rows, "k string, phase string, base double, value double, sigma double")
    got = {(r.k, r.phase): r for r in fitting.fit_curves(points, ["k"], "h2", modified).collect()}
    assert got["two", "gas"].n is None and got["two", "gas"].at_bound == [] and got["s", "gas"].n_points == 43
    bands = {}
    for r in fitting.fit_bands(points, ["k"], "h2", modified).collect():
        bands.setdefault((r.k, r.phase), []).append(r)
    assert set(bands) == set(groups)
    for key, (b, v, s) in groups.items():
        f = fitting.fit_corey(b, v, s, fitting.BOUNDS["h2", key[1]], modified)
        r = got[key]
        assert (r.k0, r.n, r.c, r.rmse, r.chi2) == (pytest.approx(f.k0, abs=2e-5), pytest.approx(f.n, abs=2e-5), pytest.approx(f.c, abs=2e-5), pytest.approx(f.rmse, abs=1e-7), pytest.approx(f.chi2, rel=1e-6))
        assert r.at_bound == f.at_bound
        sd = np.sqrt(np.diag(f.cov))
        assert [x for x in (r.sd_k0, r.sd_n, r.sd_c) if x is not None] == pytest.approx(sd.tolist(), rel=1e-3)
        part = sorted(bands[key], key=lambda x: x.base)
        limits = fitting.band(f, np.array([x.base for x in part]), fitting.BOUNDS["h2", key[1]], draws=20_000)
        if limits is None:
            assert all(x.low is None for x in part)
        else:
            assert [x.low for x in part] == pytest.approx(limits[0].tolist(), abs=0.015) and [x.high for x in part] == pytest.approx(limits[1].tolist(), abs=0.015)


def test_draws_are_normal(spark):
    z = np.array([list(r) for r in spark.range(4000).select(*[fitting.normal(F.col("id"), i, 0) for i in range(3)]).collect()])
    assert abs(z.mean(0)).max() < 0.06 and abs(np.cov(z.T) - np.eye(3)).max() < 0.08
