import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from porespan.operators import components as C
from porespan.operators import runs as RL
from porespan.operators.graph import connected_components


def flood(gas: set, level: int) -> dict:
    """Least voxel of each voxel's component by flood fill."""
    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if 1 <= sum(map(abs, d)) <= level]
    seen, out = set(), {}
    for v in sorted(gas):
        if v in seen:
            continue
        stack, part = [v], []
        seen.add(v)
        while stack:
            p = stack.pop()
            part.append(p)
            for d in steps:
                q = tuple(a + b for a, b in zip(p, d, strict=True))
                if q in gas and q not in seen:
                    seen.add(q)
                    stack.append(q)
        for p in part:
            out[p] = v
    return out


def as_runs(gas: set) -> list:
    rows = []
    for (z, y), part in itertools.groupby(sorted(gas), key=lambda v: v[:2]):
        xs = [v[2] for v in part]
        start = last = xs[0]
        for x in [*xs[1:], None]:
            if x is None or x != last + 1:
                rows.append((z, y, start, last))
                start = x
            last = x
    return rows


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(0, 4)), max_size=70), st.sampled_from([(6, 1), (18, 2), (26, 3)]))
def test_local_roots_equal_flood_fill(gas, kind):
    connectivity, level = kind
    rows = as_runs(gas)
    roots = C.local_roots(rows, connectivity)
    want = flood(gas, level)
    got = {}
    for (z, y, x0, x1), r in zip(rows, roots, strict=True):
        for x in range(x0, x1 + 1):
            got[z, y, x] = (rows[r][0], rows[r][1], rows[r][2])
    assert got == want


@pytest.mark.parametrize("connectivity,level", [(6, 1), (18, 2), (26, 3)])
@pytest.mark.parametrize("depth", [1, 3, 50])
def test_result_does_not_depend_on_slab_depth(spark, connectivity, level, depth):
    rng = random.Random(connectivity)
    gas = {v for v in itertools.product(range(9), range(6), range(6)) if rng.random() < 0.3}
    runs = spark.createDataFrame([(0, *r, 2) for r in as_runs(gas)], RL.RUNS)
    lab = C.label_components(runs, connectivity, slab_depth=depth)
    ny, nx = max(v[1] for v in gas) + 1, max(v[2] for v in gas) + 1
    got = {(r.z, r.y, x): r.component for r in lab.collect() for x in range(r.x0, r.x1 + 1)}
    want = {v: (w[0] * ny + w[1]) * nx + w[2] for v, w in flood(gas, level).items()}
    assert got == want


def test_compat_seams_join_diagonals(spark):
    rows = [(0, 0, 0, 0, 0, 2), (0, 1, 1, 1, 1, 2)]
    runs = spark.createDataFrame(rows, RL.RUNS)
    count = lambda mode: C.component_sizes(C.label_components(runs, 6, slab_depth=1, seam_mode=mode)).count()
    assert (count("true"), count("compat26")) == (2, 1)


def test_empty_volume(spark):
    runs = spark.createDataFrame([], RL.RUNS)
    lab = C.label_components(runs, 18)
    assert lab.count() == 0
    assert C.percolation(lab, ["scan_index"], 0, 4).count() == 0


def test_top_clusters_break_ties_by_first_voxel(spark):
    runs = spark.createDataFrame([(0, 0, 0, 5, 6, 2), (0, 0, 0, 0, 1, 2), (0, 3, 3, 0, 0, 2)], RL.RUNS)
    top = C.top_clusters(C.component_sizes(C.label_components(runs, 26)), 2).orderBy("label_id").collect()
    assert [r.component for r in top] == [0, 5]
    with pytest.raises(ValueError):
        C.top_clusters(runs, 300)


def test_graph_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)] + [(1, 1), (2, 1)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(path + star, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
