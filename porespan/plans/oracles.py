"""SQL forms of the registered queries, for DuckDB over the same tables: common table expressions and one SELECT each."""

from __future__ import annotations

from ..fixtures import BRINE_CURVE, GAS_CURVE, MINUTES, SHAPE

NS, NZ, NY, NX = SHAPE
_minutes = ", ".join(f"({i}, {m})" for i, m in enumerate(MINUTES))
_pairs = "a.scan_index = b.scan_index AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1"
_gas_base = "least(greatest((1 - {0} - 0.39) / (1 - 0.0 - 0.39), 0.0), 1.0)"
_brine_base = "least(greatest(({0} - 0.0) / (1 - 0.0 - 0.39), 0.0), 1.0)"


def _components(level: int, where: str = "TRUE") -> str:
    return f"""gas AS (SELECT scan_index, z, y, x, (z * {NY} + y) * {NX} + x AS id FROM vox WHERE label = 2 AND {where}),
    edge AS (SELECT a.scan_index, a.id AS s, b.id AS d FROM gas a JOIN gas b ON {_pairs} AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) BETWEEN 1 AND {level}),
    reach AS (SELECT scan_index, id, id AS root FROM gas UNION SELECT r.scan_index, e.d, r.root FROM reach r JOIN edge e ON r.scan_index = e.scan_index AND r.id = e.s AND r.root < e.d),
    rooted AS (SELECT scan_index, id, min(root) AS component FROM reach GROUP BY ALL),
    lab AS (SELECT g.scan_index, g.z, g.y, g.x, r.component FROM gas g JOIN rooted r USING (scan_index, id))"""


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "vox": ((), f"""h AS (SELECT l_linenumber - 1 AS scan_index, l_orderkey % {NZ} AS z, l_partkey % {NY} AS y, l_suppkey % {NX} AS x, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) % 100 AS INT) AS m FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL),
    grid AS (SELECT s.range AS scan_index, z.range AS z, y.range AS y, x.range AS x FROM range({NS}) s, range({NZ}) z, range({NY}) y, range({NX}) x),
    vox AS (SELECT CAST(g.scan_index AS INT) AS scan_index, CAST(g.z AS INT) AS z, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, CASE WHEN m IS NULL THEN 0 WHEN m < 46 - 5 * g.scan_index THEN 2 WHEN m < 70 THEN 1 ELSE 0 END AS label FROM grid g LEFT JOIN h USING (scan_index, z, y, x))"""),
    "runs_x": (("vox",), """isl AS (SELECT *, x - row_number() OVER (PARTITION BY scan_index, z, y, label ORDER BY x) AS g FROM vox WHERE label <> 0),
    runs_x AS (SELECT scan_index, z, y, min(x) AS x0, max(x) AS x1, label FROM isl GROUP BY scan_index, z, y, label, g)"""),
    "sw": (("vox",), "sw AS (SELECT scan_index, count(*) FILTER (label = 2) AS gas, count(*) FILTER (label = 1) AS brine, count(*) FILTER (label = 1) / nullif(count(*) FILTER (label IN (1, 2)), 0)::DOUBLE AS sw FROM vox GROUP BY 1)"),
    "pts": (("sw",), f"""times AS (SELECT * FROM (VALUES {_minutes}) t(scan_index, x)),
    pts AS (SELECT scan_index, CAST(x AS DOUBLE) AS x, sw AS y FROM sw JOIN times USING (scan_index) WHERE sw IS NOT NULL)"""),
    "seg": (("pts",), """ip AS (SELECT 0 AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT row_number() OVER (ORDER BY scan_index), x, y FROM pts),
    seg AS (SELECT a, b, greatest(0.0, syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END) AS sse, CASE WHEN sxx > 0 THEN sxy / sxx END AS slope FROM (SELECT p.i AS a, q.i AS b, regr_sxx(r.y, r.x) AS sxx, regr_syy(r.y, r.x) AS syy, regr_sxy(r.y, r.x) AS sxy FROM ip p JOIN ip q ON q.i >= p.i JOIN ip r ON r.i BETWEEN p.i AND q.i GROUP BY ALL))"""),
    "fit": (("seg",), """fit AS (SELECT s1.b AS i, s2.b AS j, s1.sse + s2.sse + s3.sse AS sse, (SELECT x FROM ip WHERE ip.i = s1.b) AS bp1, (SELECT x FROM ip WHERE ip.i = s2.b) AS bp2, s1.slope AS slope1, s2.slope AS slope2, s3.slope AS slope3
      FROM seg s1 JOIN seg s2 ON s2.a = s1.b JOIN seg s3 ON s3.a = s2.b WHERE s1.a = 0 AND s3.b = (SELECT max(i) FROM ip) AND s1.b BETWEEN 1 AND s3.b - 2 AND s2.b BETWEEN s1.b + 1 AND s3.b - 1
      ORDER BY round(s1.sse + s2.sse + s3.sse, 12), i, j LIMIT 1)"""),
    "step": (("fit",), "step AS (SELECT coalesce((SELECT max(scan_index) FROM pts WHERE x <= (SELECT bp1 FROM fit)), (SELECT max(scan_index) FROM pts)) AS x_scan)"),
    "lab6": (("vox",), _components(1)),
    "lab18": (("vox",), _components(2)),
    "lab26": (("vox",), _components(3)),
    "clusters": (("step",), _components(1, "scan_index = (SELECT x_scan FROM step)") + """,
    sized AS (SELECT component, count(*) AS n FROM lab GROUP BY 1),
    ranked AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS track_id FROM sized QUALIFY track_id <= 8),
    clusters AS (SELECT l.*, r.track_id, r.n FROM lab l JOIN ranked r USING (component))"""),
    "boxes": (("clusters",), """prof AS (SELECT track_id, z, count(*) AS area FROM clusters GROUP BY ALL),
    boxes AS (SELECT track_id, min(z) AS z0, max(z) + 1 AS z1 FROM (SELECT *, max(area) OVER (PARTITION BY track_id) AS p FROM prof) WHERE area >= p * 0.2 GROUP BY 1)"""),
    "counts": (("boxes",), f"""counts AS (SELECT b.track_id, v.scan_index, b.z0, b.z1, b.z1 - b.z0 AS extent_z, count(*) FILTER (label = 2) AS gas_voxels, count(*) FILTER (label = 1) AS brine_voxels,
      count(*) FILTER (label = 1) / nullif(count(*) FILTER (label IN (1, 2)), 0)::DOUBLE AS sw_local, coalesce(max(z) FILTER (label = 2) - min(z) FILTER (label = 2) + 1, 0) AS extent_gas,
      coalesce(avg(z) FILTER (label = 2), any_value(b.z0 + b.z1 - 1) / 2.0) AS cog_z, coalesce(avg(y) FILTER (label = 2), {(NY - 1) / 2}) AS cog_y, coalesce(avg(x) FILTER (label = 2), {(NX - 1) / 2}) AS cog_x
      FROM boxes b JOIN vox v ON v.z >= b.z0 AND v.z < b.z1 GROUP BY b.track_id, v.scan_index, b.z0, b.z1)"""),
    "runs": ((), "runs AS (SELECT * FROM (VALUES ('r1', TIMESTAMP '2026-01-01'), ('r2', TIMESTAMP '2026-01-02'), ('r3', TIMESTAMP '2026-01-03')) t(run_id, started_at))"),
    "scans": (("step", "runs"), "scans AS (SELECT run_id, scan_index, '8_' || scan_index || '_sub.am' AS file_name, y AS sw, scan_index <= x_scan AS qualifying, scan_index = x_scan AS is_x, x AS elapsed_minutes FROM pts, step, runs)"),
    "fixed_boxes": (("counts", "runs"), """at_x AS (SELECT track_id, n AS gas_voxels_at_x FROM ranked),
    fixed_boxes AS (SELECT run_id, c.track_id, c.scan_index, '1' AS connectivity, z0, z1, extent_z, c.scan_index = x_scan AS is_x, CASE WHEN c.scan_index = x_scan THEN gas_voxels_at_x ELSE gas_voxels END AS gas_voxels, gas_voxels_at_x, brine_voxels,
      brine_voxels / nullif(brine_voxels + CASE WHEN c.scan_index = x_scan THEN gas_voxels_at_x ELSE gas_voxels END, 0)::DOUBLE AS sw_local, CASE WHEN c.scan_index = x_scan THEN TRUE END AS percolates
      FROM counts c JOIN at_x USING (track_id), step, runs WHERE c.scan_index <= x_scan)"""),
    "sim": (("fixed_boxes",), f"""fixed AS (SELECT *, max(gas_voxels + brine_voxels) OVER (PARTITION BY run_id, track_id, connectivity) AS total FROM fixed_boxes),
    corrected AS (SELECT *, brine_voxels / nullif(brine_voxels + CASE WHEN is_x THEN total - brine_voxels ELSE gas_voxels END, 0)::DOUBLE AS sw_corrected, 3.703e-13 * (1 + 0.1 * track_id::DOUBLE) AS kabs FROM fixed),
    phases AS (SELECT *, 'absolute' AS sim_type, kabs AS k FROM corrected WHERE is_x UNION ALL SELECT *, 'gas', kabs * 0.9 * pow({_gas_base.format('sw_corrected')}, 2.5) FROM corrected WHERE NOT is_x
      UNION ALL SELECT *, 'water', kabs * 0.14 * pow({_brine_base.format('sw_corrected')}, 3.9) FROM corrected WHERE NOT is_x),
    sim AS (SELECT run_id, scan_index, track_id, connectivity, sim_type, simulator, k * f AS k_z, sw_corrected AS sw, CASE WHEN track_id % 3 = 0 THEN 'time' ELSE 'converged' END AS flag, (0.004 * track_id)::DECIMAL(6, 3)::DOUBLE AS bound
      FROM phases, (VALUES ('LIR', 1.0::DOUBLE), ('lbm_MRT', 1.08::DOUBLE)) s(simulator, f) WHERE run_id <> 'r3')"""),
    "kr": (("sim",), """kr AS (SELECT s.*, a.k_abs, s.k_z / nullif(a.k_abs, 0) AS kr FROM sim s LEFT JOIN (SELECT run_id, track_id, connectivity, simulator, max(k_z) AS k_abs FROM sim WHERE sim_type = 'absolute' GROUP BY ALL) a USING (run_id, track_id, connectivity, simulator) WHERE sim_type <> 'absolute'),
    wide AS (SELECT run_id, track_id, connectivity, simulator, scan_index, max(sw) AS sw, max(kr) FILTER (sim_type = 'gas') AS kr_gas, max(kr) FILTER (sim_type = 'water') AS kr_brine FROM kr GROUP BY ALL)"""),
    "baseline": ((), f"""baseline AS (SELECT i AS ordinal, i * 0.05::DOUBLE AS sw, {GAS_CURVE[0]} * pow({_gas_base.format('(i * 0.05::DOUBLE)')}, {GAS_CURVE[1]}) + {GAS_CURVE[2]}::DOUBLE / (1 + {GAS_CURVE[2]}::DOUBLE) * {_gas_base.format('(i * 0.05::DOUBLE)')} AS kr_gas,
      {BRINE_CURVE[0]} * pow({_brine_base.format('(i * 0.05::DOUBLE)')}, {BRINE_CURVE[1]}) AS kr_brine FROM (SELECT CAST(range AS INT) AS i FROM range(21)))"""),
    "names": (("fixed_boxes",), f"""names AS (SELECT 'domain_' || k || '_' || lpad(track_id::VARCHAR, 2, '0') || '-' || scan_index || '_4.99684um_8bu_{NX}x{NY}x' || extent_z || '.raw' AS name FROM fixed_boxes, (VALUES ('absolute'), ('gas'), ('water')) k(k) WHERE run_id = 'r1'
      UNION ALL SELECT * FROM (VALUES ('domain_gas_03-7_5um_8bu_12x12.raw'), ('DOMAIN_GAS_03-2_5um_8bu_12x12x9.RAW'), ('domain_gas_03-8_2_5um_8bu_12x12x9.raw'), ('domain_gas_03-7_5_8bu_12x12x9.raw'), ('notes.txt')) t(name))"""),
}
DOMAIN = r"^domain_(absolute|gas|water)_(\d+)-(.+?)_([0-9.]+)um_(\d+b[us])_(\d+)x(\d+)x(\d+)\.raw$"


def sql(select: str, *needs: str) -> str:
    """The statement ``select`` with the expressions that it needs, in the order of their dependencies."""
    order: list[str] = []

    def add(name: str) -> None:
        for d in CTE[name][0]:
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("WITH RECURSIVE " + ",\n    ".join(CTE[n][1] for n in order) + "\n" if order else "") + select


def fitted(points: str, n: tuple[float, float], k: tuple[float, float], g: tuple[float, float], side: int = 20, rounds: int = 4) -> str:
    """Expressions that fit ``points(run_id, simulator, b, v, sigma)``: sums for a grid of exponents, the best, a finer grid around
    it and so on; then residuals, normal matrix and covariance in ``curves``. With equal bounds of g it is no parameter."""
    two = g[1] > g[0]
    key = "run_id, simulator"
    steps = [f"pt AS (SELECT {key}, b, v, 1 / (sigma * sigma) AS w FROM ({points}))", f"o0 AS (SELECT {key}, {(n[0] + n[1]) / 2}::DOUBLE AS n, {(n[1] - n[0]) / 80}::DOUBLE AS step FROM pt GROUP BY ALL)"]
    edge = "list_min([{0}])"
    sse = lambda kk, gg: f"vv - 2 * ({kk} * fv + {gg} * bv) + {kk} * {kk} * ff + 2 * {kk} * {gg} * fb + {gg} * {gg} * bb"
    of_k = lambda kk: f"least(greatest((bv - {kk} * fb) / bb, {g[0]}), {g[1]})"
    of_g = lambda gg: f"least(greatest((fv - {gg} * fb) / ff, {k[0]}), {k[1]})"
    one = lambda kk, gg: f"{{'sse': {sse(kk, gg)}, 'k0': {kk}, 'g': {gg}}}"
    edges = ", ".join([one(f"{x}::DOUBLE", of_k(f"{x}::DOUBLE")) for x in k] + [one(of_g(f"{x}::DOUBLE"), f"{x}::DOUBLE") for x in g])
    inside = f"det > 1e-13 * ff * bb AND kf BETWEEN {k[0]} AND {k[1]} AND gf BETWEEN {g[0]} AND {g[1]}"
    for r in range(rounds + 1):
        half = 40 if r == 0 else side
        steps.append(f"""t{r} AS (SELECT {key}, n, step, sum(w * f * f) AS ff, sum(w * f * b) AS fb, sum(w * b * b) AS bb, sum(w * f * v) AS fv, sum(w * b * v) AS bv, sum(w * v * v) AS vv
          FROM (SELECT pt.*, step, least(greatest(o.n + i * step, {n[0]}), {n[1]}) AS n, pow(b, least(greatest(o.n + i * step, {n[0]}), {n[1]})) AS f FROM pt JOIN o{r} o USING ({key}), range({-half}, {half + 1}) t(i)) GROUP BY ALL)""")
        steps.append(f"""o{r + 1} AS (SELECT {key}, n, step / {side} AS step, best.k0 AS k0, best.g AS g FROM (SELECT *, CASE WHEN {inside} THEN {one('kf', 'gf')} ELSE {edge.format(edges)} END AS best
          FROM (SELECT *, ff * bb - fb * fb AS det, (fv * bb - bv * fb) / (ff * bb - fb * fb) AS kf, (bv * ff - fv * fb) / (ff * bb - fb * fb) AS gf FROM t{r})) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY best.sse, n) = 1)""")
    d, e, c22 = ("m11", "m12", "m22") if two else ("m11", "0.0", "1.0")
    m02 = "m02" if two else "0.0"
    steps.append(f"""mat AS (SELECT {key}, any_value(n) AS n, any_value(k0) AS k0, any_value(g) AS g, count(*) AS m, sum(w * r * r) AS wrr, sum(r * r) AS rr, sum(w * j0 * j0) AS m00, sum(w * j0 * j1) AS m01, sum(w * j0 * j2) AS m02, sum(w * j1 * j1) AS m11, sum(w * j1 * j2) AS m12, sum(w * j2 * j2) AS m22
      FROM (SELECT *, v - k0 * pow(b, n) - g * b AS r, pow(b, n) AS j0, CASE WHEN b > 0 THEN k0 * pow(b, n) * ln(CASE WHEN b > 0 THEN b END) ELSE 0.0 END AS j1, b * pow(1 - g, 2) AS j2 FROM pt JOIN o{rounds + 1} USING ({key})) GROUP BY ALL)""")
    steps.append(f"dets AS (SELECT *, m00 * ({d} * {c22} - {e} * {e}) + m01 * ({m02} * {e} - m01 * {c22}) + {m02} * (m01 * {e} - {m02} * {d}) AS det FROM mat)")
    near = lambda x, b: f"least(abs({x} - {b[0]}), abs({x} - {b[1]})) <= 1e-6 * greatest(1.0, {b[1] - b[0]})"
    c = tuple(x / (1 - x) for x in g)
    steps.append(f"""curves AS (SELECT *, g / (1 - g) AS c, ({d} * {c22} - {e} * {e}) / det AS v00, ({m02} * {e} - m01 * {c22}) / det AS v01, (m01 * {e} - {m02} * {d}) / det AS v02, (m00 * {c22} - {m02} * {m02}) / det AS v11, (m01 * {m02} - m00 * {e}) / det AS v12, (m00 * {d} - m01 * m01) / det AS v22,
      list_filter([CASE WHEN {near("k0", k)} THEN 'k0' END, CASE WHEN {near("n", n)} THEN 'n' END, {f"CASE WHEN {near('g / (1 - g)', c)} THEN 'c' END" if two else "NULL"}], lambda x: x IS NOT NULL) AS at_bound FROM dets)""")
    return ", ".join(steps)


def oracle_sql() -> dict[str, str]:
    gas, brine = _gas_base.format("sw"), _brine_base.format("sw")
    comp = "SELECT scan_index, component, count(*) AS n FROM lab GROUP BY ALL"
    perc = f"SELECT scan_index, count(*) AS n_components, count(*) FILTER (lo AND hi) AS spanning_count, max(n) AS largest FROM (SELECT scan_index, component, count(*) AS n, bool_or(z = 0) AS lo, bool_or(z = {NZ - 1}) AS hi FROM lab GROUP BY ALL) GROUP BY 1"
    bars = """rng AS (SELECT *, max(kr_gas) OVER (PARTITION BY run_id, simulator, scan_index) - min(kr_gas) OVER (PARTITION BY run_id, simulator, scan_index) AS r FROM wide WHERE sw IS NOT NULL AND kr_gas IS NOT NULL AND kr_brine IS NOT NULL),
      fall AS (SELECT run_id, simulator, median(r) FILTER (r > 0) AS m FROM (SELECT DISTINCT run_id, simulator, scan_index, r FROM rng) GROUP BY ALL),
      bars AS (SELECT rng.*, CASE WHEN r > 0 THEN r ELSE coalesce(m, 1e-6) END * CASE WHEN sw > 1 - 0.39 THEN 50.0 ELSE 1.0 END AS sigma FROM rng JOIN fall USING (run_id, simulator))"""
    with_bars = sql("SELECT 1", "kr").rsplit("\n", 1)[0] + ",\n    " + bars + "\n"
    point = f"SELECT run_id, simulator, {gas} AS b, kr_gas AS v, sigma FROM bars"
    u = lambda place, start: f"((('0x' || substr(md5('0:' || draw || ':{place}'), {start}, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"
    z = lambda place: f"sqrt(-2 * ln({u(place, 1)})) * cos(2 * pi() * ({u(place, 9)}))"
    fits = {
        "corey_fit": with_bars + ", " + fitted(f"{point} UNION ALL SELECT run_id, simulator, 0.0, 0.0, min(sigma) FROM bars GROUP BY ALL", (2.0, 6.0), (0.2, 1.0), (0.0, 0.5 / 1.5)) + """SELECT run_id, simulator, 'gas' AS phase, m::INT AS n_points, round(k0, 4) AS k0, round(n, 4) AS n, round(c, 4) AS c, round(sqrt(rr / m), 4) AS rmse, round(wrr / greatest(m - 3, 1), 4) AS chi2,
          array_to_string(at_bound, ',') AS at_bound, round(sqrt(v00), 4) AS sd_k0, round(sqrt(v11), 4) AS sd_n, round(sqrt(v22), 4) AS sd_c FROM curves""",
        "corey_band": with_bars + ", " + fitted(point, (2.0, 6.0), (0.2, 1.0), (0.0, 0.0)) + f""", bases AS (SELECT i / 20.0::DOUBLE AS base FROM range(21) t(i)),
          drawn AS (SELECT run_id, simulator, least(greatest(k0 + sqrt(v00) * z0, 0.2), 1.0) AS pk, least(greatest(n + v01 / sqrt(v00) * z0 + sqrt(v11 - v01 / sqrt(v00) * (v01 / sqrt(v00))) * z1, 2.0), 6.0) AS pn FROM curves, (SELECT {z(0)} AS z0, {z(1)} AS z1 FROM range(2000) t(draw)) WHERE NOT list_contains(at_bound, 'n')),
          spread AS (SELECT run_id, simulator, base, quantile_cont(pk * pow(base, pn), 0.025) AS low, quantile_cont(pk * pow(base, pn), 0.975) AS high FROM drawn, bases GROUP BY ALL)
          SELECT run_id, simulator, 'gas' AS phase, round(base, 4) AS base, round(k0 * pow(base, n), 4) AS curve, round(low, 4) AS low, round(high, 4) AS high FROM curves CROSS JOIN bases LEFT JOIN spread USING (run_id, simulator, base)""",
    }
    q = fits | {
        "label_histogram": sql("SELECT scan_index, label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY ALL", "vox"),
        "sw_series": sql("SELECT scan_index, gas, brine, round(sw, 9) AS sw FROM sw", "sw"),
        "x_density": sql("SELECT scan_index, x, count(*) AS n FROM vox WHERE label > 0 GROUP BY ALL", "vox"),
        "z_profile": sql("SELECT scan_index, z, count(*) AS area FROM vox WHERE label = 2 GROUP BY ALL", "vox"),
        "flow_crop": sql("SELECT scan_index, min(z) AS z0, max(z) + 1 AS z1 FROM (SELECT *, max(area) OVER (PARTITION BY scan_index) AS p FROM (SELECT scan_index, z, count(*) AS area FROM vox WHERE label = 2 GROUP BY ALL)) WHERE area >= p * 0.1 GROUP BY 1", "vox"),
        "runs_encode": sql("SELECT * FROM runs_x", "runs_x"),
        "runs_roundtrip": sql("SELECT scan_index, z, y, x, label FROM vox WHERE label <> 0", "vox"),
        "slices_roundtrip": sql("SELECT scan_index, label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY ALL", "vox"),
        "tiff_slices": sql("SELECT scan_index, label, count(*) AS n FROM vox WHERE label <> 0 GROUP BY ALL", "vox"),
        "tiff_info": f"SELECT scan_index::VARCHAR AS name, {NZ} AS n_frames, {NY} AS ny, {NX} AS nx FROM range({NS}) t(scan_index)",
        "x_shift": sql("SELECT DISTINCT scan_index, 13 AS shift FROM vox WHERE label > 0 AND x >= 4", "vox"),
        "unwrap_x": sql("SELECT scan_index, label, count(*) AS n, min(x - 4) AS x_min, max(x - 4) AS x_max FROM vox WHERE label > 0 AND x >= 4 GROUP BY ALL", "vox"),
        "mip_z": sql("SELECT scan_index, y, x, max(label) AS label FROM vox WHERE label > 0 GROUP BY ALL", "vox"),
        "mip_y": sql("SELECT scan_index, z, x, max(label) AS label FROM vox WHERE label > 0 GROUP BY ALL", "vox"),
        "mip_x": sql("SELECT scan_index, z, y, max(label) AS label FROM vox WHERE label > 0 GROUP BY ALL", "vox"),
        "stride_sample": sql("SELECT scan_index, z, y, x, label FROM vox WHERE label > 0 AND z % 3 = 0 AND y % 3 = 0 AND x % 3 = 0", "vox"),
        "or_downsample": sql("SELECT DISTINCT scan_index, z // 4 AS bz, y // 4 AS by, x // 4 AS bx FROM vox WHERE label = 2", "vox"),
        "domain_counts": sql("SELECT scan_index, count(*) FILTER (label IN (1, 2)) AS absolute_open, count(*) FILTER (label = 2) AS gas_open, count(*) FILTER (label = 1) AS water_open FROM vox WHERE label > 0 GROUP BY 1", "vox"),
        "box_crop": sql("SELECT b.track_id, v.scan_index, v.label, count(*) AS n FROM boxes b JOIN vox v ON v.z >= b.z0 AND v.z < b.z1 WHERE v.label > 0 GROUP BY ALL", "boxes"),
        "overlap_agreement": sql("SELECT a.scan_index, count(*) FILTER (a.label = 2 AND b.label = 2) AS n_both, count(*) FILTER (a.label = 2 AND b.label <> 2) AS only_a, count(*) FILTER (a.label <> 2 AND b.label = 2) AS only_b, round(100 * count(*) FILTER (a.label = 2 AND b.label = 2) / count(*) FILTER (a.label = 2 OR b.label = 2)::DOUBLE, 6) AS agreement, round(100 * least(count(*) FILTER (a.label = 2), count(*) FILTER (b.label = 2)) / greatest(count(*) FILTER (a.label = 2), count(*) FILTER (b.label = 2))::DOUBLE, 6) AS count_agreement FROM vox a JOIN vox b ON b.scan_index = a.scan_index + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY 1", "vox"),
        "registration": sql("SELECT a.scan_index, a.z + m.z AS z, a.y + m.y AS y, a.x0 + m.x AS x0, a.x1 + m.x AS x1 FROM runs_x a JOIN (SELECT p.scan_index, q.z - p.z AS z, q.y - p.y AS y, q.x - p.x AS x FROM (SELECT scan_index, min(z) AS z, min(y) AS y, min(x0) AS x FROM runs_x WHERE label = 2 GROUP BY 1) p JOIN (SELECT scan_index - 1 AS scan_index, min(z) AS z, min(y) AS y, min(x0) AS x FROM runs_x WHERE label = 2 AND z >= 5 AND y >= 2 GROUP BY 1) q USING (scan_index)) m USING (scan_index) WHERE label = 2", "runs_x"),
        "surface_voxels": sql("SELECT scan_index, z, y, x FROM vox v WHERE label = 2 AND (SELECT count(*) FROM vox n WHERE n.scan_index = v.scan_index AND n.label = 2 AND abs(n.z - v.z) + abs(n.y - v.y) + abs(n.x - v.x) = 1) < 6", "vox"),
        "footprint": sql("SELECT DISTINCT track_id, y, x FROM clusters", "clusters"),
        "regime_fit_shared": sql("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, bp1, bp2, round(sse, 9) AS sse, round(slope1, 9) AS slope1, round(slope2, 9) AS slope2, round(slope3, 9) AS slope3 FROM fit", "fit"),
        "regime_fit_disjoint": sql("""SELECT CAST(s1.b AS INT) + 1 AS i, CAST(s2.b AS INT) + 1 AS j, round(s1.sse + s2.sse + s3.sse, 9) AS sse FROM dseg s1 JOIN dseg s2 ON s2.a = s1.b + 1 JOIN dseg s3 ON s3.a = s2.b + 1
          WHERE s1.a = 0 AND s3.b = (SELECT max(i) FROM dp) AND s1.b >= 1 AND s2.b > s2.a AND s3.b > s3.a ORDER BY round(s1.sse + s2.sse + s3.sse, 12), 1, 2 LIMIT 1""", "pts").replace("\nSELECT CAST(s1.b", """,
    dp AS (SELECT row_number() OVER (ORDER BY scan_index) - 1 AS i, x, y FROM pts),
    dseg AS (SELECT a, b, greatest(0.0, syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END) AS sse FROM (SELECT p.i AS a, q.i AS b, regr_sxx(r.y, r.x) AS sxx, regr_syy(r.y, r.x) AS syy, regr_sxy(r.y, r.x) AS sxy FROM dp p JOIN dp q ON q.i >= p.i JOIN dp r ON r.i BETWEEN p.i AND q.i GROUP BY ALL))
SELECT CAST(s1.b""", 1),
        "timestep_x": sql("SELECT bp1 AS cutoff, x_scan FROM step, fit", "step"),
        "timestep_x_transition": sql("SELECT bp2 AS cutoff, (SELECT max(scan_index) FROM pts WHERE x <= bp2) AS x_scan FROM fit", "fit"),
        "timestep_x_override": sql("SELECT 55.0::DOUBLE AS cutoff, max(scan_index) AS x_scan FROM pts WHERE x <= 55", "pts"),
        "qualifying_scans": sql("SELECT scan_index, scan_index <= x_scan AS qualifying, scan_index = x_scan AS is_x FROM pts, step", "step"),
        "regime_tags": sql("SELECT scan_index, CASE WHEN x <= bp1 THEN 'D' WHEN x <= bp2 THEN 'T' ELSE 'X' END AS regime FROM pts, fit", "fit"),
        "cca_6n": sql(comp, "lab6"), "cca_18n": sql(comp, "lab18"), "cca_26n": sql(comp, "lab26"),
        "topn_clusters": sql("SELECT scan_index, label_id, component, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_index ORDER BY n DESC, component) AS label_id FROM (" + comp + ")) WHERE label_id <= 8", "lab6"),
        "cluster_cog": sql("SELECT track_id, count(*) AS n, round(avg(z), 6) AS cog_z, round(avg(y), 6) AS cog_y, round(avg(x), 6) AS cog_x FROM clusters GROUP BY 1", "clusters"),
        "cluster_bbox": sql("SELECT track_id, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM clusters GROUP BY 1", "clusters"),
        "largest_component": sql("SELECT scan_index, component, n FROM (" + comp + ") QUALIFY row_number() OVER (PARTITION BY scan_index ORDER BY n DESC, component) = 1", "lab18"),
        "percolation_6n": sql(perc, "lab6"), "percolation_26n": sql(perc, "lab26"),
        "split_check": sql("""SELECT pad, CAST(count(*) AS BIGINT) AS n_components, count(*) FILTER (lo AND hi) AS spanning_count FROM (SELECT pad, component, bool_or(z = lo_z) AS lo, bool_or(z = hi_z) AS hi FROM crops GROUP BY ALL) GROUP BY 1""", "vox").replace("\nSELECT pad, CAST", f""",
    pads AS (SELECT * FROM (VALUES (0, 5, 11), (2, 3, 13)) t(pad, a, b)),
    gas AS (SELECT pad, a AS lo_z, b - 1 AS hi_z, z, y, x, (z * {NY} + y) * {NX} + x AS id FROM vox, pads WHERE label = 2 AND scan_index = 3 AND z >= a AND z < b),
    edge AS (SELECT a.pad, a.id AS s, b.id AS d FROM gas a JOIN gas b ON a.pad = b.pad AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id),
    reach AS (SELECT pad, id, id AS root FROM gas UNION SELECT r.pad, e.d, r.root FROM reach r JOIN edge e ON r.pad = e.pad AND r.id = e.s AND r.root < e.d),
    crops AS (SELECT g.*, m.component FROM gas g JOIN (SELECT pad, id, min(root) AS component FROM reach GROUP BY ALL) m USING (pad, id))
SELECT pad, CAST""", 1),
        "matched_component": sql("SELECT scan_index, component, n, CAST(over AS BIGINT) AS over FROM (SELECT l.scan_index, l.component, count(*) AS n, count(f.y) AS over FROM lab l LEFT JOIN (SELECT DISTINCT y, x FROM vox WHERE scan_index = 6 AND label = 2 AND z < 3) f ON l.y = f.y AND l.x = f.x GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scan_index ORDER BY over DESC, n DESC, component) = 1", "lab6"),
        "x_route_overlap": sql(f"""SELECT scan_index, component, n, round(j_inlet + j_outlet, 6) AS score, row_number() OVER (PARTITION BY scan_index ORDER BY j_inlet + j_outlet DESC, n DESC, component) AS place FROM (
          SELECT c.scan_index, c.component, c.n, (SELECT count(*) FROM f WHERE f.scan_index = c.scan_index AND f.component = c.component AND face = 0 AND EXISTS (SELECT 1 FROM route r WHERE r.face = 0 AND r.y = f.y AND r.x = f.x)) / (c.a0 + (SELECT count(*) FROM route WHERE face = 0) - (SELECT count(*) FROM f WHERE f.scan_index = c.scan_index AND f.component = c.component AND face = 0 AND EXISTS (SELECT 1 FROM route r WHERE r.face = 0 AND r.y = f.y AND r.x = f.x)))::DOUBLE AS j_inlet,
          (SELECT count(*) FROM f WHERE f.scan_index = c.scan_index AND f.component = c.component AND face = 1 AND EXISTS (SELECT 1 FROM route r WHERE r.face = 1 AND r.y = f.y AND r.x = f.x)) / (c.a1 + (SELECT count(*) FROM route WHERE face = 1) - (SELECT count(*) FROM f WHERE f.scan_index = c.scan_index AND f.component = c.component AND face = 1 AND EXISTS (SELECT 1 FROM route r WHERE r.face = 1 AND r.y = f.y AND r.x = f.x)))::DOUBLE AS j_outlet
          FROM (SELECT scan_index, component, count(*) AS n, count(*) FILTER (z = 0) AS a0, count(*) FILTER (z = {NZ - 1}) AS a1 FROM lab GROUP BY ALL HAVING a0 > 0 AND a1 > 0) c)""", "lab26").replace("\nSELECT scan_index, component, n, round(j_inlet", f""",
    f AS (SELECT scan_index, component, CASE WHEN z = 0 THEN 0 ELSE 1 END AS face, y, x FROM lab WHERE z IN (0, {NZ - 1})),
    route AS (SELECT face, y, x FROM f WHERE scan_index = 3 AND component = (SELECT component FROM lab WHERE scan_index = 3 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
SELECT scan_index, component, n, round(j_inlet""", 1),
        "disagreement_components": sql("""SELECT 0 AS scan_index, component, n_vox, n_a, n_vox - n_a AS n_b, extent_z, extent_y, extent_x, round(fill, 3) AS fill, round(elong, 2) AS elongation, round(rf, 3) AS share_a,
          CASE WHEN elong > 8 AND fill < 0.25 THEN 'boundary_strip' WHEN abs(rf - 0.5) < 0.2 AND elong > 3 THEN 'interleaved_boundary' WHEN rf > 0.75 THEN 'raw_dominant' WHEN rf < 0.25 THEN 'tif_dominant' ELSE 'mixed_boundary' END AS kind, round(cz, 1) AS cz, round(cy, 1) AS cy, round(cx, 1) AS cx
          FROM (SELECT *, n_a / n_vox::DOUBLE AS rf, n_vox / (extent_z * extent_y * extent_x)::DOUBLE AS fill, greatest(extent_z, extent_y, extent_x) / least(extent_z, extent_y, extent_x)::DOUBLE AS elong
          FROM (SELECT component, count(*) AS n_vox, count(*) FILTER (in_a) AS n_a, max(z) - min(z) + 1 AS extent_z, max(y) - min(y) + 1 AS extent_y, max(x) - min(x) + 1 AS extent_x, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM gas JOIN rooted USING (id) GROUP BY 1))""", "vox").replace("\nSELECT 0 AS scan_index", f""",
    gas AS (SELECT a.z, a.y, a.x, a.label = 2 AS in_a, (a.z * {NY} + a.y) * {NX} + a.x AS id FROM vox a JOIN vox b ON a.scan_index = 3 AND b.scan_index = 4 AND a.z = b.z AND a.y = b.y AND a.x = b.x WHERE (a.label = 2) <> (b.label = 2)),
    edge AS (SELECT a.id AS s, b.id AS d FROM gas a JOIN gas b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.id <> b.id),
    reach AS (SELECT id, id AS root FROM gas UNION SELECT e.d, r.root FROM reach r JOIN edge e ON r.id = e.s AND r.root < e.d),
    rooted AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)
SELECT 0 AS scan_index""", 1),
        "frozen_boxes": sql("SELECT track_id, z0, z1 FROM boxes", "boxes"),
        "box_counts": sql("SELECT track_id, scan_index, z0, z1, extent_z, gas_voxels, brine_voxels, round(sw_local, 9) AS sw_local, extent_gas, round(cog_z, 6) AS cog_z, round(cog_y, 6) AS cog_y, round(cog_x, 6) AS cog_x FROM counts", "counts"),
        "domain_files": sql(f"SELECT b.track_id, v.scan_index, any_value(z1 - z0) AS nz, {NY} AS ny, {NX} AS nx, count(*) FILTER (label = 2) AS n_open FROM boxes b JOIN vox v ON v.z >= b.z0 AND v.z < b.z1 GROUP BY b.track_id, v.scan_index HAVING count(*) FILTER (label > 0) > 0", "boxes"),
        "cluster_masks": sql(f"SELECT track_id, greatest(0, min(z) - 2) AS z0, least({NZ - 1}, max(z) + 2) AS z1, (least({NZ - 1}, max(z) + 2) - greatest(0, min(z) - 2) + 1) * {NY * NX} AS n_bytes, count(*) AS n_set FROM clusters GROUP BY 1", "clusters"),
        "box_occupancy": sql(f"SELECT track_id, scan_index, round(100.0 * gas_voxels / (extent_z * {NY} * {NX})::DOUBLE, 6) AS occupancy FROM counts", "counts"),
        "sw_local_x": sql("SELECT run_id, track_id, scan_index, gas_voxels, brine_voxels, round(sw_local, 9) AS sw_local, percolates FROM fixed_boxes", "fixed_boxes"),
        "sw_corrected": sql("SELECT run_id, track_id, scan_index, round(sw_corrected, 9) AS sw_corrected FROM corrected", "sim"),
        "domain_names": sql("SELECT name FROM names", "names"),
        "domain_name_parse": sql(f"SELECT name, lower(regexp_extract(name, '{DOMAIN}', 1, 'i')) AS kind, CAST(regexp_extract(name, '{DOMAIN}', 2, 'i') AS INT) AS track, regexp_extract(name, '{DOMAIN}', 3, 'i') AS scan, CAST(regexp_extract(name, '{DOMAIN}', 4, 'i') AS DOUBLE) AS voxel_um, CAST(regexp_extract(name, '{DOMAIN}', 6, 'i') AS INT) AS nx, CAST(regexp_extract(name, '{DOMAIN}', 8, 'i') AS INT) AS nz FROM names WHERE regexp_matches(name, '{DOMAIN}', 'i')", "names"),
        "scan_prefix": "SELECT name, regexp_extract(name, '^([0-9]+(?:_[0-9]+)*)(?:_|$)', 1) AS prefix, coalesce(nullif(regexp_extract(name, '^([0-9]+(?:_[0-9]+)*)(?:_|$)', 1), ''), name) AS prefix_or_name FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '_' || o_custkey || '_sub' WHEN o_orderkey % 3 = 1 THEN o_orderkey::VARCHAR ELSE 'x' || o_orderkey END AS name FROM orders)",
        "scan_order": "SELECT name, row_number() OVER (ORDER BY CASE WHEN regexp_matches(name, '^[0-9]+_[0-9]+') THEN 0 ELSE 1 END, TRY_CAST(split_part(name, '_', 1) AS BIGINT), TRY_CAST(split_part(name, '_', 2) AS BIGINT), name) - 1 AS scan_index FROM (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'raw' || s_suppkey ELSE (s_suppkey % 11) || '_' || s_suppkey || '_a' END AS name FROM supplier)",
        "int_list_parse": "SELECT s_suppkey, list_sort(list_distinct([s_suppkey % 5] || range(s_suppkey % 7, s_suppkey % 7 + 3 + 1))) AS ids FROM supplier",
        "unit_conversion": "SELECT l_orderkey, l_linenumber, round(l_quantity * 1e-13 / 9.869233e-13, 9) AS darcy, round(l_quantity * 1e-13 / 9.869233e-13 * 1000, 6) AS millidarcy, round(cbrt(l_extendedprice * 1e-9 / l_quantity), 9) AS edge FROM lineitem",
        "job_estimates": sql("SELECT track_id, scan_index, round(gas_voxels * 200000 / (69.44e6 * 4) / 60, 9) AS minutes, round(extent_z * 0.085::DOUBLE, 6) AS gb FROM counts", "counts"),
        "gas_pct_change": sql("SELECT run_id, track_id, scan_index, round(100 * (gas_voxels - lag(gas_voxels) OVER w) / nullif(lag(gas_voxels) OVER w, 0)::DOUBLE, 6) AS pct_change FROM fixed_boxes WINDOW w AS (PARTITION BY run_id, track_id ORDER BY scan_index)", "fixed_boxes"),
        "sat_coherence": sql("SELECT c.scan_index, count(sw_local) AS n, round(avg(sw_local), 9) AS mean_sw, round(min(sw_local), 9) AS min_sw, round(max(sw_local), 9) AS max_sw, round(stddev_pop(sw_local), 9) AS sd_sw, round(max(sw_local) - min(sw_local), 9) AS spread, round(avg(sw_local) - any_value(sw), 9) AS \"offset\" FROM counts c JOIN sw USING (scan_index) GROUP BY 1", "counts"),
        "z_rank": sql("SELECT run_id, track_id, m AS z_mid, row_number() OVER (PARTITION BY run_id ORDER BY m, track_id) AS z_rank FROM (SELECT run_id, track_id, (min(z0) + min(z1)) / 2.0 AS m FROM fixed_boxes GROUP BY run_id, track_id)", "fixed_boxes"),
        "section_pivot": sql("SELECT scan_index, " + ", ".join(f"round(max(sw_local) FILTER (z_rank = {i}), 9) AS s{i}" for i in range(1, 9)) + ", round(avg(sw_local), 9) AS mean_sw, round(stddev_pop(sw_local), 9) AS sd_sw FROM counts JOIN (SELECT track_id, row_number() OVER (ORDER BY (z0 + z1) / 2.0, track_id) AS z_rank FROM boxes) USING (track_id) GROUP BY 1", "counts"),
        "kr_table": sql("SELECT run_id, track_id, simulator, scan_index, sim_type, round(kr, 9) AS kr FROM kr", "kr"),
        "kr_wide": sql("SELECT run_id, track_id, simulator, scan_index, round(sw, 9) AS sw, round(kr_gas, 9) AS kr_gas, round(kr_brine, 9) AS kr_brine FROM wide", "kr"),
        "kr_complete": sql("SELECT run_id, track_id, simulator, scan_index FROM wide WHERE sw IS NOT NULL AND kr_gas IS NOT NULL AND kr_brine IS NOT NULL AND track_id <> 4", "kr"),
        "kr_per_timestep": sql("SELECT run_id, simulator, scan_index, count(*) AS n, round(avg(sw), 9) AS mean_sw, round(stddev_pop(sw), 9) AS sd_sw, round(avg(kr_gas), 9) AS mean_kr_gas, round(stddev_pop(kr_gas), 9) AS sd_kr_gas, round(avg(kr_brine), 9) AS mean_kr_brine, round(stddev_pop(kr_brine), 9) AS sd_kr_brine FROM wide GROUP BY ALL", "kr"),
        "kabs_summary": sql("SELECT run_id, track_id, simulator, round(k_z / 9.869233e-13 * 1000, 6) AS k_md, round(k_z / 9.869233e-13, 9) AS k_d, round(100 * (k_z - 3.703e-13) / 3.703e-13, 6) AS dev_reference, round(100 * (k_z / avg(k_z) OVER (PARTITION BY run_id, simulator) - 1), 6) AS dev_mean FROM sim WHERE sim_type = 'absolute'", "sim"),
        "error_bars": with_bars + "SELECT run_id, simulator, track_id, scan_index, round(sigma, 9) AS sigma FROM bars",
        "corey_eval": sql(f"SELECT ordinal, round(kr_gas, 9) AS kr_gas, round(kr_brine, 9) AS kr_brine, round(0.9467 * pow({gas}, 2.154), 9) AS kr_gas_standard FROM baseline", "baseline"),
        "curve_rmse": sql(f"SELECT count(*) AS n, round(sqrt(avg(pow(kr_gas - (0.7699 * pow({gas}, 3.339) + 0.2946 / 1.2946 * {gas}), 2))), 9) AS rmse FROM wide WHERE kr_gas IS NOT NULL AND simulator = 'LIR'", "kr"),
        "corey_grid_fit": with_bars + f"""SELECT run_id, simulator, 'gas' AS phase, round(n, 6) AS n, round(k0, 6) AS k0 FROM (SELECT run_id, simulator, n, sum(w * f * value) / sum(w * f * f) AS k0, sum(w * value * value) - sum(w * f * value) * (sum(w * f * value) / sum(w * f * f)) AS sse FROM (SELECT run_id, simulator, n, kr_gas AS value, pow({gas}, n) AS f, 1 / (sigma * sigma) AS w FROM bars, (SELECT 2.0 + range * 0.05::DOUBLE AS n FROM range(81))) GROUP BY ALL HAVING sum(w * f * f) > 0)
          QUALIFY row_number() OVER (PARTITION BY run_id, simulator ORDER BY round(sse, 8), n) = 1""",
        "nearest_sw": sql("SELECT run_id, track_id, simulator, scan_index, ordinal, round(100 * (kr_gas - b_gas) / nullif(b_gas, 0), 6) AS dev_gas, round(100 * (kr_brine - b_brine) / nullif(b_brine, 0), 6) AS dev_brine FROM (SELECT w.*, b.ordinal, b.kr_gas AS b_gas, b.kr_brine AS b_brine, row_number() OVER (PARTITION BY run_id, track_id, simulator, scan_index ORDER BY round(abs(w.sw - b.sw), 12), b.ordinal) AS r FROM wide w, baseline b WHERE w.sw IS NOT NULL) WHERE r = 1", "kr", "baseline"),
        "rev_effect": sql("""SELECT run_id, simulator, count(y) AS n_all, round(corr(x, y), 6) AS r_all, round(regr_slope(y, x), 6) AS slope_all, count(y) FILTER (ok) AS n_inliers FROM (SELECT *, y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY run_id, simulator) AS q1, quantile_cont(y, 0.75) OVER (PARTITION BY run_id, simulator) AS q3
          FROM (SELECT s.run_id, simulator, b.extent_z::DOUBLE AS x, k_z / 9.869233e-13 * 1000 AS y FROM (SELECT * FROM fixed_boxes QUALIFY row_number() OVER (PARTITION BY run_id, track_id, connectivity ORDER BY is_x DESC, scan_index) = 1) b JOIN sim s USING (run_id, track_id, connectivity) WHERE sim_type = 'absolute'))) GROUP BY ALL""", "sim"),
        "iqr_outliers": "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1",
        "cross_solver": sql("SELECT a.run_id, a.scan_index, a.track_id, a.sim_type, round(100 * (b.k_z - a.k_z) / nullif(a.k_z, 0), 6) AS deviation FROM sim a JOIN sim b USING (run_id, scan_index, track_id, connectivity, sim_type) WHERE a.simulator = 'LIR' AND b.simulator = 'lbm_MRT'", "sim"),
        "latest_run": sql("SELECT max_by(run_id, started_at) AS run_id FROM runs", "runs"),
        "latest_run_with_results": sql("SELECT max_by(run_id, started_at) AS run_id FROM runs WHERE EXISTS (SELECT 1 FROM sim WHERE sim.run_id = runs.run_id)", "sim"),
        "run_listing": sql("SELECT run_id, (SELECT count(*) FROM scans s WHERE s.run_id = r.run_id) AS n_scans, (SELECT count(*) FROM scans s WHERE s.run_id = r.run_id AND qualifying) AS n_qualifying, (SELECT string_agg(DISTINCT connectivity, ',') FROM fixed_boxes f WHERE f.run_id = r.run_id) AS connectivities, (SELECT count(DISTINCT track_id) FROM fixed_boxes f WHERE f.run_id = r.run_id) AS n_tracks, (SELECT string_agg('8_' || scan_index, ',' ORDER BY scan_index) FROM scans s WHERE s.run_id = r.run_id) AS scan_names FROM runs r", "scans", "fixed_boxes"),
        "track_profile": sql("SELECT run_id, connectivity, track_id, count(DISTINCT scan_index) AS n_scans, min(extent_z) AS min_extent, max(extent_z) AS max_extent, round(min(sw_local), 9) AS min_sw, round(max(sw_local), 9) AS max_sw, max(extent_z) < 4 AS thin FROM fixed_boxes GROUP BY ALL", "fixed_boxes"),
        "orphan_counts": sql("SELECT 'scans_runs' AS relation, (SELECT count(*) FROM scans LEFT JOIN runs USING (run_id) WHERE runs.started_at IS NULL) AS n UNION ALL SELECT 'boxes_runs', (SELECT count(*) FROM fixed_boxes f WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.run_id = f.run_id)) UNION ALL SELECT 'boxes_scans', (SELECT count(*) FROM fixed_boxes f WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.run_id = f.run_id AND s.scan_index = f.scan_index)) UNION ALL SELECT 'results_boxes', (SELECT count(*) FROM sim WHERE track_id > 5)", "scans", "sim"),
        "provenance_join": sql("SELECT s.run_id, s.scan_index, s.track_id, s.sim_type, s.simulator, z0, z1, gas_voxels, brine_voxels, file_name, round(c.sw, 9) AS sw_global FROM sim s JOIN fixed_boxes USING (run_id, scan_index, track_id, connectivity) JOIN scans c ON c.run_id = s.run_id AND c.scan_index = s.scan_index", "scans", "sim"),
        "convergence": sql("SELECT simulator, count(*) AS n, count(*) FILTER (flag = 'converged') AS n_converged, round(median(bound), 6) AS median_bound, min(bound) AS min_bound, max(bound) AS max_bound, round(avg((bound < 0.01)::INT), 9) AS share_below FROM sim GROUP BY 1", "sim"),
        "scan_inventory": sql("SELECT run_id, (SELECT count(*) FROM scans s WHERE s.run_id = r.run_id) AS n_scans, (SELECT count(*) FROM fixed_boxes s WHERE s.run_id = r.run_id) AS n_boxes, (SELECT count(*) FROM sim s WHERE s.run_id = r.run_id AND simulator = 'LIR') AS n_lir, (SELECT count(*) FROM sim s WHERE s.run_id = r.run_id AND simulator LIKE 'lbm%') AS n_lbm FROM runs r", "scans", "sim"),
        "select_domains": sql("SELECT run_id, scan_index, track_id, k AS sim_type FROM fixed_boxes, (VALUES ('absolute'), ('gas'), ('water')) k(k) WHERE track_id IN (1, 2, 3) AND k IN ('absolute', 'gas') AND extent_z >= 4 AND (is_x OR k <> 'absolute')", "fixed_boxes"),
        "job_list": sql("SELECT run_id, scan_index, track_id, k AS sim_type, CASE k WHEN 'absolute' THEN gas_voxels + brine_voxels WHEN 'gas' THEN gas_voxels ELSE brine_voxels END AS fluid_voxels FROM fixed_boxes, (VALUES ('absolute'), ('gas'), ('water')) k(k) WHERE is_x = (k = 'absolute')", "fixed_boxes"),
        "resume_todo": sql("SELECT run_id, scan_index, track_id, k AS sim_type FROM fixed_boxes, (VALUES ('absolute'), ('gas'), ('water')) k(k) WHERE is_x = (k = 'absolute') AND NOT EXISTS (SELECT 1 FROM sim s WHERE s.run_id = fixed_boxes.run_id AND s.scan_index = fixed_boxes.scan_index AND s.track_id = fixed_boxes.track_id AND s.sim_type = k)", "sim"),
        "delete_empty_runs": sql("SELECT 'runs' AS tbl, count(*) AS n FROM runs WHERE run_id <> 'r3' UNION ALL SELECT 'scans', count(*) FROM scans WHERE run_id <> 'r3' UNION ALL SELECT 'fixed_boxes', count(*) FROM fixed_boxes WHERE run_id <> 'r3'", "scans", "fixed_boxes"),
        "preflight_gates": sql(f"""SELECT name, CASE WHEN NOT m THEN 'bad_name' WHEN NOT regexp_matches(scan, '^\\d+$') THEN 'bad_scan' WHEN track = 1 AND scan = '1' AND kind = 'gas' THEN 'done' WHEN track = 1 AND scan = '1' AND kind = 'water' THEN 'stale' WHEN EXISTS (SELECT 1 FROM fixed_boxes f WHERE f.track_id = track AND f.scan_index::VARCHAR = scan) THEN 'run' ELSE 'run_no_box' END AS gate
          FROM (SELECT name, regexp_matches(name, '{DOMAIN}', 'i') AS m, lower(regexp_extract(name, '{DOMAIN}', 1, 'i')) AS kind, TRY_CAST(regexp_extract(name, '{DOMAIN}', 2, 'i') AS INT) AS track, regexp_extract(name, '{DOMAIN}', 3, 'i') AS scan FROM names)""", "names"),
        "output_summary": sql("SELECT run_id, count(*) AS n_boxes, count(*) FILTER (percolates) AS n_percolating, count(*) FILTER (gas_voxels = 0) AS n_empty, CAST(sum(gas_voxels) AS BIGINT) AS gas, CAST(sum(brine_voxels) AS BIGINT) AS brine FROM fixed_boxes GROUP BY 1", "fixed_boxes"),
        "overview": sql("SELECT 'scans' AS field, (SELECT count(*) FROM scans WHERE run_id = 'r1')::VARCHAR AS value UNION ALL SELECT 'fixed_boxes', (SELECT count(*) FROM fixed_boxes WHERE run_id = 'r1')::VARCHAR", "scans", "fixed_boxes"),
        "upsert_replace": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 1.0 FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey > 0",
        "insert_ignore": "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 1.0 FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey > 0",
        "update_coalesce": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders",
        "anti_semi_join": "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "distinct_list": "SELECT l_shipmode_key AS k, count(DISTINCT l_returnflag) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) FILTER (l_quantity > 25) AS n_large FROM (SELECT l_linenumber AS l_shipmode_key, * FROM lineitem) GROUP BY 1",
        "fixed_histogram": "SELECT width_bucket_ AS bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE CAST(floor(l_quantity / 5) AS INT) + 1 END AS width_bucket_ FROM lineitem) GROUP BY 1",
        "json_extract": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1",
        "latest_rows": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
        "am_history": "SELECT 's' || s_suppkey AS scan_file, 1 AS step_order, 'Filter_' || s_suppkey % 3 AS module, 'L' || s_suppkey AS label, '9.1' AS version, s_suppkey::VARCHAR AS size FROM supplier UNION ALL SELECT 's' || s_suppkey, 2, 'Crop', NULL, NULL, NULL FROM supplier",
        "am_voxel_size": "SELECT 's' || s_suppkey AS scan_file, 'ushort' AS dtype, 'hxzip' AS codec, 3 AS nz, 5 AS ny, s_suppkey % 4 + 1 AS nx, round(3 * s_suppkey / 2.0::DOUBLE, 6) AS dz, round(2 * s_suppkey / 4.0::DOUBLE, 6) AS dy, CASE WHEN s_suppkey % 4 > 0 THEN round(s_suppkey / (s_suppkey % 4)::DOUBLE, 6) END AS dx, 3.0 AS last_dz, 9.0 AS last_dy, 1.0 AS last_dx FROM supplier",
        "saturation_ref": "SELECT s_suppkey AS scan_index, '8_' || s_suppkey || '_sub.am' AS file_name, r.m AS elapsed_minutes, r.sw AS sw_ref FROM supplier LEFT JOIN (SELECT s_suppkey % 40 AS p, max(s_suppkey) * 2.0::DOUBLE AS m, round(1 - max_by(s_suppkey % 100 / 100.0::DOUBLE, s_suppkey), 6) AS sw FROM supplier GROUP BY 1) r ON r.p = s_suppkey",
        "latest_run_by_connectivity": sql("SELECT connectivity, max_by(run_id, started_at) AS run_id FROM (SELECT run_id, connectivity FROM fixed_boxes UNION SELECT 'r2', '26') JOIN runs USING (run_id) GROUP BY 1", "fixed_boxes"),
        "face_memberships": sql(f"SELECT scan_index, component, CASE WHEN bool_or(z = 0) AND bool_or(z = {NZ - 1}) THEN 'both' WHEN bool_or(z = 0) THEN 'a' ELSE 'b' END AS side FROM lab WHERE z IN (0, {NZ - 1}) GROUP BY 1, 2", "lab6"),
        "panel_picks": sql("SELECT run_id, scan_index, is_x FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY scan_index) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM scans) WHERE n <= 5 OR is_x OR i IN (SELECT round_even(k * (n - 1) / 3.0::DOUBLE, 0) FROM range(4) t(k)) UNION ALL SELECT 'all', scan_index, is_x FROM scans WHERE run_id = 'r1'", "scans"),
        "z_rank_of_results": sql("SELECT s.run_id, s.track_id, s.scan_index, sim_type, simulator, coalesce(z_rank, 999) AS z_rank FROM sim s LEFT JOIN (SELECT run_id, track_id, row_number() OVER (PARTITION BY run_id ORDER BY m, track_id) AS z_rank FROM (SELECT run_id, track_id, (min(z0) + min(z1)) / 2.0 AS m FROM fixed_boxes WHERE track_id <> 2 GROUP BY run_id, track_id)) r ON r.run_id = s.run_id AND r.track_id = s.track_id", "sim"),
        "kr_back_fill": sql("SELECT run_id, track_id, scan_index, sim_type, simulator, CASE WHEN simulator = 'lbm_MRT' AND sim_type <> 'absolute' THEN round(k_z / k, 9) END AS kr FROM sim LEFT JOIN (SELECT run_id, track_id, max(k_z) AS k FROM sim WHERE sim_type = 'absolute' AND simulator = 'lbm_MRT' AND k_z > 0 GROUP BY 1, 2) USING (run_id, track_id)", "sim"),
        "kr_write_back": sql("SELECT s.run_id, s.track_id, s.scan_index, s.sim_type, s.simulator, round(k.kr, 9) AS kr FROM sim s LEFT JOIN (SELECT * FROM kr WHERE simulator = 'LIR' AND run_id = 'r1') k ON k.run_id = s.run_id AND k.track_id = s.track_id AND k.scan_index = s.scan_index AND k.connectivity = s.connectivity AND k.sim_type = s.sim_type", "kr"),
        "export_summary_kr": sql("""SELECT track_id AS track, scan_index AS scan, round(sw_local, 6) AS sw_local, round(k_abs / 9.869233e-13 * 1000, 6) AS k_abs_md, round(k_gas / 9.869233e-13 * 1000, 6) AS k_gas_md, round(k_brine / 9.869233e-13 * 1000, 6) AS k_brine_md, round(k_gas / k_abs, 6) AS kr_gas, round(k_brine / k_abs, 6) AS kr_brine
          FROM (SELECT track_id, scan_index, avg(k_z) FILTER (sim_type = 'gas') AS k_gas, avg(k_z) FILTER (sim_type = 'water') AS k_brine FROM sim WHERE run_id = 'r2' AND sim_type <> 'absolute' GROUP BY ALL)
          LEFT JOIN (SELECT track_id, avg(k_z) AS k_abs FROM sim WHERE run_id = 'r2' AND sim_type = 'absolute' GROUP BY ALL) USING (track_id) LEFT JOIN (SELECT track_id, scan_index, sw_local FROM fixed_boxes WHERE run_id = 'r2') USING (track_id, scan_index)""", "sim"),
        "export_summary_kabs": sql("SELECT track_id AS track, round(avg(k_z) / 9.869233e-13 * 1000, 6) AS k_abs_md, round(avg(k_z) / 9.869233e-13, 6) AS k_abs_d FROM sim WHERE run_id = 'r2' AND sim_type = 'absolute' GROUP BY ALL", "sim"),
        "export_overview": sql("""SELECT field, value FROM (VALUES ('run_id', 'r2'), ('connectivity_filter', '(all)'), ('runs.run_id', 'r2'), ('n_rows.runs', '1')) v(field, value) UNION ALL SELECT unnest(['n_rows.scans', 'n_scans']), count(*)::VARCHAR FROM scans WHERE run_id = 'r2'
          UNION ALL SELECT 'n_rows.fixed_boxes', count(*)::VARCHAR FROM fixed_boxes WHERE run_id = 'r2' UNION ALL SELECT unnest(['n_rows.simulation_results', 'n_sim_results']), count(*)::VARCHAR FROM sim WHERE run_id = 'r2'""", "scans", "sim"),
        "export_sheets": sql("""SELECT * FROM (SELECT 'summary_kr' AS sheet, count(*) AS n, 8 AS n_columns FROM (SELECT DISTINCT track_id, scan_index FROM sim WHERE run_id = 'r2' AND sim_type <> 'absolute') UNION ALL SELECT 'summary_kabs', count(DISTINCT track_id), 4 FROM sim WHERE run_id = 'r2' AND sim_type = 'absolute'
          UNION ALL SELECT 'runs', 1, 2 UNION ALL SELECT 'scans', count(*), 7 FROM scans WHERE run_id = 'r2' UNION ALL SELECT 'fixed_boxes', count(*), 19 FROM fixed_boxes WHERE run_id = 'r2' UNION ALL SELECT 'simulation_results', count(*), 10 FROM sim WHERE run_id = 'r2') WHERE n > 0 OR sheet NOT LIKE 'summary%'""", "scans", "sim"),
        "file_formats": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN (l_orderkey % 97)::INT END AS file_index, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s % 3600 // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock,
          CASE WHEN s >= 1000000000 THEN ((s + 50000000) // 100000000) // 10 || '.' || ((s + 50000000) // 100000000) % 10 || 'B' WHEN s >= 1000000 THEN ((s + 50000) // 100000) // 10 || '.' || ((s + 50000) // 100000) % 10 || 'M' WHEN s >= 1000 THEN ((s + 50) // 100) // 10 || '.' || ((s + 50) // 100) % 10 || 'K' ELSE s::VARCHAR END AS count, round(l_quantity::DOUBLE * 5e-6 * 5e-6 * 5e-6 * 1e9, 12) AS volume FROM (SELECT *, floor(l_quantity * l_orderkey)::BIGINT AS s FROM lineitem)""",
        "latex_table": r"SELECT string_agg(n_nationkey || ' & ' || replace(n_name, '_', '\_') || '\_x & ' || CASE WHEN n_nationkey % 5 > 0 THEN format('{:.3f}', n_nationkey / 8.0::DOUBLE) ELSE '--' END || ' \\', chr(10) ORDER BY n_nationkey) AS latex FROM nation",
        "solver_results": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 > 0 THEN (s_suppkey % 90)::INT END AS nx, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey % 7 + 0.5::DOUBLE END AS k_z, CASE WHEN s_suppkey % 10 > 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'time' ELSE 'converged' END END AS flag FROM supplier",
        "solver_outputs": "SELECT s_suppkey AS k, (s_suppkey % 50)::VARCHAR AS nx, s_suppkey % 11 || '.75' AS perm_z, (s_suppkey % 9 || '.5e-3')::DOUBLE AS logged FROM supplier",
        "saturation_file": "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS row_number, s_suppkey || '_scan' AS name, (s_suppkey % 100) / 100.0::DOUBLE AS sg, s_suppkey::DOUBLE AS elapsed_minutes FROM supplier QUALIFY s_suppkey % 6 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 5 > 0",
        "versioned_changes": """WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_totalprice END AS p FROM orders UNION ALL SELECT -o_orderkey, 1.0 FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey > 0)
          SELECT k AS o_orderkey, p AS o_totalprice FROM (SELECT * FROM u UNION ALL SELECT o_orderkey + 1, 2.0 FROM orders WHERE o_orderkey + 1 NOT IN (SELECT k FROM u)) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""",
        "versioned_restore": "SELECT v.v::INT AS version, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES (1), (2), (3)) v(v) WHERE v.v <> 2 OR o_orderkey % 2 <> 0 GROUP BY v.v",
        "path_resolution": """WITH stored AS (SELECT 'D:\\Out\\R' || s_suppkey % 4 || '\\S' || s_suppkey % 7 || '\\Domain_' || s_suppkey || '.raw' AS path FROM supplier),
          files AS (SELECT DISTINCT '/data/' || CASE WHEN p_partkey % 3 = 0 THEN 'r' || p_partkey % 4 || '/' ELSE '' END || 's' || p_partkey % 7 || '/domain_' || p_partkey % 120 || '.raw' AS path FROM part),
          a AS (SELECT path, string_split(lower(replace(path, '\\', '/')), '/') AS p FROM stored), b AS (SELECT path, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS p FROM files),
          c AS (SELECT a.path AS stored, b.path AS found, CASE WHEN a.p[-1] <> b.p[-1] THEN 0 WHEN a.p[-2] IS DISTINCT FROM b.p[-2] THEN 1 WHEN a.p[-3] IS DISTINCT FROM b.p[-3] THEN 2 WHEN a.p[-4] IS DISTINCT FROM b.p[-4] THEN 3 ELSE 4 END AS agreed FROM a, b),
          d AS (SELECT *, max(agreed) OVER (PARTITION BY stored) AS most FROM c WHERE agreed >= 2)
          SELECT path AS stored, min(found) AS found, min(agreed)::INT AS agreed, count(found) AS n_found FROM stored LEFT JOIN d ON d.stored = path AND agreed = most GROUP BY path""",
        "stream_sw_windows": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    }
    evolution = lambda name, level: f"{name} AS (SELECT s.scan_index, s.gas, coalesce(p.percolates, FALSE) AS percolates FROM sw s LEFT JOIN (WITH RECURSIVE {_components(level)} SELECT scan_index, bool_or(lo AND hi) AS percolates FROM (SELECT scan_index, component, bool_or(z = 0) AS lo, bool_or(z = {NZ - 1}) AS hi FROM lab GROUP BY ALL) GROUP BY 1) p USING (scan_index))"
    q["connectivity_comparison"] = sql("SELECT 1", "sw").rsplit("\n", 1)[0] + f""",
    {evolution("e6", 1)},
    {evolution("e26", 3)},
    part AS (SELECT * FROM (VALUES ('whole', 0), ('late', 2)) t(part, low)),
    a AS (SELECT part, e6.*, row_number() OVER (PARTITION BY part ORDER BY scan_index) AS i FROM e6, part WHERE scan_index >= low), b AS (SELECT part, e26.*, row_number() OVER (PARTITION BY part ORDER BY scan_index) AS i FROM e26, part WHERE scan_index >= low)
    SELECT part, gas_a, gas_b, gas_a - gas_b AS difference, round(100 * (gas_a - gas_b)::DOUBLE / nullif(gas_b, 0), 6) AS relative, n_compared, n_disagree FROM (SELECT part, max_by(a.gas, a.scan_index) AS gas_a, max_by(b.gas, b.scan_index) AS gas_b, count(*) AS n_compared, count(*) FILTER (a.percolates <> b.percolates) AS n_disagree FROM a JOIN b USING (part, i) GROUP BY 1)"""
    largest = lambda name, level: f"{name} AS (WITH RECURSIVE {_components(level)} SELECT * FROM (SELECT scan_index, row_number() OVER (PARTITION BY scan_index ORDER BY n DESC, component) AS label_id, n, z, y, x FROM (SELECT scan_index, component, count(*) AS n, avg(z) AS z, avg(y) AS y, avg(x) AS x FROM lab GROUP BY 1, 2)) WHERE label_id <= 8)"
    apart = "sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2))"
    q["match_across_connectivity"] = sql("", "vox").rstrip() + f""",
    {largest("c6", 1)},
    {largest("c18", 2)},
    near AS (SELECT a.scan_index, a.label_id, list({{'d': {apart}, 'b': b.label_id}} ORDER BY {apart}, b.label_id) FILTER ({apart} <= 5) AS found FROM c6 a LEFT JOIN c18 b USING (scan_index) GROUP BY ALL),
    turn AS (SELECT scan_index, 0::BIGINT AS label_a, NULL::STRUCT(d DOUBLE, b BIGINT) AS got, []::BIGINT[] AS used FROM c6 GROUP BY ALL
      UNION ALL SELECT scan_index, label_id, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.b) END FROM (SELECT n.scan_index, n.label_id, t.used, list_filter(n.found, lambda f: NOT list_contains(t.used, f.b))[1] AS got FROM turn t JOIN near n ON n.scan_index = t.scan_index AND n.label_id = t.label_a + 1))
    SELECT scan_index, CAST(label_a AS INT) AS label_a, CAST(got.b AS INT) AS label_b, round(got.d, 6) AS distance FROM turn WHERE label_a > 0
    UNION ALL SELECT scan_index, NULL, CAST(label_id AS INT), NULL FROM c18 WHERE NOT EXISTS (SELECT 1 FROM turn t WHERE t.scan_index = c18.scan_index AND t.got.b = c18.label_id)"""
    state = "STRUCT(track_id BIGINT, status VARCHAR, first_seen INT, last_seen INT, seen INT, lost INT, n BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, open BOOLEAN, met BOOLEAN)"
    # the end of a scan: tracks that were open and met nothing are lost, the active ones are open to the next scan
    ended = "list_transform(tracks, lambda t: struct_update(t, status := CASE WHEN t.open AND NOT t.met THEN 'lost' ELSE t.status END, lost := CASE WHEN t.open AND NOT t.met THEN t.lost + 1 ELSE t.lost END, open := t.status = 'active' AND (t.met OR NOT t.open), met := FALSE))"
    q["track_clusters"] = sql("", "vox").rstrip() + f""",
    {largest("c6", 1)},
    line AS (SELECT *, row_number() OVER (ORDER BY scan_index DESC, label_id) AS i, lag(scan_index) OVER (ORDER BY scan_index DESC, label_id) IS DISTINCT FROM scan_index AS fresh, scan_index IN (min(scan_index) OVER (), max(scan_index) OVER ()) AS seeds FROM c6),
    walk AS (SELECT 0::BIGINT AS i, []::{state}[] AS tracks
      UNION ALL SELECT i, CASE WHEN hit.track_id IS NOT NULL THEN list_transform(tracks, lambda t: CASE WHEN t.track_id = hit.track_id THEN struct_update(t, last_seen := scan_index, seen := t.seen + 1, lost := 0, n := n, z := z, y := y, x := x, met := TRUE) ELSE t END)
          WHEN seeds THEN list_append(tracks, {{'track_id': len(tracks), 'status': 'active', 'first_seen': scan_index, 'last_seen': scan_index, 'seen': 1, 'lost': 0, 'n': n, 'z': z, 'y': y, 'x': x, 'open': FALSE, 'met': FALSE}}::{state}) ELSE tracks END
        FROM (SELECT *, list_sort(list_filter(list_transform(list_filter(tracks, lambda t: t.open), lambda t: {{'d': sqrt(pow(t.z - z, 2) + pow(t.y - y, 2) + pow(t.x - x, 2)), 'track_id': t.track_id}}), lambda d: d.d < 4.0))[1] AS hit
        FROM (SELECT l.* EXCLUDE (i), l.i, CASE WHEN l.fresh THEN {ended} ELSE tracks END AS tracks FROM walk w JOIN line l ON l.i = w.i + 1)))
    SELECT 'r1' AS series, CAST(t.track_id AS INT) AS track_id, t.status, t.first_seen, t.last_seen, t.seen AS timesteps_seen, t.lost AS timesteps_lost, t.n AS final_voxels, round(t.z, 6) AS cog_z, round(t.y, 6) AS cog_y, round(t.x, 6) AS cog_x
    FROM (SELECT unnest({ended}) AS t FROM (SELECT tracks FROM walk ORDER BY i DESC LIMIT 1))"""
    q["stream_track_clusters"] = q["track_clusters"].replace("ORDER BY scan_index DESC, label_id", "ORDER BY scan_index, label_id").replace("scan_index IN (min(scan_index) OVER (), max(scan_index) OVER ())", "scan_index = min(scan_index) OVER ()")
    new = f"SELECT run_id, 'LIR' AS dataset, 'grid' AS form, phase, '[\"n\"]' AS param_names, to_json([round(n, 4)])::VARCHAR AS param_values, n_points FROM ({q['corey_grid_fit']}) JOIN ({with_bars} SELECT run_id, simulator, count(*) AS n_points FROM bars GROUP BY ALL) USING (run_id, simulator) WHERE simulator = 'LIR'"
    q["fit_records"] = f"WITH new AS ({new}) SELECT * FROM new UNION ALL SELECT * REPLACE ('basic' AS form, '[0]' AS param_values) FROM new WHERE run_id = 'r1'"
    return q
