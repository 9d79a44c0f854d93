"""Bounded weighted fits of Corey curves, with covariance and confidence bands."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpointed
from .quantiles import same

#: Bounds (k0, n, c) of each data set and phase.
BOUNDS = {
    ("h2", "gas"): ((0.2, 1.0), (2.0, 6.0), (0.0, 0.5)),
    ("h2", "brine"): ((0.19, 1.0), (2.0, 6.0), (0.0, 0.0)),
    ("ch4", "gas"): ((0.2, 1.0), (1.3, 6.0), (0.0, 0.5)),
    ("ch4", "brine"): ((0.10, 1.0), (2.0, 6.0), (0.0, 0.0)),
}
SEED = 0


@dataclass(frozen=True)
class Fit:
    k0: float
    n: float
    c: float
    rmse: float
    chi2: float
    at_bound: list[str]
    cov: np.ndarray | None


def _linear(x: np.ndarray, y: np.ndarray, bounds: list[tuple[float, float]]) -> tuple[float, np.ndarray]:
    """Least squares in a box for one or two unknowns: every choice of active bounds is tried."""
    best, at = np.inf, np.zeros(x.shape[1])
    for choice in itertools.product(*[(None, *sorted(set(b))) for b in bounds]):
        free = [i for i, v in enumerate(choice) if v is None]
        p = np.array([0.0 if v is None else v for v in choice])
        if free:
            sol, *_ = np.linalg.lstsq(x[:, free], y - x @ p, rcond=None)
            p[free] = sol
            if any(not b[0] - 1e-12 <= p[i] <= b[1] + 1e-12 for i, b in enumerate(bounds)):
                continue
        sse = float(((y - x @ p) ** 2).sum())
        if sse < best:
            best, at = sse, p
    return best, at


def fit_corey(base: Iterable[float], values: Iterable[float], sigma: Iterable[float], bounds: tuple, modified: bool = True) -> Fit | None:
    """Fit k0 b^n + c / (1 + c) b with weights 1 / sigma^2 in a box; None with fewer than 3 finite points.

    For a fixed exponent the curve is linear in k0 and g = c / (1 + c), so the exponent alone is searched: a grid, then golden
    section around its best point. The covariance is (J' W J)^-1 at the optimum, None where that is singular."""
    b, v, s = (np.asarray(list(a), dtype=float) for a in (base, values, sigma))
    ok = np.isfinite(b) & np.isfinite(v) & np.isfinite(s) & (s > 0)
    b, v, s = b[ok], v[ok], s[ok]
    if len(b) < 3:
        return None
    (k_lo, k_hi), (n_lo, n_hi), (c_lo, c_hi) = bounds
    two = modified and c_hi > c_lo
    box = [(k_lo, k_hi), (c_lo / (1 + c_lo), c_hi / (1 + c_hi))][: 2 if two else 1]
    shift = 0.0 if two else (c_lo / (1 + c_lo) if modified else 0.0)

    def solve(n: float) -> tuple[float, np.ndarray]:
        cols = [b**n, b][: 2 if two else 1]
        return _linear(np.stack(cols, axis=1) / s[:, None], (v - shift * b) / s, box)

    grid = np.linspace(n_lo, n_hi, 81)
    i = int(np.argmin([solve(n)[0] for n in grid]))
    lo, hi, phi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], (5**0.5 - 1) / 2
    for _ in range(60):
        x, y = hi - phi * (hi - lo), lo + phi * (hi - lo)
        lo, hi = (lo, y) if solve(x)[0] <= solve(y)[0] else (x, hi)
    n = min((float(grid[i]), (lo + hi) / 2, n_lo, n_hi), key=lambda q: (solve(q)[0], q))
    sse, p = solve(n)
    k0, g = float(p[0]), float(p[1]) if two else shift
    c = g / (1 - g)
    fitted = k0 * b**n + g * b
    named = [("k0", k0, (k_lo, k_hi)), ("n", n, (n_lo, n_hi)), *([("c", c, (c_lo, c_hi))] if two else [])]
    at = [q for q, x, (u, w) in named if min(abs(x - u), abs(x - w)) <= 1e-6 * max(1.0, abs(w - u))]
    with np.errstate(divide="ignore", invalid="ignore"):
        d_n = np.where(b > 0, k0 * b**n * np.log(np.where(b > 0, b, 1)), 0)
    jac = np.stack([b**n, d_n, *([b / (1 + c) ** 2] if two else [])], axis=1) / s[:, None]
    normal = jac.T @ jac
    cov = np.linalg.inv(normal) if np.linalg.cond(normal) < 1e14 else None
    return Fit(k0, n, c, float(np.sqrt(np.mean((v - fitted) ** 2))), sse / max(len(b) - len(named), 1), at, cov)


def band(fit: Fit, base: np.ndarray, bounds: tuple, draws: int = 2000, seed: int = SEED) -> tuple[np.ndarray, np.ndarray] | None:
    """2.5 and 97.5 % of the curves of parameters drawn from the covariance and cut to the bounds.

    None without a covariance, or where a shape parameter (n, c) is at a bound."""
    if fit.cov is None or {"n", "c"} & set(fit.at_bound):
        return None
    m = fit.cov.shape[0]
    p = np.random.default_rng(seed).multivariate_normal([fit.k0, fit.n, fit.c][:m], fit.cov, size=draws)
    p = np.clip(p, [x[0] for x in bounds[:m]], [x[1] for x in bounds[:m]])
    c = p[:, 2] if m == 3 else np.full(draws, fit.c)
    curves = p[:, :1] * base[None, :] ** p[:, 1:2] + (c / (1 + c))[:, None] * base[None, :]
    low, high = np.percentile(curves, (2.5, 97.5), axis=0)
    return low, high


#: Exponents of the first grid; those on either side of the best in each further round, by which the step shrinks; rounds.
FIRST, SIDE, ROUNDS = 81, 20, 4
#: Rows of a fit before they are named: the box, the optimum, the normal matrix's inverse.
_BOX = ("k_lo", "k_hi", "n_lo", "n_hi", "c_lo", "c_hi")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _boxed(points: DataFrame, keys: list[str], dataset: str, modified: bool) -> DataFrame:
    """A row for each key and phase: its rows, its usable rows, and the box of its parameters; g = c / (1 + c) is bounded as c is."""
    usable = _finite(F.col("base")) & _finite(F.col("value")) & _finite(F.col("sigma")) & (F.col("sigma") > 0)
    per = points.groupBy(*keys, "phase").agg(F.count("*").cast("int").alias("n_points"), F.count_if(usable).alias("m"))
    for i, name in enumerate(_BOX):
        of = [F.when(F.col("phase") == phase, float(box[i // 2][i % 2])) for (d, phase), box in BOUNDS.items() if d == dataset]
        per = per.withColumn(name, F.coalesce(*of) if modified or i < 4 else F.lit(0.0))
    g = lambda c: F.col(c) / (1 + F.col(c))
    return per.withColumns({"g_lo": g("c_lo"), "g_hi": g("c_hi"), "two": F.col("c_hi") > F.col("c_lo")})


def _weighed(points: DataFrame, keys: list[str]) -> DataFrame:
    """The usable points, with weights, under prefixed keys."""
    usable = _finite(F.col("base")) & _finite(F.col("value")) & _finite(F.col("sigma")) & (F.col("sigma") > 0)
    return points.where(usable).select(*[F.col(k).alias(f"_{k}") for k in (*keys, "phase")], F.col("base").alias("b"), F.col("value").alias("v"), (1 / (F.col("sigma") * F.col("sigma"))).alias("w"))


def _solved(sums: DataFrame) -> DataFrame:
    """k0, g and the weighted squares of the best curve for the sums of one exponent: convex in a box, so the optimum is the free one
    where that is inside, or else on an edge, where the other unknown is its own optimum cut to the box."""
    cut = lambda x, lo, hi: F.least(F.greatest(x, F.col(lo)), F.col(hi))
    determinant = F.col("ff") * F.col("bb") - F.col("fb") * F.col("fb")
    safe = F.when(determinant > 1e-13 * F.col("ff") * F.col("bb"), determinant)
    k_free, g_free = (F.col("fv") * F.col("bb") - F.col("bv") * F.col("fb")) / safe, (F.col("bv") * F.col("ff") - F.col("fv") * F.col("fb")) / safe
    inside = k_free.between(F.col("k_lo"), F.col("k_hi")) & g_free.between(F.col("g_lo"), F.col("g_hi"))
    squares = lambda k, g: F.col("vv") - 2 * (k * F.col("fv") + g * F.col("bv")) + k * k * F.col("ff") + 2 * k * g * F.col("fb") + g * g * F.col("bb")
    at = lambda k, g: F.struct(squares(k, g).alias("sse"), k.alias("k0"), g.alias("g"))
    of_k = lambda k: F.coalesce(cut(F.try_divide(F.col("bv") - k * F.col("fb"), "bb"), "g_lo", "g_hi"), F.col("g_lo"))
    of_g = lambda g: F.coalesce(cut(F.try_divide(F.col("fv") - g * F.col("fb"), "ff"), "k_lo", "k_hi"), F.col("k_lo"))
    edges = [at(F.col(k), of_k(F.col(k))) for k in ("k_lo", "k_hi")] + [at(of_g(F.col(g)), F.col(g)) for g in ("g_lo", "g_hi")]
    best = F.when(F.coalesce(inside, F.lit(False)), at(k_free, g_free)).otherwise(F.array_min(F.array(*edges)))
    return sums.withColumn("best", best)


def _optima(points: DataFrame, weighed: DataFrame, keys: list[str], dataset: str, modified: bool) -> DataFrame:
    """The box of each key and phase with its optimum ``(n, k0, g)``, null with fewer than three usable points.

    For a fixed exponent the curve is linear in k0 and g, so six sums over the points say which are best. A round has these sums for
    a grid of exponents, added up in tasks before the shuffle; the next one looks around the best with a step SIDE times
    finer. No group's points come together."""
    group = [*keys, "phase"]
    boxed = checkpointed(_boxed(points, keys, dataset, modified))
    around = boxed.where("m >= 3").withColumns({"centre": (F.col("n_lo") + F.col("n_hi")) / 2, "step": (F.col("n_hi") - F.col("n_lo")) / (FIRST - 1)})
    for r in range(ROUNDS + 1):
        half = FIRST // 2 if r == 0 else SIDE
        n = F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: F.least(F.greatest(F.col("centre") + i * F.col("step"), F.col("n_lo")), F.col("n_hi"))))
        box = [*group, *_BOX, "g_lo", "g_hi", "m", "n_points", "two", "centre", "step"]
        rows = weighed.join(around.select(*box), same(group, "_", "")).select(*box, n.alias("n"), "b", "v", "w").withColumn("f", F.pow("b", F.col("n")))
        product = lambda p, q: F.sum(F.col("w") * F.col(p) * F.col(q)).alias(p + q)
        sums = rows.groupBy(*box, "n").agg(product("f", "f"), product("f", "b"), product("b", "b"), product("f", "v"), product("b", "v"), product("v", "v"))
        best = _solved(sums).groupBy(*box).agg(F.min_by(F.struct("n", "best.k0", "best.g"), F.struct("best.sse", "n")).alias("o"))
        around = checkpointed(best.withColumns({"centre": F.col("o.n"), "step": F.col("step") / SIDE}))
    found = around.select(*[F.col(k).alias(f"_{k}") for k in group], "o.n", "o.k0", "o.g")
    return boxed.join(found, same(group, "_", ""), "left").drop(*[f"_{k}" for k in group])


def _fitted(points: DataFrame, keys: list[str], dataset: str, modified: bool) -> DataFrame:
    """Optima with c, their squares, the parameters at bounds and the covariance (v00, v01, v02, v11, v12, v22), null where singular."""
    group = [*keys, "phase"]
    weighed = checkpointed(_weighed(points, keys))  # every round reads them
    o = checkpointed(_optima(points, weighed, keys, dataset, modified).withColumn("c", F.col("g") / (1 - F.col("g"))))
    f = F.pow("b", F.col("n"))
    rows = weighed.join(o.where("n IS NOT NULL").select(*group, "n", "k0", "g", "c"), same(group, "_", ""))
    rows = rows.withColumns({"r": F.col("v") - F.col("k0") * f - F.col("g") * F.col("b"), "j0": f, "j1": F.when(F.col("b") > 0, F.col("k0") * f * F.log("b")).otherwise(0.0), "j2": F.col("b") / F.pow(1 + F.col("c"), F.lit(2.0))})
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = rows.groupBy(*group).agg(F.sum(F.col("w") * F.col("r") * F.col("r")).alias("wrr"), F.sum(F.col("r") * F.col("r")).alias("rr"), *[F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{j}")).alias(f"m{i}{j}") for i, j in pairs])
    a, b, c, d, e, g = (F.when(F.col("two") | F.lit(j < 2), F.col(f"m{i}{j}")).otherwise(float(i == j)) for i, j in pairs)  # without c its row is that of the unit matrix
    minors = (d * g - e * e, c * e - b * g, b * e - c * d, a * g - c * c, b * c - a * e, a * d - b * b)
    determinant = a * minors[0] + b * minors[1] + c * minors[2]
    out = o.join(sums.withColumnsRenamed({k: f"_{k}" for k in group}), same(group, "_", ""), "left").withColumn("det", determinant)
    out = out.withColumns({f"v{i}{j}": F.try_divide(x, F.nullif("det", F.lit(0.0))) for (i, j), x in zip(pairs, minors, strict=True)})
    size = lambda p: sum((F.when(F.col("two") | F.lit(j < 2), F.col(f"{p}{i}{j}") * F.col(f"{p}{i}{j}")).otherwise(0.0) * (1 if i == j else 2) for i, j in pairs), F.lit(0.0))
    sound = (F.col("det") > 0) & (size("m") * size("v") < 1e28) & (F.col("v00") >= 0) & (F.col("v11") >= 0) & (F.col("v22") >= 0)
    out = out.withColumn("sound", F.coalesce(sound, F.lit(False)))
    near = lambda x, lo, hi: F.least(F.abs(F.col(x) - F.col(lo)), F.abs(F.col(x) - F.col(hi))) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(hi) - F.col(lo)))
    names = F.array(F.when(near("k0", "k_lo", "k_hi"), "k0"), F.when(near("n", "n_lo", "n_hi"), "n"), F.when(F.col("two") & near("c", "c_lo", "c_hi"), "c"))
    return out.withColumn("at_bound", F.filter(names, lambda x: x.isNotNull())).drop(*[f"_{k}" for k in group])


def fit_curves(points: DataFrame, keys: list[str], dataset: str = "h2", modified: bool = True) -> DataFrame:
    """A fit of k0 b^n + c / (1 + c) b for each key and phase of ``points(keys, phase, base, value, sigma)``, with weights 1 / sigma^2
    in the box of its phase: parameters, RMSE, reduced chi square, what is at a bound, and deviations by (J' W J)^-1.

    Rows without finite numbers, or without a positive sigma, count in ``n_points`` alone; fewer than three others have no fit."""
    f = _fitted(points, keys, dataset, modified)
    free = F.col("m") - F.when(F.col("two"), 3).otherwise(2)
    sd = lambda v, n, ok: F.when(F.col("sound") & ok, F.sqrt(v)).alias(n)
    return f.select(*keys, "phase", "n_points", "k0", "n", "c", F.sqrt(F.col("rr") / F.col("m")).alias("rmse"), (F.col("wrr") / F.greatest(free, F.lit(1))).alias("chi2"), "at_bound", sd("v00", "sd_k0", F.lit(True)), sd("v11", "sd_n", F.lit(True)), sd("v22", "sd_c", F.col("two")))


def normal(draw: Column, place: int, seed: int) -> Column:
    """A standard normal number that belongs to a draw and a place, by MD5 and Box-Muller; the same in every engine and task."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(str(place))).cast("binary"))
    u = lambda start: (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(9))


def fit_bands(points: DataFrame, keys: list[str], dataset: str = "h2", modified: bool = True, steps: int = 21, draws: int = 2000, seed: int = SEED) -> DataFrame:
    """Curve and its 2.5 and 97.5 % over ``steps`` bases from 0 to 1 for each key and phase: parameters are drawn from the fit's covariance
    and cut to the box. Null bounds without a covariance or where a shape parameter (n, c) is at a bound; groups without a fit have no rows."""
    f = _fitted(points, keys, dataset, modified).where("n IS NOT NULL")
    drawn = F.col("sound") & ~F.arrays_overlap("at_bound", F.array(F.lit("n"), F.lit("c")))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    f = f.withColumn("drawn", drawn).withColumn("l00", root(F.col("v00"))).withColumns({"l10": F.try_divide("v01", "l00"), "l20": F.try_divide("v02", "l00")})
    f = f.withColumn("l11", root(F.col("v11") - F.col("l10") * F.col("l10"))).withColumn("l21", F.try_divide(F.col("v12") - F.col("l20") * F.col("l10"), "l11"))
    f = f.withColumn("l22", root(F.col("v22") - F.col("l20") * F.col("l20") - F.col("l21") * F.col("l21")))
    base = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / (steps - 1)))
    curve = lambda k, n, c: k * F.pow(F.col("base"), n) + c / (1 + c) * F.col("base")
    head = [*keys, "phase"]
    curves = f.select(*head, "k0", "n", "c", base.alias("base")).select(*head, "base", curve(F.col("k0"), F.col("n"), F.col("c")).alias("curve"))
    cut = lambda x, lo, hi: F.least(F.greatest(x, F.col(lo)), F.col(hi))
    some = f.where("drawn").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumns({f"z{i}": normal(F.col("draw"), i, seed) for i in range(3)})
    c = F.when(F.col("two"), cut(F.col("c") + F.col("l20") * F.col("z0") + F.col("l21") * F.col("z1") + F.col("l22") * F.col("z2"), "c_lo", "c_hi")).otherwise(F.col("c"))
    some = some.select(*head, cut(F.col("k0") + F.col("l00") * F.col("z0"), "k_lo", "k_hi").alias("pk"), cut(F.col("n") + F.col("l10") * F.col("z0") + F.col("l11") * F.col("z1"), "n_lo", "n_hi").alias("pn"), c.alias("pc"))
    spread = some.withColumn("base", base).groupBy(*head, "base").agg(F.percentile(curve(F.col("pk"), F.col("pn"), F.col("pc")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # ``draws`` numbers
    spread = spread.withColumnsRenamed({x: f"_{x}" for x in (*head, "base")})
    return curves.join(spread, same([*head, "base"], "", "_"), "left").select(*head, "base", "curve", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def grid_fit(points: DataFrame, keys: list[str], low: float = 2.0, high: float = 6.0, steps: int = 81) -> DataFrame:
    """Basic form on a grid of exponents, with the closed-form k0 of each: n, k0 and weighted error of the best."""
    n = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(low) + i * ((high - low) / (steps - 1)))).alias("n")
    g = points.select(*keys, "phase", "base", "value", "sigma", n).withColumn("f", F.pow("base", F.col("n"))).withColumn("w", 1 / (F.col("sigma") * F.col("sigma")))
    s = g.groupBy(*keys, "phase", "n").agg(F.sum(F.col("w") * F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("w") * F.col("f") * F.col("value")).alias("fv"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("vv"))
    s = s.where("ff > 0").withColumn("k0", F.col("fv") / F.col("ff")).withColumn("sse", F.col("vv") - F.col("fv") * F.col("k0"))
    return s.groupBy(*keys, "phase").agg(F.min_by(F.struct("n", "k0", "sse"), F.struct(F.round("sse", 8), "n")).alias("b")).select(*keys, "phase", "b.*")


def anchor(points: DataFrame, keys: list[str]) -> DataFrame:
    """The points with one at base 0 for each key and phase, value 0, as tight as the tightest of the others."""
    a = points.groupBy(*keys, "phase").agg(F.min("sigma").alias("sigma")).withColumns({"base": F.lit(0.0), "value": F.lit(0.0)})
    return points.select(*keys, "phase", "base", "value", "sigma").unionByName(a.select(*keys, "phase", "base", "value", "sigma"))
