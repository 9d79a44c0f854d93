"""Names and small scalar functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import M2_PER_DARCY, VOXEL_EDGE

#: Fixed value: how domain files are named.
DOMAIN = r"(?i)^domain_(absolute|gas|water)_(\d+)-(.+?)_([0-9.]+)um_(\d+b[us])_(\d+)x(\d+)x(\d+)\.raw$"


def scan_prefix(name: Column, whole: bool = False) -> Column:
    """Numeric prefix of a file name, '8_2' of '8_2_sub'; '' where there is none, or with ``whole`` the name itself."""
    got = F.regexp_extract(name, r"^([0-9]+(?:_[0-9]+)*)(?:_|$)", 1)
    return F.coalesce(F.nullif(got, F.lit("")), name) if whole else got


def general(value: Column, digits: int = 6) -> Column:
    """A positive number with ``digits`` significant digits and no trailing zeros (no exponent form: 1e-4 to 1e6)."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(value))).cast("int")
    fixed = F.coalesce(*[F.when(places == p, F.format_string(f"%.{p}f", value)) for p in range(digits + 4)])
    return F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)


def domain_name(kind: Column, track: Column, scan: Column, dx: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """File name of a solver domain; the voxel token is dx in micrometres, 5 where the spacing is unknown."""
    um = general(F.coalesce(dx * 1e6, F.lit(5.0)))
    return F.concat(F.lit("domain_"), kind, F.lit("_"), F.lpad(track.cast("string"), 2, "0"), F.lit("-"), scan.cast("string"), F.lit("_"), um, F.lit("um_8bu_"), F.concat_ws("x", nx.cast("string"), ny.cast("string"), nz.cast("string")), F.lit(".raw"))


def parse_domain(name: Column) -> Column:
    """Fields of a domain name as a struct; null where the name doesn't match. ``scan`` stays text."""
    g = lambda i: F.regexp_extract(name, DOMAIN, i)
    return F.when(
        name.rlike(DOMAIN),
        F.struct(F.lower(g(1)).alias("kind"), g(2).cast("int").alias("track"), g(3).alias("scan"), g(4).try_cast("double").alias("voxel_um"), g(5).alias("bits"), g(6).cast("int").alias("nx"), g(7).cast("int").alias("ny"), g(8).cast("int").alias("nz")),
    )


def int_list(text: Column) -> Column:
    """'1,2,5' or '0-7' as a sorted array of distinct integers; null (everything) for null, '' and 'all'."""
    flat = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))
    parts = F.filter(F.split(flat, ","), lambda p: p != "")

    def spread(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")
        return F.when(p.contains("-"), F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(a))

    return F.when(text.isNull() | flat.isin("", "all"), None).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread)))))


def file_index(name: Column) -> Column:
    """Second underscore-separated part as an integer; null where it is none."""
    return F.nullif(F.split_part(name, F.lit("_"), F.lit(2)), F.lit("")).try_cast("int")


def millidarcy(k: Column) -> Column:
    return k / M2_PER_DARCY * 1000


def darcy(k: Column) -> Column:
    return k / M2_PER_DARCY


def volume_mm3(voxels: Column, dz: Column, dy: Column, dx: Column) -> Column:
    return voxels * dz * dy * dx * 1e9


def voxel_edge(volume: Column, voxels: Column) -> Column:
    """Edge of a voxel in metres from a stored volume; the usual edge where that is not known."""
    return F.coalesce(F.cbrt(F.try_divide(F.nullif(volume, F.lit(0.0)) * 1e-9, voxels)), F.lit(VOXEL_EDGE))


def job_estimate(fluid: Column, slices: Column, cores: int = 4, iterations: int = 200_000, rate: float = 69.44e6) -> tuple[Column, Column]:
    """Upper bound of a solver job's minutes, and its memory in GB."""
    return fluid * iterations / (rate * cores) / 60, slices * 0.085


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour on."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def short_count(n: Column) -> Column:
    """A count in words of at most three digits: 950, 1.2K, 3.4M, 2.0B; halves go up."""
    return F.when(n >= 1e9, F.format_string("%.1fB", n / 1e9)).when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def sheet_name(name: str, used: set[str]) -> str:
    """A worksheet name: no more than 31 characters, none of ``[]:*?/\\``, unlike those used before whatever the case."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "sheet"
    out, n = base, 1
    while out.lower() in used:
        n += 1
        out = base[: 31 - len(f"_{n}")] + f"_{n}"
    used.add(out.lower())
    return out
