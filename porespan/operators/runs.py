"""Run-length form of label volumes: rows (scan_index, z, y, x0, x1, label), both ends inclusive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = "scan_index int, z int, y int, x0 int, x1 int, label int"
ROW = ["scan_index", "z", "y"]


def length() -> Column:
    return (F.col("x1") - F.col("x0") + 1).cast("long")


def runs_from_voxels(voxels: DataFrame, keep_rock: bool = False) -> DataFrame:
    """Encode voxel rows by gaps and islands: x less its rank among equal labels is constant along a run."""
    rank = F.row_number().over(Window.partitionBy(*ROW, "label").orderBy("x"))
    v = voxels if keep_rock else voxels.where("label <> 0")
    return v.withColumn("_g", F.col("x") - rank).groupBy(*ROW, "label", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*ROW, "x0", "x1", "label")


def runs_from_slices(slices: DataFrame, keep_rock: bool = False) -> DataFrame:
    """Encode slices(scan_index, z, ny, nx, labels) of one byte a voxel, slice by slice; nothing is shuffled."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, z, ny, nx, data in b[["scan_index", "z", "ny", "nx", "labels"]].itertuples(index=False):
                a = np.frombuffer(data, dtype=np.uint8).reshape(ny, nx)
                start = np.ones((ny, nx), dtype=bool)
                start[:, 1:] = a[:, 1:] != a[:, :-1]
                y, x0 = np.nonzero(start)
                flat = np.flatnonzero(start)
                x1 = np.minimum(np.append(flat[1:], ny * nx) - 1 - y * nx, nx - 1)
                label = a[y, x0]
                ok = slice(None) if keep_rock else label != 0
                yield pd.DataFrame({"scan_index": scan, "z": z, "y": y[ok], "x0": x0[ok], "x1": x1[ok], "label": label[ok].astype(np.int32)})

    return slices.select("scan_index", "z", "ny", "nx", "labels").mapInPandas(encode, RUNS)


def slices_from_runs(runs: DataFrame, nz: int, ny: int, nx: int) -> DataFrame:
    """Back to slices of one byte a voxel; slices without runs are missing. One slice's runs make one row."""
    packed = runs.where(F.col("z").between(0, nz - 1)).groupBy("scan_index", "z").agg(F.collect_list(F.struct("y", "x0", "x1", "label")).alias("r"))

    @F.pandas_udf("binary")
    def paint(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            a = np.zeros((ny, nx), dtype=np.uint8)
            for x in r:
                a[x["y"], x["x0"] : x["x1"] + 1] = x["label"]
            out.append(a.tobytes())
        return pd.Series(out)

    return packed.select("scan_index", "z", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), paint("r").alias("labels"))


def voxels_from_runs(runs: DataFrame) -> DataFrame:
    return runs.select(*ROW, F.explode(F.sequence("x0", "x1")).alias("x"), "label").select(*ROW, "x", "label")


def clip(runs: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """Runs cut to boxes(.., z0, z1, y0, y1, x0, x1), half-open; ``on`` are the keys that both share.

    The box table's other columns come along. The join is on the keys and the z planes of a box, so it stays an equi-join
    whatever the number of boxes."""
    b = boxes.withColumnsRenamed({"x0": "bx0", "x1": "bx1"}).withColumn("z", F.explode(F.sequence("z0", F.col("z1") - 1)))
    out = runs.join(b, [*on, "z"]).where("y >= y0 AND y < y1 AND x0 < bx1 AND x1 >= bx0")
    return out.withColumns({"x0": F.greatest("x0", "bx0"), "x1": F.least(F.col("x1"), F.col("bx1") - 1)})
