"""Writers: domains, cluster masks, versioned tables, sheets, CSV and LaTeX."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sheet_name


def domain_files(runs: DataFrame, boxes: DataFrame, kind: str) -> DataFrame:
    """(name, content) of the domain of each box and scan: one byte a voxel, 0 open, 1 blocked, slices in z order.

    ``boxes`` has track_id, name_of(scan) parts in ``stem``, and half-open bounds; a box's volume makes one row."""
    from ..operators.runs import clip

    inside = clip(runs, boxes, []).groupBy("track_id", "scan_index", "z0", "z1", "y0", "y1").agg(F.collect_list(F.struct("z", "y", "x0", "x1", "label", "bx0", "bx1")).alias("r"))

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        open_labels = {"absolute": (1, 2), "gas": (2,), "water": (1,)}[kind]
        for b in batches:
            out = []
            for t, s, z0, z1, y0, y1, r in b.itertuples(index=False):
                x0, x1 = r[0]["bx0"], r[0]["bx1"]
                a = np.ones((z1 - z0, y1 - y0, x1 - x0), dtype=np.uint8)
                for q in r:
                    if q["label"] in open_labels:
                        a[q["z"] - z0, q["y"] - y0, q["x0"] - x0 : q["x1"] + 1 - x0] = 0
                out.append((t, s, z1 - z0, y1 - y0, x1 - x0, a.tobytes()))
            yield pd.DataFrame(out, columns=["track_id", "scan_index", "nz", "ny", "nx", "content"])

    return inside.mapInPandas(paint, "track_id int, scan_index int, nz int, ny int, nx int, content binary")


def cluster_mask(clusters: DataFrame, ny: int, nx: int, nz: int, margin: int = 10) -> DataFrame:
    """(track_id, z0, z1, content): 1 in the cluster, over its z range and a margin, full y and x; z1 inclusive."""
    g = clusters.groupBy("track_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.collect_list(F.struct("z", "y", "x0", "x1")).alias("r"))
    g = g.select("track_id", F.greatest(F.lit(0), F.col("lo") - margin).alias("z0"), F.least(F.lit(nz - 1), F.col("hi") + margin).alias("z1"), "r")

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            out = []
            for t, z0, z1, r in b.itertuples(index=False):
                a = np.zeros((z1 - z0 + 1, ny, nx), dtype=np.uint8)
                for q in r:
                    a[q["z"] - z0, q["y"], q["x0"] : q["x1"] + 1] = 1
                out.append((t, z0, z1, a.tobytes()))
            yield pd.DataFrame(out, columns=["track_id", "z0", "z1", "content"])

    return g.mapInPandas(paint, "track_id int, z0 int, z1 int, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files of a folder that every executor can open; each is renamed when complete, so a
    repeated task replaces its own files."""

    def put(rows: Iterator) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r['name']}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, os.path.join(folder, r["name"]))

    files.select("name", "content").foreachPartition(put)


def save_version(df: DataFrame, folder: str) -> str:
    """Write a table as a new version directory; readers take the latest complete one. Nothing is overwritten in place."""
    path = f"{folder}/v={time.time_ns()}"
    df.write.parquet(path)
    return path


def load_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest complete version of a table."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no complete version in {folder}")
    return spark.read.parquet(max(done, key=lambda p: int(p.rpartition("v=")[2])))


def write_sheets(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV directory for each table, under names that a workbook would take; the names given."""
    used: set[str] = set()
    names = {t: sheet_name(t, used) for t in tables}
    for t, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{names[t]}")
    return names


def latex_rows(df: DataFrame, order: str, places: int = 3) -> DataFrame:
    """The body of a LaTeX table as one string: cells joined by &, rows ended by \\\\, numbers to ``places`` decimals."""
    cell = lambda c, kind: F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{places}f", F.col(c)) if kind == "double" else F.replace(F.col(c).cast("string"), F.lit("_"), F.lit(r"\_")))
    rows = df.select(F.col(order).alias("_o"), F.concat(F.concat_ws(" & ", *[cell(c, k) for c, k in df.dtypes]), F.lit(" \\\\")).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"]), "\n").alias("latex"))
