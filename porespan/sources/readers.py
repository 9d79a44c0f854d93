"""Readers: scan discovery, label volumes, provenance headers, reference tables and solver results."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from typing import NamedTuple
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Voxel types of volume headers.
DTYPES = {"byte": "u1", "uchar": "u1", "char": "i1", "short": "i2", "ushort": "u2", "int": "i4", "float": "f4", "double": "f8"}
_NUMBER = r"([-0-9.Ee+]+)"
#: How headers of label volumes state their bounds and size, here and in ``volume_head``.
BOX = r"BoundingBox\s+" + r"\s+".join([_NUMBER] * 6)
LATTICE = r"(?i)define\s+Lattice\s+(\d+)\s+(\d+)\s+(\d+)"
HEADER_BYTES = 2_000_000


def scan_order(files: DataFrame) -> DataFrame:
    """``(name, scan_index)``: by two leading integers as numbers, names without them last, in code-point order."""
    name = F.col("name")
    a, b = F.regexp_extract(name, r"^(\d+)_(\d+)", 1), F.regexp_extract(name, r"^(\d+)_(\d+)", 2)
    w = Window.orderBy((a == "").cast("int"), a.try_cast("long"), b.try_cast("long"), name)  # the files of one run: tens
    return files.select("name", (F.row_number().over(w) - 1).alias("scan_index"))


def discover_scans(spark: SparkSession, folder: str, pattern: str = "*.am") -> DataFrame:
    """Scan files of a folder in order; an error if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    out = files.join(scan_order(files), "name")
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return out


def header_dtype(header: Column) -> Column:
    token = F.lower(F.regexp_extract(header, r"(?i)Lattice\s*\{\s*(\w+)\s+Data", 1))
    return F.when(token == "", "byte").otherwise(token)


def header_codec(header: Column) -> Column:
    return F.when(header.rlike("(?i)HxZip"), "hxzip").when(header.rlike("(?i)ByteRLE"), "byterle").otherwise("raw")


def _edges(header: Column, which: str) -> Column:
    every = [F.regexp_extract_all(header, F.lit(BOX), F.lit(i)) for i in range(1, 7)]
    take = (lambda a: F.element_at(a, -1)) if which == "last" else (lambda a: F.get(a, F.lit(0)))
    return F.when(F.size(every[0]) > 0, F.array(*[take(a).try_cast("double") for a in every]))


def header_spacing(header: Column, nz: Column, ny: Column, nx: Column) -> Column:
    """(dz, dy, dx) of the last bounding box: extent over n - 1, the extent itself where n is 1; null without a box."""
    e = _edges(header, "last")
    step = lambda lo, hi, n: F.when(n > 1, (e[hi] - e[lo]) / (n - 1)).otherwise(e[hi] - e[lo])
    return F.when(e.isNotNull(), F.struct(step(4, 5, nz).alias("dz"), step(2, 3, ny).alias("dy"), step(0, 1, nx).alias("dx")))


def lattice_box(header: Column) -> Column:
    """Lattice (nz, ny, nx) and first bounding box; voxel size null where a side has fewer than two voxels."""
    n = [F.nullif(F.regexp_extract(header, LATTICE, i), F.lit("")).cast("int") for i in (3, 2, 1)]
    e = _edges(header, "first")
    size = lambda k, lo: F.when(n[k] > 1, (e[lo + 1] - e[lo]) / (n[k] - 1))
    return F.struct(n[0].alias("nz"), n[1].alias("ny"), n[2].alias("nx"), e.alias("box"), size(0, 4).alias("dz"), size(1, 2).alias("dy"), size(2, 0).alias("dx"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """First part of each file as text, for the header functions."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("scan_file"), F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1").alias("header"))


def history(header_rows: DataFrame) -> DataFrame:
    """Processing steps of headers(scan_file, header): step_order from 1, module, label, version, date, parameters."""
    uid = r"UID:[0-9a-fA-F-]{36}\s*\{"
    blocks = header_rows.select("scan_file", F.posexplode(F.split("header", uid)).alias("at", "block")).withColumn("module", F.regexp_extract("block", r"Module:([A-Za-z0-9_\-]+)\s*\{", 1)).where("module <> ''")
    order = F.row_number().over(Window.partitionBy("scan_file").orderBy("at"))
    first = lambda field: F.nullif(F.regexp_extract("block", field + r'\s+"([^"]*)"', 1), F.lit(""))
    names, values = (F.regexp_extract_all("block", F.lit(r'Parameter:([A-Za-z0-9_]+)\s+"([^"]*)"'), F.lit(i)) for i in (1, 2))
    last = F.aggregate(F.arrays_zip(names.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return blocks.select("scan_file", order.alias("step_order"), "module", first("Label").alias("label"), first("Version").alias("version"), first("Date").alias("step_date"), last.alias("parameters"))


def decode_payload(codec: str, data: bytes, size: int) -> bytes:
    """Bytes of a payload. hxzip is a zlib stream; byterle has pairs (count, value), or with bit 7 of the count set that many
    literal bytes."""
    if codec == "raw":
        return data[:size]
    if codec == "hxzip":
        import zlib

        return zlib.decompressobj().decompress(data)[:size]
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n & 0x80:
            out += data[i + 1 : i + 1 + (n & 0x7F)]
            i += 1 + (n & 0x7F)
        else:
            out += data[i + 1 : i + 2] * n
            i += 2
    return bytes(out[:size])


class Head(NamedTuple):
    """What a label volume's header says: its size, the type and coding of its voxels, and where they begin."""

    nz: int
    ny: int
    nx: int
    kind: np.dtype
    codec: str
    start: int


def volume_head(data: bytes, name: str) -> Head:
    head = data[:HEADER_BYTES].decode("latin-1")
    nx, ny, nz = map(int, re.search(LATTICE, head).groups())
    token = (re.search(r"(?i)Lattice\s*\{\s*(\w+)\s+Data", head) or [None, "byte"])[1].lower()
    if token not in DTYPES:
        raise ValueError(f"unsupported voxel type {token!r} in {name}")
    codec = "hxzip" if re.search("(?i)HxZip", head) else "byterle" if re.search("(?i)ByteRLE", head) else "raw"
    return Head(nz, ny, nx, np.dtype(DTYPES[token]), codec, re.search(rb"\n@1\r?\n", data).end())


def labels_of(raw: bytes, head: Head, name: str) -> np.ndarray:
    """Slices of one byte a voxel; an error where a label isn't an integer from 0 to 255."""
    vol = np.frombuffer(raw, dtype=head.kind).reshape(-1, head.ny, head.nx)
    if head.kind.kind == "f" or vol.min(initial=0) < 0 or vol.max(initial=0) > 255:
        raise TypeError(f"labels of {name} are no integers from 0 to 255")
    return vol.astype(np.uint8)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """slices(name, z, ny, nx, labels) of headed label volumes in any store that Spark reads; one task a file, as compressed payloads
    are sequential. Larger files than an array holds, and slice ranges of files that aren't compressed: ``LabelVolume``."""
    schema = "name string, z int, ny int, nx int, labels binary"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["name"], b["content"], strict=True):
                h = volume_head(data, name)
                vol = labels_of(decode_payload(h.codec, data[h.start :], h.nz * h.ny * h.nx * h.kind.itemsize), h, name)
                for z in range(h.nz):
                    yield pd.DataFrame({"name": [name], "z": [z], "ny": [h.ny], "nx": [h.nx], "labels": [vol[z].tobytes()]})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(parse, schema)


class LabelVolume(DataSource):
    """A headed label volume by slice ranges: ``format("labelvolume").option("path", ..)``, optionally ``z0`` and ``z1`` (half-open).

    Where the payload isn't compressed, ``depth`` slices (64 by default) make a partition, read by seek, and slices outside the range
    aren't read. A compressed payload is one partition. The path must be one that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "labelvolume"

    def schema(self) -> str:
        return "name string, z int, ny int, nx int, labels binary"

    def reader(self, schema) -> DataSourceReader:
        return _LabelReader({k.lower(): v for k, v in self.options.items()})


class _LabelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.name = self.path.rsplit("/", 1)[-1]
        with open(self.path, "rb") as f:
            self.head = volume_head(f.read(HEADER_BYTES), self.name)
        self.low, self.high = max(0, int(options.get("z0", 0))), min(self.head.nz, int(options.get("z1", self.head.nz)))
        self.depth = int(options.get("depth", 64))

    def partitions(self) -> list[InputPartition]:
        step = self.depth if self.head.codec == "raw" else self.head.nz
        return [InputPartition((z, min(z + step, self.high))) for z in range(self.low, self.high, max(1, step))]

    def read(self, partition: InputPartition):
        h, (low, high) = self.head, partition.value
        plane = h.ny * h.nx * h.kind.itemsize
        with open(self.path, "rb") as f:
            if h.codec == "raw":
                f.seek(h.start + low * plane)
                raw = f.read((high - low) * plane)
            else:
                f.seek(h.start)
                raw = decode_payload(h.codec, f.read(), h.nz * plane)[low * plane : high * plane]
        for z, labels in zip(range(low, high), labels_of(raw, h, self.name), strict=True):
            yield self.name, z, h.ny, h.nx, labels.tobytes()


class RawVolume(DataSource):
    """Headerless volumes: ``format("rawvolume").option("path", ..).option("ny", ..).option("nx", ..)``.

    The depth follows from the size, which has to be whole; ``depth`` slices (64 by default) make a partition, read by seek.
    The path must be one that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return "scan_index int, z int, ny int, nx int, labels binary"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader({k.lower(): v for k, v in self.options.items()})


class _RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ny, self.nx = options["path"].removeprefix("file://"), int(options["ny"]), int(options["nx"])
        self.scan, self.depth = int(options.get("scan_index", 0)), int(options.get("depth", 64))

    def partitions(self) -> list[InputPartition]:
        import os

        nz, rest = divmod(os.path.getsize(self.path), self.ny * self.nx)
        if rest:
            raise ValueError(f"{self.path} has no whole number of {self.ny} x {self.nx} slices")
        return [InputPartition((z, min(z + self.depth, nz))) for z in range(0, nz, self.depth)]

    def read(self, partition: InputPartition):
        low, high = partition.value
        with open(self.path, "rb") as f:
            f.seek(low * self.ny * self.nx)
            for z in range(low, high):
                yield self.scan, z, self.ny, self.nx, f.read(self.ny * self.nx)


def raw_volumes(spark: SparkSession, path: str, ny: int, nx: int, itemsize: int = 1) -> DataFrame:
    """Headerless files by any store that Spark reads: name, nz, and the bytes; an error where the size isn't whole."""
    b = spark.read.format("binaryFile").load(path)
    plane = itemsize * ny * nx
    nz = F.when(F.col("length") % plane == 0, F.expr(f"length DIV {plane}")).otherwise(F.raise_error(F.concat(F.lit("size isn't whole: "), F.col("path"))).cast("long"))
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), nz.cast("int").alias("nz"), F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), "content")


def raw_slices(volumes: DataFrame) -> DataFrame:
    """slices(name, z, ny, nx, labels) of raw_volumes' one-byte files; a file's bytes are cut where they are, not copied with each
    slice."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, nz, ny, nx, content in b.itertuples(index=False):
                plane = ny * nx
                for z in range(0, nz, 64):
                    some = range(z, min(z + 64, nz))
                    yield pd.DataFrame({"name": name, "z": some, "ny": ny, "nx": nx, "labels": [bytes(content[i * plane : (i + 1) * plane]) for i in some]})

    return volumes.select("name", "nz", "ny", "nx", "content").mapInPandas(cut, "name string, z int, ny int, nx int, labels binary")


def saturation_reference(spark: SparkSession, path: str, name_col: int = 0, sg_col: int = 4, time_col: int = 7) -> DataFrame:
    """Valid rows (row_number, name, sg, elapsed_minutes) of a CSV or workbook: a name with a numeric prefix, 0 <= sg <= 1,
    minutes >= 0 and no time of day."""
    from ..functions.names import scan_prefix

    rows = workbook(spark, path) if re.search(r"\.(xlsx|xlsm)$", path, re.I) else text_table(spark, path)
    cell = lambda i: F.get("cells", F.lit(i))
    r = rows.select("row_number", cell(name_col).alias("name"), cell(sg_col).try_cast("double").alias("sg"), cell(time_col).try_cast("double").alias("elapsed_minutes"))
    return r.where("trim(name) <> '' AND sg BETWEEN 0 AND 1 AND NOT isnan(sg) AND elapsed_minutes >= 0 AND NOT isnan(elapsed_minutes)").where(scan_prefix(F.col("name")) != "")


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, cells) of a CSV file without a header; a byte order mark is taken off."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("row_number", "line")).where("line <> ''")
    fields = F.regexp_extract_all("line", F.lit(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'), F.lit(0))
    clean = F.transform(fields, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^,", ""), '^"|"$', ""), '""', '"'))
    return lines.select("row_number", clean.alias("cells"))


def workbook(spark: SparkSession, path: str, sheet: int | str = 1) -> DataFrame:
    """(row_number, cells) of a workbook's sheet, by its number or its name, read with the standard library. A workbook without a
    sheet of that name has no rows."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def part(z: zipfile.ZipFile) -> str | None:
        """The file in the workbook that holds the sheet: names lead to relations, and these to files."""
        if isinstance(sheet, int):
            return f"xl/worksheets/sheet{sheet}.xml"
        key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        ids = [s.get(key) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet") if s.get("name") == sheet]
        files = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        return f"xl/{files[ids[0]].removeprefix('/xl/')}" if ids else None

    def column(ref: str) -> int:
        n = 0
        for ch in re.match("[A-Z]+", ref)[0]:
            n = n * 26 + ord(ch) - 64
        return n - 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(BytesIO(data)) as z:
                    names = z.namelist()
                    shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
                    rows, file = [], part(z)
                    for row in ElementTree.fromstring(z.read(file)).iter(f"{{{ns['m']}}}row") if file else ():
                        cells: list[str | None] = []
                        for c in row.findall("m:c", ns):
                            at, v = column(c.get("r")), c.find("m:v", ns)
                            cells += [None] * (at + 1 - len(cells))
                            inline = c.find("m:is", ns)
                            cells[at] = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
                        rows.append((int(row.get("r")), cells))
                yield pd.DataFrame(rows, columns=["row_number", "cells"]).astype({"row_number": "int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row_number int, cells array<string>")


#: The baseline workbook's sheet, the row from which its points begin, and the columns of its curve's parameters there.
BASELINE_SHEET, BASELINE_ROW = "Complete tables", 5
BASELINE_CURVE = {"swc": 55, "snr": 56, "krw0": 57, "krn0": 58, "nw": 59, "nn": 60}


def _baseline(spark: SparkSession, path: str) -> DataFrame:
    return workbook(spark, path, BASELINE_SHEET) if re.search(r"\.(xlsx|xlsm)$", path, re.I) else text_table(spark, path)


def _number(column: int) -> Column:
    """A cell of a row as a number, null where it is none; columns count from 1."""
    return F.get("cells", F.lit(column - 1)).try_cast("double")


def baseline_points(spark: SparkSession, path: str, first_row: int = BASELINE_ROW) -> DataFrame:
    """Published points of the baseline workbook, from ``first_row`` on, both readings of the saturation kept."""
    n = _number
    r = _baseline(spark, path).where(F.col("row_number") >= first_row).select(F.get("cells", F.lit(2)).alias("section"), n(4).cast("int").alias("scan"), n(5).alias("k_abs_md"), n(11).alias("kr_gas"), n(12).alias("kr_brine"), (1 - n(13)).alias("sw_a"), n(14).alias("sw_b"))
    return r.where("scan IS NOT NULL AND scan <> 0")


def baseline_kabs(spark: SparkSession, path: str, first_row: int = BASELINE_ROW) -> DataFrame:
    """Absolute permeabilities (mD) of the baseline workbook, whatever their scan."""
    return _baseline(spark, path).where(F.col("row_number") >= first_row).select("row_number", _number(5).alias("k_abs_md")).where("k_abs_md IS NOT NULL")


def baseline_curve(spark: SparkSession, path: str, row: int = BASELINE_ROW) -> DataFrame:
    """The published parameters of the modified curve: one row, or none where one of them is missing."""
    r = _baseline(spark, path).where(F.col("row_number") == row).select(*[_number(c).alias(n) for n, c in BASELINE_CURVE.items()])
    return r.dropna()


SUMMARY = "raw_path string, nx int, ny int, nz int, voxel_m double, permeability_z_m2 double, stopping_criteria_flag string, reached_error_bound_z double, geodict_version string, result_txt string"


def solver_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Result summaries (JSON) below a folder; broken files give a row of nulls."""
    return spark.read.schema(SUMMARY).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def solver_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files below a folder, which executors list: ``(file, value)``. ``solver_values`` and ``solver_log`` take such frames too, so
    that files from which both are wanted are read once."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def solver_values(spark: SparkSession, path: str | DataFrame, keys: list[str]) -> DataFrame:
    """Last value of each key in white-space separated key/value lines, by file."""
    texts = solver_texts(spark, path) if isinstance(path, str) else path
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    kv = lines.select("file", "n", F.lower(F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)", 1)).alias("key"), F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)", 2).alias("value"))
    return kv.where(F.col("key").isin([k.lower() for k in keys])).groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


def solver_log(spark: SparkSession, path: str | DataFrame, pattern: str = r"(?i)permeability\s*=\s*([-+0-9.eE]+)") -> DataFrame:
    """Last positive match of ``pattern`` in each log."""
    texts = solver_texts(spark, path) if isinstance(path, str) else path
    logs = texts.select("file", F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("v"))
    last = F.aggregate("v", F.lit(None).cast("double"), lambda found, x: F.when(x.try_cast("double") > 0, x.try_cast("double")).otherwise(found))
    return logs.select("file", last.alias("value")).where("value IS NOT NULL")


def tables_with_run_id(spark: SparkSession, database: str) -> list[str]:
    """Catalogue tables that have a run_id column."""
    found = [t.name for t in spark.catalog.listTables(database)]
    return sorted(t for t in found if any(c.name == "run_id" for c in spark.catalog.listColumns(t, database)))


def discover_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domain files below a folder by (connectivity folder, track, scan), with a map from kind to path."""
    from ..functions.names import parse_domain

    f = spark.read.format("binaryFile").option("pathGlobFilter", "domain_*.raw").option("recursiveFileLookup", True).load(folder).select("path")
    p = f.withColumn("parts", F.split("path", "/")).withColumn("p", parse_domain(F.element_at("parts", -1))).where("p IS NOT NULL")
    return p.groupBy(F.element_at("parts", -2).alias("folder"), F.col("p.track").alias("track"), F.col("p.scan").alias("scan")).agg(F.map_from_entries(F.collect_list(F.struct("p.kind", "path"))).alias("paths"))


def path_tails(path: Column) -> Column:
    """All tails of a path, lower-cased, with the number of their parts; backslashes part as slashes do."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, -n, n), "/").alias("tail")))


def resolve_paths(stored: DataFrame, files: DataFrame, parts: int = 2) -> DataFrame:
    """The file that each of stored(path) names: the one of files(path) that agrees with it in most parts from the end, ``parts`` or
    more: ``(stored, found, agreed, n_found)``. Several files that agree as far are reported by their number, and the least is
    taken; ``found`` is null without any.

    Files with one tail fold to a row before the join, so a name that many folders have doesn't multiply."""
    some = lambda df: df.select("path", F.explode(path_tails(F.col("path"))).alias("t")).where(F.col("t.n") >= parts).select("path", "t.*")
    held = some(files.distinct()).groupBy("tail").agg(F.min("path").alias("found"), F.count("*").alias("n_found"))
    met = some(stored.select("path").distinct()).join(held, "tail").groupBy(F.col("path").alias("_path")).agg(F.max_by(F.struct("found", F.col("n").alias("agreed"), "n_found"), "n").alias("m"))
    return stored.join(met, F.col("path") == F.col("_path"), "left").select(F.col("path").alias("stored"), "m.found", "m.agreed", F.coalesce("m.n_found", F.lit(0)).alias("n_found"))
