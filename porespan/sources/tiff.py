"""Multi-frame TIFF stacks as slices, by the published format (TIFF 6.0 and its 64-bit form); the first channel where there are several."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import Head, labels_of

SLICES = "name string, z int, ny int, nx int, labels binary"
#: Field types of the format as struct codes.
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q", 18: "Q"}
#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class Layout(NamedTuple):
    """Byte order, and whether offsets have 64 bits."""

    order: str
    wide: bool


def frames(f: BinaryIO) -> tuple[Layout, list[int]]:
    """The layout of a file and the places of its frames' directories, of which only the links are read."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    layout = Layout(order, version == 43)
    at = struct.unpack(order + ("Q" if layout.wide else "I"), head[8:16] if layout.wide else head[4:8])[0]
    out: list[int] = []
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories of the TIFF file form a circle")
        seen.add(at)
        out.append(at)
        f.seek(at)
        n = struct.unpack(order + ("Q" if layout.wide else "H"), f.read(8 if layout.wide else 2))[0]
        f.seek(n * (20 if layout.wide else 12), 1)
        at = struct.unpack(order + ("Q" if layout.wide else "I"), f.read(8 if layout.wide else 4))[0]
    return layout, out


def directory(f: BinaryIO, layout: Layout, at: int) -> dict[int, tuple]:
    """The integer fields of a frame's directory."""
    order, wide = layout
    entry, inline = ("HHQ", 8) if wide else ("HHI", 4)
    f.seek(at)
    n = struct.unpack(order + ("Q" if wide else "H"), f.read(8 if wide else 2))[0]
    rows, out = f.read(n * (20 if wide else 12)), {}
    for i in range(n):
        row = rows[i * (20 if wide else 12) :][: 20 if wide else 12]
        tag, kind, count = struct.unpack(order + entry, row[:-inline])
        if kind not in FIELD:
            continue
        size = struct.calcsize(order + FIELD[kind]) * count
        if size > inline:
            f.seek(struct.unpack(order + ("Q" if wide else "I"), row[-inline:])[0])
            data = f.read(size)
        else:
            data = row[-inline:][:size]
        out[tag] = struct.unpack(f"{order}{count}{FIELD[kind]}", data)
    return out


def unpack(data: bytes, compression: int) -> bytes:
    """The bytes of a strip."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        out, i = bytearray(), 0
        while i < len(data):
            n, i = data[i], i + 1
            if n < 128:
                out += data[i : i + n + 1]
                i += n + 1
            elif n > 128:
                out += data[i : i + 1] * (257 - n)
                i += 1
        return bytes(out)
    if compression == LZW:
        return _lzw(data)
    raise ValueError(f"unsupported TIFF compression {compression}")


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    out, table, before = bytearray(), [], b""
    bits = held = 0
    width = 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        width = 9 + sum(len(table) + 1 >= n for n in (512, 1024, 2048))
    return bytes(out)


def frame(f: BinaryIO, layout: Layout, at: int, name: str) -> tuple[int, int, bytes]:
    """Rows, columns and one-byte labels of the frame at a directory; an error where labels aren't integers from 0 to 255."""
    d = directory(f, layout, at)
    one = lambda tag, default: d.get(tag, (default,))[0]
    nx, ny, bits, samples = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1)
    if TILES in d or bits not in (1, 8, 16, 32) or one(FORMAT, 1) not in (1, 2) or (bits == 1 and samples > 1):
        raise ValueError(f"unsupported TIFF layout in {name}")
    apart = samples > 1 and one(PLANAR, 1) == 2
    width = 1 if apart else samples
    rows = min(one(ROWS, ny), ny)
    strips = list(zip(d[OFFSETS], d[COUNTS], strict=True))[: -(-ny // max(rows, 1))]  # planes apart: the first channel's
    kind = np.dtype(f"{layout.order}{'i' if one(FORMAT, 1) == 2 else 'u'}{max(bits, 8) // 8}")
    parts = []
    for i, (start, size) in enumerate(strips):
        f.seek(start)
        raw, high = unpack(f.read(size), one(COMPRESSION, NONE)), min(rows, ny - i * rows)
        if bits == 1:
            part = np.unpackbits(np.frombuffer(raw, np.uint8, high * -(-nx // 8)).reshape(high, -1), axis=1)[:, :nx, None]
        else:
            part = np.frombuffer(raw, kind, high * nx * width).reshape(high, nx, width)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"unsupported TIFF predictor in {name}")
        parts.append(part[..., 0])
    image = np.concatenate(parts) if parts else np.zeros((ny, nx), np.uint8)
    if one(PHOTOMETRIC, 1) == 0 and bits in (1, 8):  # 0 is white
        image = (1 if bits == 1 else 255) - image
    return ny, nx, labels_of(np.ascontiguousarray(image).tobytes(), Head(1, ny, nx, image.dtype, "raw", 0), name).tobytes()


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """slices(name, z, ny, nx, labels) of TIFF files in any store that Spark reads; one task a file. Larger files: ``TiffStack``."""
    files = spark.read.format("binaryFile").load(path)
    return stack_slices(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def stack_slices(files: DataFrame) -> DataFrame:
    """The slices of files(name, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["name"], b["content"], strict=True):
                f = BytesIO(data)
                layout, places = frames(f)
                for z, at in enumerate(places):
                    ny, nx, labels = frame(f, layout, at, name)
                    yield pd.DataFrame({"name": [name], "z": [z], "ny": [ny], "nx": [nx], "labels": [labels]})

    return files.mapInPandas(parse, SLICES)


def stack_info(files: DataFrame) -> DataFrame:
    """(name, n_frames, ny, nx) of files(name, content), without decoding a frame; sides are the first frame's."""

    def info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["name"], b["content"], strict=True):
                f = BytesIO(data)
                layout, places = frames(f)
                d = directory(f, layout, places[0]) if places else {}
                rows.append((name, len(places), d.get(HEIGHT, (0,))[0], d.get(WIDTH, (0,))[0]))
            yield pd.DataFrame(rows, columns=["name", "n_frames", "ny", "nx"])

    return files.mapInPandas(info, "name string, n_frames int, ny int, nx int")


class TiffStack(DataSource):
    """A stack by ranges of frames: ``format("tiffstack").option("path", ..)``, optionally ``z0`` and ``z1`` (half-open); ``depth``
    frames (64 by default) make a partition, read by seek. The path must be one that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "tiffstack"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> DataSourceReader:
        return _StackReader({k.lower(): v for k, v in self.options.items()})


class _StackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.depth = options["path"].removeprefix("file://"), int(options.get("depth", 64))
        with open(self.path, "rb") as f:
            self.layout, self.places = frames(f)
        self.low, self.high = max(0, int(options.get("z0", 0))), min(len(self.places), int(options.get("z1", len(self.places))))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((z, min(z + self.depth, self.high))) for z in range(self.low, self.high, self.depth)]

    def read(self, partition: InputPartition):
        low, high = partition.value
        name = self.path.rsplit("/", 1)[-1]
        with open(self.path, "rb") as f:
            for z in range(low, high):
                ny, nx, labels = frame(f, self.layout, self.places[z], name)
                yield name, z, ny, nx, labels


def stack_bytes(slices: list[np.ndarray], compression: int = NONE) -> bytes:
    """A little-endian TIFF file of one-byte slices, each one strip, as it is or deflated."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in slices:
        data = np.ascontiguousarray(a, np.uint8).tobytes()
        data = zlib.compress(data) if compression == DEFLATE else data
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        fields = ((WIDTH, a.shape[1]), (HEIGHT, a.shape[0]), (BITS, 8), (COMPRESSION, compression), (PHOTOMETRIC, 1), (OFFSETS, start), (SAMPLES, 1), (ROWS, a.shape[0]), (COUNTS, len(data)))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def stack_files(slices: DataFrame, key: str) -> DataFrame:
    """files(name, content): a deflated TIFF stack of each key's slices(key, z, ny, nx, labels), in z order; one volume makes one row."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("z")
        images = [np.frombuffer(r.labels, np.uint8).reshape(r.ny, r.nx) for r in p.itertuples()]
        return pd.DataFrame({"name": [str(p[key].iloc[0])], "content": [stack_bytes(images, DEFLATE)]})

    return slices.groupBy(key).applyInPandas(pack, "name string, content binary")
