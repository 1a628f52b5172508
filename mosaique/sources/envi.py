"""ENVI rasters (a raw file beside a text header) as a Spark data source.

``spark.dataSource.register(EnviSource)``, then
``spark.read.format("envi").load(path)`` gives row, col, b1.. with the header's
ignore value as NULL. A partition is a run of lines; only its bytes are read.
Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mosaique.sources.raster import RasterError, meta_of

# The format's codes of data types.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
#: Pixels of a partition, about.
PIXELS = 4_000_000


def _open(path: str):
    if re.match(r"\w+://", path):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def parse_header(text: str) -> dict[str, str]:
    """Names and values; a value in braces may span lines."""
    if not text.lstrip().startswith("ENVI"):
        raise RasterError("not an ENVI header")
    return {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}


class Layout:
    def __init__(self, header: dict[str, str]):
        self.samples, self.lines, self.bands = (int(header[k]) for k in ("samples", "lines", "bands"))
        self.interleave = header.get("interleave", "bsq").lower()
        self.offset = int(header.get("header offset", 0))
        order = ">" if header.get("byte order", "0") == "1" else "<"
        code = int(header["data type"])
        if code not in TYPES:
            raise RasterError(f"data type {code} is not supported")
        self.dtype = np.dtype(order + TYPES[code])
        ignore = header.get("data ignore value")
        self.ignore = float(ignore) if ignore else None

    @property
    def band_type(self) -> str:
        return "double" if self.dtype.kind == "f" else "bigint"

    def read(self, f, first: int, count: int) -> np.ndarray:
        """Lines as an array of (bands, count, samples)."""
        size, n = self.dtype.itemsize, self.samples

        def part(at: int, items: int) -> np.ndarray:
            f.seek(self.offset + at * size)
            return np.frombuffer(f.read(items * size), self.dtype)

        if self.interleave == "bsq":
            return np.stack([part((b * self.lines + first) * n, count * n).reshape(count, n) for b in range(self.bands)])
        raw = part(first * n * self.bands, count * n * self.bands)
        if self.interleave == "bil":
            return raw.reshape(count, self.bands, n).transpose(1, 0, 2)
        return raw.reshape(count, n, self.bands).transpose(2, 0, 1)


class Lines(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class EnviReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout

    def partitions(self) -> Sequence[Lines]:
        step = max(1, PIXELS // max(1, self.layout.samples))
        return [Lines(i, min(step, self.layout.lines - i)) for i in range(0, self.layout.lines, step)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        own = self.layout
        with _open(self.path) as f:
            data = own.read(f, partition.first, partition.count)
        rows, cols = np.mgrid[partition.first : partition.first + partition.count, : own.samples].astype(np.int32)
        columns = [pa.array(rows.ravel()), pa.array(cols.ravel())]
        kind = pa.float64() if own.band_type == "double" else pa.int64()
        for band in data:
            v = band.ravel()
            null = v == own.ignore if own.ignore is not None else None
            columns.append(pa.array(v.astype(v.dtype.newbyteorder("=")), mask=null).cast(kind))
        yield pa.RecordBatch.from_arrays(columns, ["row", "col", *(f"b{i}" for i in range(1, own.bands + 1))])


class EnviSource(DataSource):
    """Options: ``path`` of the raw file, ``header`` (its path with .hdr unless given)."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def _layout(self) -> Layout:
        path = self.options["path"]
        header = self.options.get("header") or re.sub(r"(\.\w+)?$", ".hdr", path, count=1)
        with _open(header) as f:
            return Layout(parse_header(f.read().decode("latin-1")))

    def schema(self) -> str:
        own = self._layout()
        return "row int, col int, " + ", ".join(f"b{i} {own.band_type}" for i in range(1, own.bands + 1))

    def reader(self, schema) -> EnviReader:
        return EnviReader(self.options["path"], self._layout())


def meta(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """Size, no-data value and, where the header has map info, transform and projection of a file."""
    with _open(header or re.sub(r"(\.\w+)?$", ".hdr", path, count=1)) as f:
        fields = parse_header(f.read().decode("latin-1"))
    own = Layout(fields)
    gt = None
    if "map info" in fields:
        info = [x.strip() for x in fields["map info"].strip("{} ").split(",")]
        col, row, x, y, dx, dy = map(float, info[1:7])
        gt = [x - (col - 1) * dx, dx, 0.0, y + (row - 1) * dy, 0.0, -dy]
    nodata = [None if own.ignore is None else float(own.ignore)] * own.bands
    return meta_of(spark, own.samples, own.lines, fields.get("coordinate system string", "").strip("{} "), gt, nodata)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EnviSource)
