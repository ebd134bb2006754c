"""GeoTIFF as a data source: read by blocks with a window pushed down, written by tasks as tiles that a commit publishes.

Files are opened where a task runs, so they must lie in a folder that all machines see as a path, such as a mounted
store. Rasters in stores that only Spark's own readers reach are read by rasters.read_raster, a file in a task.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rillwork.sources import rasters

#: Pixels that a partition reads, about.
PIXELS = 4_000_000


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(path: str) -> list[str]:
    at = Path(_local(path))
    return sorted(str(p) for p in at.glob("*.tif*")) if at.is_dir() else [str(at)]


class _Open:
    """A file as bytes that are read only where they are looked at."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115 - closed with the map
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def __enter__(self) -> mmap.mmap:
        return self.data

    def __exit__(self, *_) -> None:
        self.data.close()
        self.file.close()


@dataclass
class Blocks(InputPartition):
    """Blocks first to last (not included) of a file that touch the window."""

    path: str
    blocks: list[int]
    window: dict[str, tuple[int, int]]

    def __post_init__(self):
        super().__init__(None)


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, pixels: int):
        self.path, self.pixels = path, pixels
        self.window = {"r": (0, 2**31 - 1), "c": (0, 2**31 - 1)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of r and c with whole numbers narrow the window; all others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in self.window or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            low, high = self.window[column]
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = min(high, f.value - isinstance(f, LessThan))
            else:
                yield f
                continue
            self.window[column] = (low, high)

    def partitions(self) -> list[Blocks]:
        """Only the files' directories are read here, no pixel."""
        out = []
        (r0, r1), (c0, c1) = self.window["r"], self.window["c"]
        for path in _files(self.path):
            with _Open(path) as data:
                layout = rasters.layout(data)
            step = max(1, self.pixels // max(1, layout.block_rows * layout.block_cols))
            own = [k for k in range(layout.count) if layout.top(k) <= r1 and layout.top(k) + layout.block_rows > r0 and layout.left(k) <= c1 and layout.left(k) + layout.block_cols > c0]
            out += [Blocks(path, own[i : i + step], self.window) for i in range(0, len(own), step)]
        return out or [Blocks("", [], self.window)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        (r0, r1), (c0, c1) = partition.window["r"], partition.window["c"]
        with _Open(partition.path) as data:
            meta, layout = rasters.describe(data), rasters.layout(data)
            for k in partition.blocks:
                values = layout.block(data, k)
                r, c = np.mgrid[layout.top(k) : layout.top(k) + values.shape[0], layout.left(k) : layout.left(k) + values.shape[1]]
                own = ((r >= r0) & (r <= r1) & (c >= c0) & (c <= c1)).ravel()
                v, r, c = values.ravel()[own].astype(np.float64), r.ravel()[own].astype(np.int32), c.ravel()[own].astype(np.int32)
                none = np.isnan(v) if meta["nodata"] is None else np.isnan(v) | np.isclose(v, meta["nodata"])
                x, y = meta["x0"] + (c + 0.5) * meta["cell_w"], meta["y0"] - (r + 0.5) * meta["cell_h"]
                columns = [pa.array([partition.path] * len(v), pa.string()), pa.array(r), pa.array(c), pa.array(x), pa.array(y), pa.array(v, mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "r", "c", "x", "y", "v"])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class TileWriter(DataSourceWriter):
    """Each task writes its tiles to a folder of its own beside the others; the commit moves whole files only."""

    def __init__(self, path: str, name: str):
        self.path, self.name = _local(path), name

    def write(self, rows) -> Written:
        own = os.path.join(self.path, f".part-{uuid.uuid4().hex}")
        os.makedirs(own)
        files = []
        for row in rows:
            files.append(f"{self.name}_{row['tr']}_{row['tc']}.tif")
            with open(os.path.join(own, files[-1]), "wb") as f:
                f.write(row["content"])
        return Written(own, files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for f in m.files:
                os.replace(os.path.join(m.folder, f), os.path.join(self.path, f))
            os.rmdir(m.folder)

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for f in m.files:
                os.remove(os.path.join(m.folder, f))
            os.rmdir(m.folder)


class GeoTiffSource(DataSource):
    """format("geotiff"): cell(path, r, c, x, y, v) of the first band; v is null for nodata. Written from (tr, tc, content)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, r int, c int, x double, y double, v double"

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("pixels", PIXELS)))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"], self.options.get("name", "tile"))


def read(spark: SparkSession, path: str, pixels: int = PIXELS) -> DataFrame:
    """The first band of a file, or of the .tif files of a folder, ``pixels`` of them or one block in a partition.

    Filters on r and c that compare with numbers choose the blocks that are read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").option("pixels", pixels).load(path)


def save(cells: DataFrame, value: str, folder: str, name: str, cell: float, x0: float, y0: float, tile: int = 1024, nodata: float = -9999.0, epsg: int | None = None, note: str = "") -> None:
    """Writes a raster of cells (r, c, value) as files <name>_<tr>_<tc>.tif, all of them in tasks; files of these names are replaced.

    Nothing of a write that fails is published. A null value is nodata; no cell gives no file.
    """
    spark = cells.sparkSession
    spark.dataSource.register(GeoTiffSource)
    tiles = rasters.as_geotiffs(cells, value, cell, x0, y0, tile, nodata, epsg, note)
    tiles.write.format("geotiff").option("name", name).mode("append").save(folder)
