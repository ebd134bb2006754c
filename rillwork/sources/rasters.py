"""GeoTIFF and ESRI ASCII grids as cells, and cells as GeoTIFF tiles. Files are read by Spark and decoded in tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "path string, width int, height int, cell_w double, cell_h double, x0 double, y0 double, nodata double, epsg int"
#: TIFF field types as (letter of struct, bytes), and sample formats.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
FORMATS = {1: "u", 2: "i", 3: "f"}


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        letter, size = TYPES.get(kind, ("B", 1))
        here = at + 10 + 12 * k
        start = here if n * size <= 4 else struct.unpack(order + "I", data[here : here + 4])[0]
        raw = data[start : start + n * size]
        out[tag] = (raw.split(b"\0")[0].decode("latin-1"),) if letter == "s" else struct.unpack(f"{order}{n}{letter}", raw)
    return order, out


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    table: list[bytes] = []
    out, bits, n, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _unpacked(raw: bytes, how: int) -> bytes:
    if how == 1:
        return raw
    if how in (8, 32946):
        return zlib.decompress(raw)
    if how == 5:
        return unlzw(raw)
    raise ValueError(f"TIFF compression {how} is not known")


def describe(data: bytes) -> dict:
    """Size, cell, origin (the top left corner), nodata and EPSG code of a GeoTIFF; no place gives cells of 1 from 0, 0."""
    _, f = _fields(data)
    scale, tie = f.get(33550, (1.0, 1.0, 0.0)), f.get(33922, (0.0,) * 6)
    keys = f.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    text = f.get(42113, ("",))[0].strip()
    return {"width": f[256][0], "height": f[257][0], "cell_w": float(scale[0]), "cell_h": float(scale[1]), "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1], "nodata": float(text) if text else None, "epsg": codes.get(3072) or codes.get(2048)}


@dataclass(frozen=True)
class Layout:
    """Where the blocks, strips or tiles, of the first band lie in the file and in the raster."""

    width: int
    height: int
    block_rows: int
    block_cols: int
    tiled: bool
    samples: int
    kind: str
    how: int
    predictor: int
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block_cols)

    @property
    def count(self) -> int:
        return self.across * -(-self.height // self.block_rows)

    def top(self, k: int) -> int:
        return k // self.across * self.block_rows

    def left(self, k: int) -> int:
        return k % self.across * self.block_cols

    def block(self, data: bytes, k: int) -> np.ndarray:
        """The values of a block, cut to the raster."""
        rows = self.block_rows if self.tiled else min(self.block_rows, self.height - self.top(k))
        kind = np.dtype(self.kind)
        raw = _unpacked(data[self.places[k] : self.places[k] + self.sizes[k]], self.how)
        out = np.frombuffer(raw, kind, rows * self.block_cols * self.samples).reshape(rows, self.block_cols, self.samples)
        if self.predictor == 2:
            out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
        elif self.predictor != 1:
            raise ValueError(f"TIFF predictor {self.predictor} is not known")
        return out[: self.height - self.top(k), : self.width - self.left(k), 0]


def layout(data: bytes) -> Layout:
    """Read from the file's directory alone. Strips or tiles, uncompressed, deflated or LZW, with or without a predictor for integers."""
    order, f = _fields(data)
    width, height, planar = f[256][0], f[257][0], f.get(284, (1,))[0]
    tiled = 322 in f
    w, h = (f[322][0], f[323][0]) if tiled else (width, min(height, f.get(278, (height,))[0]))
    places, sizes = (f[324], f[325]) if tiled else (f[273], f[279])
    kind = f"{order}{FORMATS[f.get(339, (1,))[0]]}{f[258][0] // 8}"
    return Layout(width, height, h, w, tiled, 1 if planar == 2 else f.get(277, (1,))[0], kind, f.get(259, (1,))[0], f.get(317, (1,))[0], places, sizes)


def band(data: bytes) -> np.ndarray:
    """The first band, as doubles."""
    at = layout(data)
    out = np.zeros((at.height, at.width))
    for k in range(at.count):
        part = at.block(data, k)
        out[at.top(k) : at.top(k) + part.shape[0], at.left(k) : at.left(k) + part.shape[1]] = part
    return out


def ascii_grid(text: str) -> tuple[dict, np.ndarray]:
    """An ESRI ASCII grid: its description and its values."""
    head, lines = {}, text.splitlines()
    while lines and lines[0].split() and lines[0].split()[0][0].isalpha():
        k, v = lines.pop(0).split()[:2]
        head[k.lower()] = float(v)
    rows, cols, cell = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    values = np.array(" ".join(lines).split(), float).reshape(rows, cols)
    shift = cell / 2 if "xllcenter" in head else 0.0
    x0, y0 = head.get("xllcorner", head.get("xllcenter", 0.0)) - shift, head.get("yllcorner", head.get("yllcenter", 0.0)) - shift
    return {"width": cols, "height": rows, "cell_w": cell, "cell_h": cell, "x0": x0, "y0": y0 + rows * cell, "nodata": head.get("nodata_value"), "epsg": None}, values


def _decoded(path: str, content: bytes) -> tuple[dict, np.ndarray]:
    if content[:2] in (b"II", b"MM"):
        return describe(content), band(content)
    return ascii_grid(content.decode("latin-1"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row for each raster file: path, width, height, cell_w, cell_h, x0, y0, nodata, epsg. A file that is none is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, **(describe(c) if c[:2] in (b"II", b"MM") else _decoded(p, c)[0])} for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in META.split(", ")]).astype({"epsg": "Int32"})

    return _files(spark, path).mapInPandas(run, META)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """cell(path, r, c, x, y, v) of the first band of each file; v is null where the file has nodata. x and y are the centre.

    A file is decoded in one task: rasters larger than that are read as the tiles they are kept in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                m, v = _decoded(p, content)
                none = np.isnan(v) if m["nodata"] is None else np.isnan(v) | np.isclose(v, m["nodata"])
                for top in range(0, m["height"], 256):  # some rows at a time
                    part, gone = v[top : top + 256], none[top : top + 256]
                    r, c = np.mgrid[top : top + len(part), 0 : m["width"]]
                    values = pd.array(part.ravel(), dtype="Float64")
                    values[gone.ravel()] = pd.NA
                    yield pd.DataFrame({"path": p, "r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "x": m["x0"] + (c.ravel() + 0.5) * m["cell_w"], "y": m["y0"] - (r.ravel() + 0.5) * m["cell_h"], "v": values})

    return _files(spark, path).mapInPandas(run, "path string, r int, c int, x double, y double, v double")


def encode(values: np.ndarray, x0: float, y0: float, cell: float, nodata: float = -9999.0, epsg: int | None = None, note: str = "") -> bytes:
    """A GeoTIFF of one float32 band, deflated, in strips of 64 rows; NaN is nodata."""
    rows, cols = values.shape
    data = np.where(np.isnan(values), nodata, values).astype("<f4")
    strips = [zlib.compress(data[i : i + 64].tobytes()) for i in range(0, rows, 64)]
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg) if epsg else ()
    text = lambda s: (2, len(s.encode("latin-1", "replace")) + 1, s.encode("latin-1", "replace") + b"\0")
    pack = lambda kind, *v: (kind, len(v), struct.pack(f"<{len(v)}{TYPES[kind][0]}", *v))
    tags = {256: pack(4, cols), 257: pack(4, rows), 258: pack(3, 32), 259: pack(3, 8), 262: pack(3, 1), 277: pack(3, 1), 278: pack(4, 64), 279: pack(4, *map(len, strips)), 339: pack(3, 3), 33550: pack(12, cell, cell, 0.0), 33922: pack(12, 0.0, 0.0, 0.0, x0, y0, 0.0), 42113: text(f"{nodata:g}")}
    if note:
        tags[270] = text(note)
    if keys:
        tags[34735] = pack(3, *keys)
    tags[273] = pack(4, *([0] * len(strips)))
    tail = 8 + 2 + 12 * len(tags) + 4
    place, extra = {}, b""
    for tag, (_, _, raw) in tags.items():
        if len(raw) > 4:
            place[tag] = tail + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
    first = tail + len(extra)
    offsets = (first + np.concatenate([[0], np.cumsum([len(s) for s in strips])])[:-1]).astype(int).tolist()
    raw = struct.pack(f"<{len(offsets)}I", *offsets)
    if 273 in place:
        extra = extra[: place[273] - tail] + raw + extra[place[273] - tail + len(raw) :]
    tags[273] = (4, len(offsets), raw)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag in sorted(tags):
        kind, n, raw = tags[tag]
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<I", place[tag]) if tag in place else raw.ljust(4, b"\0"))
    return out + struct.pack("<I", 0) + extra + b"".join(strips)


def as_geotiffs(cells: DataFrame, value: str, cell: float, x0: float, y0: float, tile: int = 1024, nodata: float = -9999.0, epsg: int | None = None, note: str = "") -> DataFrame:
    """(tr, tc, content): a raster of cells (r, c, value) as GeoTIFF tiles, a task for each; a null value is nodata."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile, int(key[1]) * tile
        out = np.full((int(pdf["r"].max()) - top + 1, int(pdf["c"].max()) - left + 1), np.nan)
        out[pdf["r"] - top, pdf["c"] - left] = pdf["v"]
        return pd.DataFrame({"tr": [int(key[0])], "tc": [int(key[1])], "content": [encode(out, x0 + left * cell, y0 - top * cell, cell, nodata, epsg, note)]})

    data = cells.select("r", "c", F.col(value).cast("double").alias("v")).withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    return data.groupBy("tr", "tc").applyInPandas(run, "tr long, tc long, content binary")


def save_frames(frames: DataFrame, path: str) -> None:
    """Frames (step, r, c, ...) as a table with a folder for each step; what stood there before goes."""
    frames.write.mode("overwrite").partitionBy("step").parquet(path)
