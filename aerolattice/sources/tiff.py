"""GeoTIFF rasters as a Spark data source, and as a sink of tiles.

A row of the source is a block as the file stores it, a strip or a tile, of one band. Files are listed by the driver; a
task reads a file's header, some hundred bytes, and from there on only those blocks that the filters on their
bounds, band and path leave: conditions on left, right, bottom, top, band and path are pushed down. A large file
is shared by several tasks. Paths are what pyarrow's file systems read: local ones, file:, hdfs:, s3: and such.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a file that one task reads at most, and blocks that are handed on at once.
SPLIT_BYTES, BLOCKS_AT_ONCE = 128 << 20, 16
SCHEMA = "path string, band int, row long, col long, rows int, cols int, left double, bottom double, right double, top double, res double, epsg int, nodata double, values array<double>"
INFO = "path string, width long, height long, bands int, kind string, left double, bottom double, right double, top double, res double, epsg int, nodata double"

# Names of TIFF tags, and sizes and codes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Header:
    """What a TIFF's first directory says: shape, type, blocks and place. x = left + res * col, y = top - res * row."""

    order: str
    width: int
    height: int
    bands: int
    kind: np.dtype
    compression: int
    predictor: int
    separate: bool
    tiled: bool
    block_width: int
    block_height: int
    offsets: tuple
    lengths: tuple
    left: float | None
    top: float | None
    res: float | None
    epsg: int | None
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def box(self, col: int, row: int, cols: int, rows: int) -> tuple:
        """left, bottom, right, top of cells; nulls where the file has no place."""
        if self.res is None:
            return None, None, None, None
        return self.left + col * self.res, self.top - (row + rows) * self.res, self.left + (col + cols) * self.res, self.top - row * self.res


def header(f) -> Header:
    """The header of an open file; ValueError where it is no TIFF of a form that is read here."""
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8:
        raise ValueError("not a TIFF")
    big = struct.unpack(order + "H", start[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), start[8:16] if big else start[4:8])[0]
    f.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    if n > 4096:
        raise ValueError("too many tags")
    raw, tags = f.read(n * size), {}
    for k in range(n):
        entry = raw[k * size : (k + 1) * size]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : size - inline])[0]
        form = TYPES.get(kind)
        if form is None:
            continue
        length = count * struct.calcsize(order + form)
        body = entry[size - inline :][:length]
        if length > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), entry[size - inline :])[0])
            body = f.read(length)
        if len(body) < length:
            raise ValueError("the file is cut off")
        tags[tag] = body if form == "c" else struct.unpack(order + form * count, body)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, form = one(BITS, 1), KINDS.get(one(FORMAT, 1))
    if form is None or bits not in (8, 16, 32, 64) or (form == "f" and bits < 32) or len(set(tags.get(BITS, (1,)))) > 1:
        raise ValueError("samples of this kind aren't read")
    if one(COMPRESSION, RAW) not in (RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or one(PREDICTOR, 1) not in (1, 2, 3):
        raise ValueError("this compression isn't read")
    width, height, tiled = one(WIDTH, 0), one(HEIGHT, 0), TILES in tags
    left = top = res = None
    if SCALE in tags and TIEPOINT in tags:
        res, (i, j, _, x, y, _) = tags[SCALE][0], tags[TIEPOINT][:6]
        left, top = x - i * tags[SCALE][0], y + j * tags[SCALE][1]
    elif TRANSFORM in tags:
        res, left, top = tags[TRANSFORM][0], tags[TRANSFORM][3], tags[TRANSFORM][7]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    try:
        nodata = float(tags[NODATA].split(b"\0")[0]) if NODATA in tags else None
    except ValueError:
        nodata = None
    return Header(
        order, width, height, one(SAMPLES, 1), np.dtype(f"{order}{form}{bits // 8}"), one(COMPRESSION, RAW), one(PREDICTOR, 1), one(PLANAR, 1) == 2, tiled,
        one(TILE_WIDTH, 0) if tiled else width, one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, height), height), tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], left, top, res, codes.get(PROJECTED, codes.get(GEOGRAPHIC)), nodata,
    )


def unpacked_bits(data: bytes) -> bytes:
    """Runs and copies by a signed count before each (PackBits)."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of nine to twelve bits, the highest bit first: 256 clears the table, 257 ends; the width grows one code early."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def decoded(h: Header, data: bytes, rows: int) -> np.ndarray:
    """A stored block as (rows, cols, samples); a block that is too short ends in zeros."""
    if h.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif h.compression == LZW:
        data = unpacked_lzw(data)
    elif h.compression == PACKBITS:
        data = unpacked_bits(data)
    samples = 1 if h.separate else h.bands
    shape = (rows, h.block_width, samples)
    size = int(np.prod(shape)) * h.kind.itemsize
    data = data[:size].ljust(size, b"\0")
    if h.predictor == 3:  # bytes of a row by significance, each as the difference to the one before
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, h.kind.itemsize, h.block_width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(h.kind.newbyteorder(">")).reshape(shape)
    block = np.frombuffer(data, h.kind).reshape(shape)
    if h.predictor == 2:
        block = np.cumsum(block, axis=1, dtype=h.kind.newbyteorder("="))
    return block


def opened(path: str):
    """An open file of any file system that pyarrow has."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def listed(paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files and their sizes: a folder gives its *.tif in order, then its *.tiff; what isn't there is left out."""
    found = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        lead = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            found.append((path, info.size))
        elif info.type == fs.FileType.Directory:
            inside = sorted((x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File), key=lambda x: x.path)
            found += [(lead + x.path, x.size) for end in (".tif", ".tiff") for x in inside if x.path.endswith(end)]
    return found


@dataclass
class Part(InputPartition):
    """The k-th of n equal shares of a file's blocks."""

    path: str
    k: int
    n: int


class TiffReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]):
        self.paths, self.limits, self.only = paths, [], {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on left, right, bottom and top, and a band or path; Spark checks all other filters."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if column in ("left", "right", "bottom", "top"):
                self.limits.append((("left", "bottom", "right", "top").index(column), type(f).__name__, float(f.value)))
            elif column in ("band", "path") and isinstance(f, EqualTo) and column not in self.only:
                self.only[column] = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        files = [(p, size) for p, size in listed(self.paths) if self.only.get("path", p) == p]
        return [Part(p, k, n) for p, size in files for n in (max(1, -(-size // SPLIT_BYTES)),) for k in range(n)] or [Part("", 0, 0)]

    def _wanted(self, box: tuple) -> bool:
        tests = {"EqualTo": lambda a, b: a == b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}
        return all(box[side] is not None and tests[how](box[side], value) for side, how, value in self.limits)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        with opened(part.path) as f:
            h = header(f)
            places = [(r, c) for r in range(h.down) for c in range(h.across)]
            rows = []
            for r, c in places[part.k * len(places) // part.n : (part.k + 1) * len(places) // part.n]:
                row, col = r * h.block_height, c * h.block_width
                n_rows, n_cols = min(h.block_height, h.height - row), min(h.block_width, h.width - col)
                box = h.box(col, row, n_cols, n_rows)
                if not self._wanted(box):
                    continue
                stored = h.block_height if h.tiled else n_rows
                for plane in range(h.bands if h.separate else 1):
                    bands = [plane + 1] if h.separate else list(range(1, h.bands + 1))
                    if "band" in self.only and self.only["band"] not in bands:
                        continue
                    place = plane * len(places) + r * h.across + c
                    f.seek(h.offsets[place])
                    block = decoded(h, f.read(h.lengths[place]), stored)
                    for k, band in enumerate(bands):
                        if self.only.get("band", band) == band:
                            rows.append((part.path, band, row, col, n_rows, n_cols, *box, h.res, h.epsg, h.nodata, block[:n_rows, :n_cols, k].astype(np.float64).ravel()))
                    if len(rows) >= BLOCKS_AT_ONCE:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*(r[:-1] for r in rows), strict=True), kinds, strict=True)]
    ends = np.append(0, np.cumsum([len(r[-1]) for r in rows]))
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[-1] for r in rows])))], names)


class TiffBlocks(DataSource):
    """``spark.read.format("tiff_blocks").option("paths", "a\\nb")``: blocks of TIFF files, a row for each block and band."""

    @classmethod
    def name(cls) -> str:
        return "tiff_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["paths"].split("\n"))


def blocks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Blocks of the TIFF files at ``paths``, files or folders, as rows of SCHEMA.

    Filters on left, right, bottom, top, band and path are pushed down to the files. Missing paths
    are left out; a file that is no TIFF, or of a form that isn't read, ends the query with its name. Files without a place have null bounds,
    which no filter on them meets.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffBlocks)
    return spark.read.format("tiff_blocks").option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).load()


def info(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row for each file: its place in the list, shape and bounds, from the header alone; nulls where that can't be read."""
    files = listed([paths] if isinstance(paths, str) else paths)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ordinal, path in zip(batch["ordinal"], batch["path"], strict=True):
                try:
                    with opened(path) as f:
                        h = header(f)
                    rows.append((ordinal, path, h.width, h.height, h.bands, h.kind.name, *h.box(0, 0, h.width, h.height), h.res, h.epsg, h.nodata))
                except (ValueError, KeyError, OSError, struct.error):
                    rows.append((ordinal, path, *[None] * 11))
            yield pd.DataFrame(rows, columns=["ordinal", *(c.split()[0] for c in INFO.split(", "))])

    listing = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(files)], "ordinal int, path string")
    return listing.repartition(max(1, min(len(files), 1000))).mapInPandas(read, "ordinal int, " + INFO)


def combined(files: DataFrame) -> DataFrame:
    """The grid over all ``files`` (rows of info()): their common bounds, and resolution and system of the first that is placed."""
    placed = files.where("res is not null")
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    grid = placed.agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"), first("res"), first("epsg"))
    sides = {"width": F.col("right") - F.col("left"), "height": F.col("top") - F.col("bottom")}
    return grid.where("res is not null").select("*", *(F.rint(side / F.col("res")).cast("long").alias(name) for name, side in sides.items()))


def cells(found: DataFrame, nodata: Column | None = None) -> DataFrame:
    """(path, band, row, col, x, y, z) of blocks: the cell's middle in the file's system; nodata and NaN are null."""
    at = found.select("path", "band", F.col("row").alias("r0"), F.col("col").alias("c0"), "cols", "left", "top", "res", (F.col("nodata") if nodata is None else nodata).alias("none"), F.posexplode("values").alias("k", "v"))
    r, c = F.floor(F.col("k") / F.col("cols")), F.col("k") % F.col("cols")
    z = F.when(~F.isnan("v") & ~F.coalesce(F.col("v") == F.col("none"), F.lit(False)), F.col("v"))
    return at.select("path", "band", (F.col("r0") + r).cast("long").alias("row"), (F.col("c0") + c).cast("long").alias("col"), (F.col("left") + (c + 0.5) * F.col("res")).alias("x"), (F.col("top") - (r + 0.5) * F.col("res")).alias("y"), z.alias("z"))


def coloured(found: DataFrame) -> DataFrame:
    """Blocks of three bands of 0 to 255: one band is repeated, those beyond three go, values are cut off and truncated."""
    bands = F.max("band").over(Window.partitionBy("path", "row", "col"))
    copies = F.when(F.col("n") == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array("band"))
    cut = F.transform("values", lambda v: F.floor(F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0))).cast("int"))
    return found.where("band <= 3").withColumn("n", bands).withColumn("band", F.explode(copies)).withColumn("values", cut).drop("n")


def encoded(values: np.ndarray, left: float, top: float, res: float, epsg: int, nodata: float, rows: int = 64) -> bytes:
    """A GeoTIFF of one band of 32-bit floats in deflated strips of ``rows`` rows, differences by byte significance."""
    height, width = values.shape
    strips = []
    for at in range(0, height, rows):
        planes = np.ascontiguousarray(values[at : at + rows].astype(">f4")).view(np.uint8).reshape(-1, width, 4).transpose(0, 2, 1).reshape(-1, 4 * width)
        strips.append(zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()))
    ends = np.cumsum([8] + [len(s) for s in strips])
    text = f"{nodata:g}".encode() + b"\0"
    tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [32]), (COMPRESSION, "H", [DEFLATE]), (262, "H", [1]), (STRIPS, "I", ends[:-1]), (SAMPLES, "H", [1]), (STRIP_ROWS, "I", [rows]), (STRIP_BYTES, "I", np.diff(ends)), (PREDICTOR, "H", [3]), (FORMAT, "H", [3]), (SCALE, "d", [res, res, 0]), (TIEPOINT, "d", [0, 0, 0, left, top, 0]), (GEO_KEYS, "H", [1, 1, 0, 1, PROJECTED, 0, 1, epsg]), (NODATA, "c", [text[k : k + 1] for k in range(len(text))])]
    codes = {"c": 2, "H": 3, "I": 4, "d": 12}
    body, at, entries = b"".join(strips), int(ends[-1]), []
    for tag, form, data in tags:
        packed = struct.pack(f"<{len(data)}{form}", *(data if form in "cd" else map(int, data)))
        if len(packed) > 4:
            place, at, body = struct.pack("<I", at), at + len(packed), body + packed
        else:
            place = packed.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, codes[form], len(data)) + place)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def write_tiles(tiles: DataFrame, folder: str) -> DataFrame:
    """Writes a GeoTIFF for each row of ``tiles`` (name, width, left, top, res, epsg, nodata, values by rows) into ``folder``; gives name and path.

    A file appears under its name when it is whole, so a task that runs again, or twice, leaves the same.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            paths = []
            for t in batch.itertuples(index=False):
                own = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as f:
                    f.write(encoded(np.asarray(t.values, np.float64).reshape(-1, t.width), t.left, t.top, t.res, t.epsg, t.nodata))
                system.move(own, f"{inner}/{t.name}.tif")
                paths.append(f"{folder}/{t.name}.tif")
            yield pd.DataFrame({"name": batch["name"], "path": paths})

    return tiles.select("name", "width", "left", "top", "res", "epsg", "nodata", "values").mapInPandas(write, "name string, path string")
