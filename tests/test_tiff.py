"""TIFF files that this test writes, read back; what filters leave unread; files of one's own sink."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolattice.sources import tiff


def lzw(data):
    """As TIFF has it: a clear code first, codes one wider as soon as the next would not fit."""
    codes, table, word = [256], {bytes([k]): k for k in range(256)}, b""
    widths, size, width = [9], 258, 9
    for k in range(len(data)):
        if word + data[k : k + 1] in table:
            word += data[k : k + 1]
            continue
        codes.append(table[word])
        widths.append(width)
        table[word + data[k : k + 1]] = size
        size += 1
        if size == (1 << width):
            width += 1
        if size == 4094:
            codes.append(256)
            widths.append(width)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = data[k : k + 1]
    for code in ([table[word]] if word else []) + [257]:
        codes.append(code)
        widths.append(width)
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths, strict=True))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    out = b""
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def write(path, values, order="<", compression=1, predictor=1, tile=None, strip=5, separate=False, place=(100.0, 900.0, 0.5), epsg=25833, nodata=None, big=False):
    """``values``: (rows, cols, bands)."""
    h, w, n = values.shape
    values = values.astype(values.dtype.newbyteorder(order))
    planes = [values[:, :, k : k + 1] for k in range(n)] if separate else [values]
    found = []
    for p in planes:
        steps = [(r, c) for r in range(0, h, tile or strip) for c in range(0, w, tile or w)]
        for r, c in steps:
            b = p[r : r + (tile or strip), c : c + (tile or w)]
            if tile:
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(values.dtype)
            found.append(PACK[compression](np.ascontiguousarray(b).tobytes()))
    start = 16 if big else 8
    ends = np.cumsum([start] + [len(x) for x in found])
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [8 * values.dtype.itemsize] * n), (259, "H", [compression]), (277, "H", [n]), (284, "H", [2 if separate else 1]), (317, "H", [predictor]), (339, "H", [kind] * n)]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", ends[:-1]), (325, "I", np.diff(ends))] if tile else [(273, "I", ends[:-1]), (278, "I", [strip]), (279, "I", np.diff(ends))]
    if place:
        tags += [(33550, "d", [place[2], place[2], 0]), (33922, "d", [0, 0, 0, place[0], place[1], 0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, epsg])]
    if nodata is not None:
        tags.append((42113, "s", nodata.encode() + b"\0"))
    body, at, entries = b"".join(found), int(ends[-1]), b""
    inline = 8 if big else 4
    for tag, form, data in sorted(tags, key=lambda t: t[0]):
        packed = data if form == "s" else struct.pack(f"{order}{len(data)}{form}", *(data if form == "d" else map(int, data)))
        if len(packed) > inline:
            field, body, at = struct.pack(order + ("Q" if big else "I"), at), body + packed, at + len(packed)
        else:
            field = packed.ljust(inline, b"\0")
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, {"s": 2, "H": 3, "I": 4, "d": 12}[form], len(data)) + field
    mark = b"II" if order == "<" else b"MM"
    lead = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(lead + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * 8)


RNG = np.random.default_rng(1)
FORMS = {
    "raw": (RNG.integers(0, 255, (13, 17, 3)).astype("u1"), {}),
    "big_endian": (RNG.integers(0, 60000, (13, 17, 1)).astype("u2"), {"order": ">", "strip": 4}),
    "deflate_tiles": (RNG.integers(0, 60000, (40, 37, 2)).astype("u2"), {"compression": 8, "predictor": 2, "tile": 16}),
    "planes": (RNG.normal(size=(20, 9, 3)).astype("f4"), {"compression": 8, "separate": True, "tile": 8}),
    "lzw": ((np.arange(90 * 70) // 3 % 251).reshape(90, 70, 1).astype("u1"), {"compression": 5, "predictor": 2, "strip": 90}),
    "lzw_noise": (RNG.integers(0, 255, (120, 111, 1)).astype("u1"), {"compression": 5, "strip": 120}),
    "packbits": (np.repeat(RNG.integers(0, 3, (30, 4, 1)), 50, axis=1).astype("i2"), {"compression": 32773}),
    "bigtiff": (RNG.normal(size=(7, 8, 1)), {"big": True, "order": ">"}),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms(spark, tmp_path, name):
    values, how = FORMS[name]
    write(tmp_path / "a.tif", values, **how)
    got = np.full(values.shape, np.nan)
    for r in tiff.blocks(spark, str(tmp_path)).collect():
        got[r.row : r.row + r.rows, r.col : r.col + r.cols, r.band - 1] = np.array(r["values"]).reshape(r.rows, r.cols)
        assert (r.left, r.top, r.res, r.epsg) == (100 + r.col / 2, 900 - r.row / 2, 0.5, 25833) and (r.right - r.left, r.top - r.bottom) == (r.cols / 2, r.rows / 2)
    assert np.array_equal(got, values.astype(float))


def test_filters_leave_blocks_and_files_unread(spark, tmp_path):
    """Files outside the box and blocks outside it are broken, so reading them would fail."""
    values = RNG.integers(0, 255, (64, 64, 2)).astype("u1")
    for k in range(4):
        write(tmp_path / f"t{k}.tif", values, compression=8, tile=16, place=(100.0 + 32 * k, 900.0, 0.5), separate=True)
    whole = (tmp_path / "t1.tif").read_bytes()
    with open(tmp_path / "t1.tif", "rb") as f:
        h = tiff.header(f)
    broken = bytearray(whole)
    for k, (at, n) in enumerate(zip(h.offsets, h.lengths, strict=True)):
        if not (k < 16 and k % 4 == 2 and k // 4 == 1):  # only one tile of band 1 is whole
            broken[at : at + n] = b"x" * n
    (tmp_path / "t1.tif").write_bytes(bytes(broken))
    for k in (0, 2, 3):
        data = bytearray((tmp_path / f"t{k}.tif").read_bytes())
        data[8:2000] = b"x" * 1992
        (tmp_path / f"t{k}.tif").write_bytes(bytes(data))
    box = tiff.blocks(spark, str(tmp_path)).where("left < 155 and right > 149 and top > 890 and bottom < 891 and band = 1")
    rows = box.collect()
    assert [(r.row, r.col, r.path[-6:]) for r in rows] == [(16, 32, "t1.tif")] and np.array_equal(np.array(rows[0]["values"]).reshape(16, 16), values[16:32, 32:48, 0])
    with pytest.raises(Exception, match="(?i)error"):
        tiff.blocks(spark, str(tmp_path)).where("band = 1").collect()
    own = str(tmp_path / "t1.tif")
    assert tiff.blocks(spark, str(tmp_path)).where((F.col("path") == own) & (F.col("left") == 148.0) & (F.col("row") == 16) & (F.col("band") == 1) & (F.col("right") > 155) & (F.col("top") <= 892) & (F.col("bottom") >= 884) & (F.col("left") < 149)).count() == 1


def test_info_and_combined_grid(spark, tmp_path):
    a = np.zeros((10, 20, 1), "f4")
    write(tmp_path / "b.tif", a, place=(100.0, 900.0, 0.5), epsg=25833, nodata="-9999")
    write(tmp_path / "a.tiff", a, place=(50.0, 950.0, 1.0), epsg=25832)
    write(tmp_path / "c.tif", a, place=None)
    (tmp_path / "d.tif").write_bytes(b"no raster")
    (tmp_path / "e.txt").write_text("not listed")
    found = tiff.info(spark, [str(tmp_path), str(tmp_path / "missing.tif")])
    rows = found.orderBy("ordinal").collect()
    assert [r.path[-6:].strip("/") for r in rows] == ["b.tif", "c.tif", "d.tif", "a.tiff"]
    assert (rows[0].left, rows[0].bottom, rows[0].right, rows[0].top, rows[0].epsg, rows[0].nodata) == (100, 895, 110, 900, 25833, -9999)
    assert rows[1].left is None and rows[1].width == 20 and rows[2].width is None
    grid = tiff.combined(found).collect()
    assert [tuple(r) for r in grid] == [(50, 895, 110, 950, 0.5, 25833, 120, 110)]
    assert tiff.combined(tiff.info(spark, str(tmp_path / "missing"))).count() == 0
    assert tiff.blocks(spark, str(tmp_path / "missing")).count() == 0


def test_colours_and_cells(spark, tmp_path):
    write(tmp_path / "one.tif", np.array([[[-4.0], [7.9]], [[300.0], [5.0]]], "f4"), nodata="5")
    write(tmp_path / "five.tif", np.arange(20).reshape(2, 2, 5).astype("u1"))
    got = {(r.path[-7:-4], r.band): r["values"] for r in tiff.coloured(tiff.blocks(spark, str(tmp_path))).collect()}
    assert got == {("one", k): [0, 7, 255, 5] for k in (1, 2, 3)} | {("ive", k): [k - 1, k + 4, k + 9, k + 14] for k in (1, 2, 3)}
    cells = tiff.cells(tiff.blocks(spark, str(tmp_path)).where(F.col("path").endswith("one.tif"))).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.x, r.y, r.z) for r in cells] == [(0, 0, 100.25, 899.75, -4.0), (0, 1, 100.75, 899.75, np.float32(7.9)), (1, 0, 100.25, 899.25, 300.0), (1, 1, 100.75, 899.25, None)]


def test_sink_round_trip(spark, tmp_path):
    values = RNG.normal(size=(150, 33)).astype("f4")
    row = [("t", 33, 10.0, 20.0, 2.0, 25833, -1.0, values.astype(float).ravel().tolist())]
    df = spark.createDataFrame(row, "name string, width int, left double, top double, res double, epsg int, nodata double, values array<double>")
    paths = [r.path for r in tiff.write_tiles(df, str(tmp_path / "out")).collect()]
    back = tiff.blocks(spark, paths).orderBy("row").collect()
    assert [r.rows for r in back] == [64, 64, 22] and np.array_equal(np.concatenate([r["values"] for r in back]), values.ravel().astype(float))
    assert {(r.left, r.nodata, r.epsg) for r in back} == {(10.0, -1.0, 25833)} and len(list((tmp_path / "out").iterdir())) == 1
