"""Rasters as rows (row, col, z), and as blocks of rows for sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled(points: DataFrame, raster: DataFrame, col: str, row: str, out: str, key: list[str]) -> DataFrame:
    """``key`` of ``points`` with the bilinear value at (col, row): nearest cell where a corner is missing, null outside.

    The raster's cells meet the points' four corners on equal keys, and the key and place of a point bring its corners
    together again: nothing else of it is shuffled, and no number of its own that a task which runs again might
    give otherwise. Points of equal key and place are counted and come out as often.
    """
    c0, r0 = F.floor(F.col(col)), F.floor(F.col(row))
    fc, fr = F.col(col) - c0, F.col(row) - r0
    corners = [(i, j, (fc if i else 1 - fc) * (fr if j else 1 - fr)) for i in (0, 1) for j in (0, 1)]
    parts = F.array(*[F.struct((c0 + i).alias("_c"), (r0 + j).alias("_r"), w.alias("_w"), F.lit(False).alias("_near")) for i, j, w in corners],
                    F.struct(F.rint(F.col(col)).cast("long").alias("_c"), F.rint(F.col(row)).cast("long").alias("_r"), F.lit(0.0).alias("_w"), F.lit(True).alias("_near")))
    asked = points.select(*key, F.col(col).alias("_x"), F.col(row).alias("_y"), F.inline(parts))
    cells = raster.select(F.col("col").cast("long").alias("_c"), F.col("row").cast("long").alias("_r"), F.col("z").alias("_z"))
    found = asked.join(cells, ["_c", "_r"], "left").groupBy(*key, "_x", "_y").agg(
        F.count_if("_near").alias("_copies"), F.count(F.when(~F.col("_near"), F.col("_z"))).alias("_n"),
        F.sum(F.when(~F.col("_near"), F.col("_w") * F.col("_z"))).alias("_sum"), F.max(F.when(F.col("_near"), F.col("_z"))).alias("_nearest"),
    )
    value = F.when(F.col("_n") == 4 * F.col("_copies"), F.col("_sum") / F.col("_copies")).otherwise(F.col("_nearest"))
    return found.select(*key, value.alias(out), F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def pooled(raster: DataFrame, factor: int, how) -> DataFrame:
    """Blocks of ``factor`` by ``factor`` cells, summed up by ``how`` (F.max, F.avg ...); what is left over is dropped."""
    sizes = raster.agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    inside = raster.join(F.broadcast(sizes)).where(f"row < floor((_h + 1) / {factor}) * {factor} and col < floor((_w + 1) / {factor}) * {factor}")
    return inside.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(how("z").alias("z"))


def window(raster: DataFrame, row: int, col: int, height: int, width: int, fill: float) -> DataFrame:
    """A window of fixed size, filled with ``fill`` where the raster has no cell."""
    spark = raster.sparkSession
    grid = spark.range(height).select(F.col("id").alias("wr"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("wc"))
    cells = raster.where(f"row >= {row} and row < {row + height} and col >= {col} and col < {col + width}")
    own = cells.select((F.col("row") - row).cast("long").alias("wr"), (F.col("col") - col).cast("long").alias("wc"), "z")
    return grid.join(own, ["wr", "wc"], "left").withColumn("z", F.coalesce("z", F.lit(fill)))


def first_tile(cells: DataFrame, keys: list[str], value: str, order: str, valid: Column) -> DataFrame:
    """Of overlapping tiles the value of the first that has a valid one."""
    return cells.where(valid).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_tile(cells: DataFrame, keys: list[str], value: str, order: str, valid: Column) -> DataFrame:
    return cells.where(valid).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def _diamond(cells: DataFrame, reach: int) -> DataFrame:
    """The cells within ``reach`` steps up, down and sideways of each of ``cells``, as often as they are."""
    steps = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if abs(r) + abs(c) <= reach]
    moved = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in steps])
    return cells.select(F.inline(moved))


def dilated(cells: DataFrame, grid: DataFrame, reach: int) -> DataFrame:
    """Cells (row, col) of ``grid`` that are within ``reach`` steps of one of ``cells``."""
    return _diamond(cells.select("row", "col"), reach).distinct().join(grid.select("row", "col"), ["row", "col"], "left_semi")


def eroded(cells: DataFrame, reach: int) -> DataFrame:
    """Those of the distinct ``cells`` (row, col) around which all within ``reach`` steps are among them too."""
    around = _diamond(cells.select("row", "col"), reach).groupBy("row", "col").agg(F.count("*").alias("n"))
    return around.where(F.col("n") == 2 * reach * (reach + 1) + 1).select("row", "col")


def closed(cells: DataFrame, grid: DataFrame, reach: int) -> DataFrame:
    """``cells`` of ``grid`` with their gaps filled: dilated, then eroded; beyond the grid is nothing."""
    return eroded(dilated(cells, grid, reach), reach)


def normals(raster: DataFrame) -> DataFrame:
    """Unit normals of inner cells from central differences of the height; cells at a border have none."""
    at = raster.select("row", "col", "z")
    shifts = {"east": (0, -1), "west": (0, 1), "south": (-1, 0), "north": (1, 0)}
    moved = [at.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(name).alias("side"), "z") for name, (dr, dc) in shifts.items()]
    around = moved[0].unionByName(moved[1]).unionByName(moved[2]).unionByName(moved[3]).groupBy("row", "col").pivot("side", list(shifts)).agg(F.first("z"))
    dx, dy = (F.col("east") - F.col("west")) / 2, (F.col("south") - F.col("north")) / 2
    n = F.sqrt(dx * dx + dy * dy + 1)
    inner = at.select("row", "col").join(around.dropna(), ["row", "col"])
    return inner.select("row", "col", (-dx / n).alias("nx"), (-dy / n).alias("ny"), (1 / n).alias("nz"))
