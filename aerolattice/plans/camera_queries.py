"""Queries of cameras that are found from correspondences, and of raster files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera_fit, scene, segments, two_views
from ..scratch import scratch_path
from ..sources import tiff
from .queries import query

WIDTH, HEIGHT = 640.0, 480.0


def _rounded(names: str, digits: int) -> list:
    return [(F.round(n, digits) + 0.0).alias(n) for n in names.split()]  # no negative zero


@query("sights", """, n AS (SELECT frame, cx, cy, cz, count(u) AS points, count(*) FILTER (WHERE fits AND u IS NOT NULL) AS inliers FROM sights GROUP BY frame, cx, cy, cz)
    SELECT frame, points, CASE WHEN points<30 THEN 0 ELSE inliers END AS inliers, CASE WHEN points>=30 AND inliers>=30 THEN cx END AS x, CASE WHEN points>=30 AND inliers>=30 THEN cy END AS y, CASE WHEN points>=30 AND inliers>=30 THEN cz END AS z FROM n""")
def located_frames(df):
    """Poses of frames of which four or six in ten correspondences are right; all are seen as by one focal length."""
    seen = df.withColumns({a: (F.col(a) - m) * (500 / F.col("focal")) for a, m in (("u", WIDTH / 2), ("v", HEIGHT / 2))})
    return camera_fit.locate(seen, 500.0, (0.0, 0.0)).select("frame", "points", "inliers", *_rounded("x y z", 4))


@query("sights", """, n AS (SELECT frame, cx, cy, cz, focal, count(u) AS points, count(*) FILTER (WHERE fits AND u IS NOT NULL) AS inliers FROM sights WHERE frame%5<>0 GROUP BY frame, cx, cy, cz, focal)
    SELECT frame AS camera, CASE WHEN points>=30 THEN round(focal,3) END AS focal, CASE WHEN points>=30 THEN 40.5+frame%30 END AS fov, CASE WHEN points>=30 THEN cz END AS z FROM n""")
def calibrated_cameras(df):
    """Focal lengths of the frames of relief: over flat ground a longer one can't be told from a greater height."""
    relief = df.where("frame % 5 <> 0").withColumnRenamed("frame", "camera")
    return camera_fit.calibrate(relief, WIDTH, HEIGHT).select("camera", *_rounded("focal fov z", 3))


@query("views", """ SELECT pair, count(*) AS points, CASE WHEN pair%3=0 THEN 'plane' ELSE 'essential' END AS model, any_value(round(cos(yaw),3)+0.0) AS r0, any_value(round(sin(yaw)*cos(tilt),3)+0.0) AS r3, any_value(round(sin(yaw)*sin(tilt),3)+0.0) AS r6,
    any_value(round(0.8e0*cos(radians(pair*40e0)),3)+0.0) AS tx, any_value(round(0.8e0*sin(radians(pair*40e0)),3)+0.0) AS ty, any_value(CASE WHEN pair%2=0 THEN 0.6 ELSE -0.6 END) AS tz FROM (SELECT *, radians(pair%9*2e0-8) AS yaw, radians(pair%7-3e0) AS tilt FROM views) s GROUP BY pair""")
def view_motions(df):
    """Turn and direction between two views of flat ground, where a homography decides, and of relief; three in ten pairs of pixels are wrong."""
    found = two_views.relative_poses(df, 500.0, (WIDTH / 2, HEIGHT / 2))
    turns = {f"r{k}": F.col("rel")[k] for k in (0, 3, 6)}
    return found.withColumns(turns).select("pair", "points", "model", *_rounded("r0 r3 r6 tx ty tz", 3))


TILE, LEFT, TOP = 16, 1000.0, 2000.0


@query("dsm", "SELECT row, col, round(z, 3) AS z FROM dsm WHERE col >= 5 AND col < 30 AND row < 40")
def raster_files(df):
    """A height map written as GeoTIFF tiles, and a window of it read back: tiles and strips outside aren't read."""
    of = [F.floor(F.col(c) / TILE).alias(f"t{c}") for c in ("row", "col")]
    places = F.map_from_entries(F.collect_list(F.struct((F.col("row") % TILE * TILE + F.col("col") % TILE).cast("int"), "z")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda k: F.coalesce(F.element_at("cells", k), F.lit(-9999.0)))
    tiles = df.groupBy(*of).agg(places.alias("cells")).select(
        F.concat_ws("_", F.lit("dsm"), "trow", "tcol").alias("name"), F.lit(TILE).alias("width"), (LEFT + F.col("tcol") * TILE).alias("left"), (TOP - F.col("trow") * TILE).alias("top"),
        F.lit(1.0).alias("res"), F.lit(25833).alias("epsg"), F.lit(-9999.0).alias("nodata"), filled.alias("values"),
    )
    folder = scratch_path(df.sparkSession, "tiles")
    tiff.write_tiles(tiles, folder).write.format("noop").mode("overwrite").save()
    near = tiff.blocks(df.sparkSession, folder).where((F.col("right") > LEFT + 5) & (F.col("left") < LEFT + 30) & (F.col("top") > TOP - 40))
    inside = tiff.cells(near).where((F.col("x") > LEFT + 5) & (F.col("x") < LEFT + 30) & (F.col("y") > TOP - 40) & F.col("z").isNotNull())
    return inside.select((TOP - 0.5 - F.col("y")).cast("long").alias("row"), (F.col("x") - LEFT - 0.5).cast("long").alias("col"), F.round("z", 3).alias("z"))


# --- scenes -------------------------------------------------------------------------------------------

_SEEN = "s AS (SELECT frame AS cam, u, v, CASE WHEN ord%13=0 THEN 0 ELSE depth END AS d FROM matches), p AS (SELECT x+d*(m0*(u-320)/500+m1*(v-240)/500+m2) AS px, y+d*(m3*(u-320)/500+m4*(v-240)/500+m5) AS py, z+d*(m6*(u-320)/500+m7*(v-240)/500+m8) AS pz FROM s JOIN cameras USING (cam) WHERE d>0)"


def _depths(matches):
    depth = F.when(F.col("ord") % 13 == 0, 0.0).otherwise(F.col("depth"))
    return matches.select(F.col("frame").alias("cam"), "u", "v", depth.alias("depth"))


def _camera() -> list:
    return [F.lit(v) for v in (500.0, 500.0, WIDTH / 2, HEIGHT / 2)]


@query("cameras matches", f""", {_SEEN}, g AS (SELECT quantile_cont(pz,0.5) AS ground FROM p), c(u, v) AS (VALUES (0e0, 0e0), (640e0, 0e0), (640e0, 480e0), (0e0, 480e0)), r AS (SELECT x, y, z, m0*(u-320)/500+m1*(v-240)/500+m2 AS dx, m3*(u-320)/500+m4*(v-240)/500+m5 AS dy, m6*(u-320)/500+m7*(v-240)/500+m8 AS dz FROM cameras, c WHERE cam IN (SELECT cam FROM s)),
    t AS (SELECT *, sqrt(dx*dx+dy*dy) AS flat, CASE WHEN abs(dz)>1e-6 THEN (ground-z)/dz ELSE -1 END AS t FROM r, g), f AS (SELECT x+far*dx AS fx, y+far*dy AS fy FROM (SELECT *, CASE WHEN t<=0 OR t*flat>2000 THEN 2000/flat ELSE t END AS far FROM t) q),
    b AS (SELECT least(quantile_cont(px,0.005), (SELECT min(fx) FROM f))-200 AS minx, least(quantile_cont(py,0.005), (SELECT min(fy) FROM f))-200 AS miny, greatest(quantile_cont(px,0.995), (SELECT max(fx) FROM f))+200 AS maxx, greatest(quantile_cont(py,0.995), (SELECT max(fy) FROM f))+200 AS maxy FROM p), m AS (SELECT (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my FROM cameras)
    SELECT CASE WHEN wide THEN greatest(minx,mx-2500) ELSE minx END AS minx, CASE WHEN wide THEN greatest(miny,my-2500) ELSE miny END AS miny, CASE WHEN wide THEN least(maxx,mx+2500) ELSE maxx END AS maxx, CASE WHEN wide THEN least(maxy,my+2500) ELSE maxy END AS maxy FROM (SELECT *, greatest(maxx-minx,maxy-miny)>5000 AS wide FROM b, m) w""")
def scene_boxes(cameras, matches):
    """The box of the scene that the cameras see."""
    return scene.scene_box(cameras, _depths(matches), WIDTH, HEIGHT, _camera())


@query("matches dsm", """, o AS (SELECT gx*0+(ord%53)*0.97e0 AS x, (ord%7)*0.93e0-0.4e0 AS y, 60+crop*3+depth/4 AS pz FROM matches WHERE ord%13<>0), b AS (SELECT o.*, (SELECT count(*) FROM dsm)>0 AS ok, CAST(floor(7-y) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS c FROM o),
    h AS (SELECT pz-coalesce(CASE WHEN x<=30 AND y>=0 AND y<=7 AND a.z>-1000 THEN a.z END, CASE WHEN x>=20 AND x<=50 AND y>=0 AND y<=7 AND d.z>-1000 THEN d.z END) AS d FROM b LEFT JOIN (SELECT row, col, CASE WHEN col%9=0 THEN -9999 ELSE z END AS z FROM dsm WHERE col<30 AND row<7) a ON a.row=r AND a.col=c LEFT JOIN (SELECT row, col, z FROM dsm WHERE col>=20 AND row<7) d ON d.row=r AND d.col=c)
    SELECT CASE WHEN abs(quantile_cont(d,0.5))<=100 THEN quantile_cont(d,0.5) END AS "offset", count(d) AS points FROM h""")
def height_offsets(matches, dsm):
    """The median height of points above two overlapping tiles of a map, the first of which has gaps."""
    points = matches.where("ord % 13 <> 0").select((F.col("ord") % 53 * 0.97).alias("x"), (F.col("ord") % 7 * 0.93 - 0.4).alias("y"), (60 + F.col("crop") * 3 + F.col("depth") / 4).alias("z"))
    tiles = df_of(matches, [("a", 0.0, 0.0, 30.0, 7.0, 1.0), ("b", 20.0, 0.0, 50.0, 7.0, 1.0)], "tile string, left double, bottom double, right double, top double, res double")
    low = dsm.where("row < 7")
    first = low.where("col < 30").select(F.lit("a").alias("tile"), "row", "col", F.when(F.col("col") % 9 == 0, -9999.0).otherwise(F.col("z")).alias("z"))
    second = low.where("col >= 20").select(F.lit("b").alias("tile"), "row", (F.col("col") - 20).alias("col"), "z")
    return scene.height_offset(points, tiles, first.unionByName(second), size=16.0)


@query("matches", """, p AS (SELECT frame, gx/10 AS x, gy*(CASE WHEN frame%5=0 THEN 0.001e0 ELSE 0.1e0 END) AS y, 0.2e0*gx/10+ord%7*0.05e0 AS z, -0.2e0+ord%3*0.01e0 AS nx, 0.01e0 AS ny, 1e0 AS nz FROM matches), u AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS n FROM p),
    m AS (SELECT frame, count(*) AS cells, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(nx/n) AS mx, avg(ny/n) AS my, avg(nz/n) AS mz, var_pop(x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, var_pop(y) AS yy, covar_pop(y,z) AS yz, var_pop(z) AS zz FROM u GROUP BY frame),
    t AS (SELECT *, (xx+yy+zz)/3 AS q, xx*yy+xx*zz+yy*zz-xy*xy-xz*xz-yz*yz AS c1, xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz) AS c0 FROM m), w AS (SELECT *, sqrt(greatest(q*q-c1/3,0)) AS p FROM t), a AS (SELECT *, acos(greatest(least((2*q*q*q-q*c1+c0)/(2*p*p*p),1e0),-1e0))/3 AS phi FROM w),
    e AS (SELECT *, 2*sqrt(q+2*p*cos(phi)) AS major, 2*sqrt(greatest(q+2*p*cos(phi-2*pi()/3),0)) AS minor, sqrt(mx*mx+my*my+mz*mz) AS l FROM a)
    SELECT frame, cells, round(mx/l,4) AS nx, round(mz/l,4) AS nz, round(cx,3) AS cx, round((mx*cx+my*cy+mz*cz)/l,3) AS d, round(major,3) AS extent_major, round(minor,3) AS extent_minor, round(major*minor,2) AS area FROM e WHERE major*minor>=1 AND minor>=0.3e0 AND major<=25*minor""")
def segment_planes(df):
    """Planes of the points of frames, some of which are too narrow."""
    y = F.col("gy") * F.when(F.col("frame") % 5 == 0, 0.001).otherwise(0.1)
    normal = [-0.2 + F.col("ord") % 3 * 0.01, F.lit(0.01), F.lit(1.0)]
    n = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2])
    points = df.select("frame", (F.col("gx") / 10).alias("x"), y.alias("y"), (0.2 * F.col("gx") / 10 + F.col("ord") % 7 * 0.05).alias("z"), *[(c / n).alias(name) for c, name in zip(normal, ("nx", "ny", "nz"), strict=True)])
    found = segments.fitted_planes(points, ["frame"])
    return found.select("frame", "cells", *[F.round(c, k).alias(c) for c, k in (("nx", 4), ("nz", 4), ("cx", 3), ("d", 3), ("extent_major", 3), ("extent_minor", 3), ("area", 2))])


def df_of(like, rows: list, schema: str):
    return like.sparkSession.createDataFrame(rows, schema)
