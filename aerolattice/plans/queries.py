"""Queries of the trajectory and geodata operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import aggregates, joins, mesh, raster, windows
from .fixtures import relation, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KINEMATIC = "seq, ord, x, y, z"


def query(relations: str, sql: str | None):
    """Registers a function of the named relations' DataFrames, and its SQL."""

    def register(f):
        names = relations.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[relation(spark, sf_dir, n) for n in names])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_relations(names, sql)
        return f

    return register


def r4(c, name: str):
    return F.round(c, 4).alias(name)


# --- scalar geometry ----------------------------------------------------------------------------------

_ERR = "sqrt((ex-gx)*(ex-gx)+(ey-gy)*(ey-gy)+(ez-gz)*(ez-gz))"


@query("results", f"SELECT frame_id, round({_ERR},4) AS error_3d, round(sqrt((ex-gx)*(ex-gx)+(ey-gy)*(ey-gy)),4) AS error_xy, round(abs(ez-gz),4) AS error_z FROM results")
def pose_position_errors(df):
    return df.select("frame_id", r4(g.position_error(["ex", "ey", "ez"], ["gx", "gy", "gz"]), "error_3d"), r4(g.position_error(["ex", "ey"], ["gx", "gy"]), "error_xy"), r4(F.abs(F.col("ez") - F.col("gz")), "error_z"))


@query("quats", """, p AS (SELECT *, lead(qw) OVER w AS pw, lead(qx) OVER w AS px, lead(qy) OVER w AS py, lead(qz) OVER w AS pz FROM quats WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    d AS (SELECT vec_id, qw*pw+qx*px+qy*py+qz*pz AS dot, sqrt((qw*qw+qx*qx+qy*qy+qz*qz)*(pw*pw+px*px+py*py+pz*pz)) AS n FROM p)
    SELECT vec_id, round(degrees(acos(greatest(least(2*dot*dot/(n*n)-1, 1.0), -1.0))), 3) AS angle FROM d WHERE n > 0""")
def rotation_errors(df):
    w = Window.partitionBy("label").orderBy("vec_id")
    paired = df.withColumns({f"p{k}": F.lead(f"q{k}").over(w) for k in "wxyz"})
    return paired.select("vec_id", F.round(g.angle_between([f"q{k}" for k in "wxyz"], [f"p{k}" for k in "wxyz"]), 3).alias("angle")).where("angle is not null")


@query("quats", """, n AS (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz AS n FROM quats)
    SELECT vec_id, round(1-2*(qy*qy+qz*qz)/n,4) AS m00, round(2*(qx*qy-qz*qw)/n,4) AS m01, round(2*(qx*qz-qy*qw)/n,4) AS m20, round(2*(qy*qz+qx*qw)/n,4) AS m21, round(1-2*(qx*qx+qy*qy)/n,4) AS m22,
      round(abs(qw)/sqrt(n),4) AS w, round(degrees(atan2(2*(qy*qz+qx*qw)/n, 1-2*(qx*qx+qy*qy)/n)),3) AS roll, round(degrees(asin(greatest(least(-2*(qx*qz-qy*qw)/n,1.0),-1.0))),3) AS pitch FROM n""")
def quaternion_matrices(df):
    m = df.withColumn("m", g.quaternion_matrix(*[F.col(f"q{k}") for k in "wxyz"]))
    euler = g.euler_xyz(F.col("m"))
    back = g.matrix_quaternion(F.col("m"))
    return m.select("vec_id", *[r4(F.col("m")[k], n) for k, n in ((0, "m00"), (1, "m01"), (6, "m20"), (7, "m21"), (8, "m22"))], r4(back[0], "w"), F.round(euler[0], 3).alias("roll"), F.round(euler[1], 3).alias("pitch"))


@query("quats", """, n AS (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz AS n, vec_id*0.5e0 AS cx, vec_id%7+1e0 AS cy, vec_id%11-2e0 AS cz FROM quats)
    SELECT vec_id, round(-((1-2*(qy*qy+qz*qz)/n)*cx + 2*(qx*qy+qz*qw)/n*cy + 2*(qx*qz-qy*qw)/n*cz),3) AS tx, round(-(2*(qx*qz+qy*qw)/n*cx + 2*(qy*qz-qx*qw)/n*cy + (1-2*(qx*qx+qy*qy)/n)*cz),3) AS tz, round(cx,3) AS back FROM n""")
def world_to_camera(df):
    centre = [F.col("vec_id") * 0.5, F.col("vec_id") % 7 + 1.0, F.col("vec_id") % 11 - 2.0]
    m = df.withColumn("m", g.quaternion_matrix(*[F.col(f"q{k}") for k in "wxyz"])).withColumns({f"c{k}": c for k, c in enumerate(centre)})
    t = g.world_to_camera(F.col("m"), [F.col(f"c{k}") for k in range(3)])
    w2c = F.array(*[F.col("m")[3 * c + r] for r in range(3) for c in range(3)])
    back = g.camera_centre(w2c, t)
    return m.select("vec_id", F.round(t[0], 3).alias("tx"), F.round(t[2], 3).alias("tz"), F.round(back[0], 3).alias("back"))


@query("places", """, p AS (SELECT *, CAST(floor((lon+180)/6)+1 AS INTEGER) AS zone FROM places), q AS (SELECT *, radians(lat) AS phi, radians(lon-(6*zone-183)) AS lam, 0.0818191908426215e0 AS e FROM p),
    c AS (SELECT *, sinh(atanh(sin(phi)) - e*atanh(e*sin(phi))) AS t FROM q), d AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam)/sqrt(t*t+cos(lam)*cos(lam))) AS eta FROM c)
    SELECT place, zone, round(500000+0.9996e0*6367449.145823415e0*(eta + 0.0008377318206244698e0*cos(2*xi)*sinh(2*eta) + 7.608527773572307e-07*cos(4*xi)*sinh(4*eta) + 1.197645503329453e-09*cos(6*xi)*sinh(6*eta)),2) AS east,
      round(0.9996e0*6367449.145823415e0*(xi + 0.0008377318206244698e0*sin(2*xi)*cosh(2*eta) + 7.608527773572307e-07*sin(4*xi)*cosh(4*eta) + 1.197645503329453e-09*sin(6*xi)*cosh(6*eta)),2) AS north, round(lat,7) AS lat, round(lon,7) AS lon FROM d""")
def utm_coordinates(df):
    placed = g.with_utm(df.withColumn("zone", g.utm_zone(F.col("lon"))), "lat", "lon", "zone")
    back = g.with_latlon(placed.drop("lat", "lon"), "east", "north", "zone")
    return back.select("place", "zone", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("places", """, n AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam, 6378137.0/sqrt(1-0.006694379990141316*sin(radians(lat))*sin(radians(lat))) AS n FROM places)
    SELECT place, round((n+height)*cos(phi)*cos(lam),3) AS x, round((n+height)*cos(phi)*sin(lam),3) AS y, round((n*(1-0.006694379990141316)+height)*sin(phi),3) AS z, round(lat,7) AS lat, round(height,2) AS height FROM n""")
def ecef_coordinates(df):
    x, y, z = g.ecef(F.col("lat"), F.col("lon"), F.col("height"))
    placed = df.select("place", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, _, height = g.ecef_inverse(F.col("x"), F.col("y"), F.col("z"))
    return placed.select("place", *[F.round(c, 3).alias(c) for c in "xyz"], F.round(lat, 7).alias("lat"), F.round(height, 2).alias("height"))


_FORM = r"""CASE WHEN regexp_matches(stem, '\d{2}(\d{3})-(\d{4})') THEN regexp_extract(stem, '\d{2}(\d{3})-(\d{4})', %d) WHEN regexp_matches(stem, '_33_(\d{3})_(\d{4})') THEN regexp_extract(stem, '_33_(\d{3})_(\d{4})', %d)
    WHEN regexp_matches(stem, '_(\d{3})_(\d{4})$') THEN regexp_extract(stem, '_(\d{3})_(\d{4})$', %d) WHEN regexp_matches(stem, '^(\d{3})_(\d{4})') THEN regexp_extract(stem, '^(\d{3})_(\d{4})', %d)
    WHEN regexp_matches(stem, '^32(\d+)_(\d+)(_|$)') THEN regexp_extract(stem, '^32(\d+)_(\d+)(_|$)', %d) WHEN regexp_matches(stem, '^(\d+)_(\d+)(_|$)') THEN regexp_extract(stem, '^(\d+)_(\d+)(_|$)', %d) END"""


@query("names", rf""", s AS (SELECT part, replace(replace(replace(regexp_replace(name, '(.)\.[^.]*$', '\1'), '_20_DOM', ''), '_DOM', ''), '_DSM', '') AS stem FROM names)
    SELECT part, CAST({_FORM % ((1,) * 6)} AS BIGINT)*1000 AS minx, CAST({_FORM % ((2,) * 6)} AS BIGINT)*1000 AS miny FROM s""")
def tile_bounds_from_names(df):
    x, y = g.tile_origin(F.col("name"))
    return df.select("part", x.alias("minx"), y.alias("miny"))


@query("boxes", "SELECT box, '33'||CAST(floor(minx/1000) AS BIGINT)||'-'||CAST(floor(miny/1000) AS BIGINT) AS dop, '3dm_33_'||CAST(floor(minx/1000) AS BIGINT)||'_'||CAST(floor(miny/1000) AS BIGINT)||'_1_be' AS als, 'LoD2_'||CAST(floor(minx/1000) AS BIGINT)||'_'||CAST(floor(miny/1000) AS BIGINT) AS lod, floor(minx/2000.0)*2000.0 AS cell FROM boxes")
def tile_ids(df):
    return df.select("box", *[g.tile_id(F.col("minx"), F.col("miny"), k).alias(k) for k in ("dop", "als", "lod")], g.grid_origin(F.col("minx"), 2000.0).alias("cell"))


@query("path", """, r AS (SELECT seq, ord, 90-abs(yaw/2) AS o FROM path), v AS (SELECT seq, ord, greatest(least(CASE WHEN o<=30 THEN 1-0.2*o/30 WHEN o<=60 THEN 0.8-0.4*(o-30)/30 ELSE 0.4-0.4*(o-60)/30 END,1.0),0.0) AS r FROM r)
    SELECT seq, ord, round(r,4) AS reliability, greatest(30, CAST(floor(100*(0.3e0+0.7e0*r)) AS INTEGER)) AS inliers FROM v""")
def view_reliability(df):
    pitch = F.col("yaw") / 2
    return df.select("seq", "ord", r4(g.view_reliability(pitch), "reliability"), g.required_inliers(pitch).alias("inliers"))


@query("matches", "SELECT frame, ord, crop, round(u,2) AS u, round(v,2) AS v, round(100+u*0.2,4) AS x, round(900-v*0.2,4) AS y, CAST(trunc((u-37.5)/3) AS BIGINT) AS cell, round(depth/sqrt((u-150)*(u-150)/1e6+(v-110)*(v-110)/1e6+1),4) AS z FROM matches")
def pixel_geometry(df):
    x, y = g.pixel_to_map(F.col("u"), F.col("v"), F.lit(100.0), F.lit(900.0), F.lit(0.2))
    col, row = g.map_to_pixel(x, y, F.lit(100.0), F.lit(900.0), F.lit(0.2))
    z = g.ray_to_depth(F.col("depth"), F.col("u"), F.col("v"), F.lit(1000.0), F.lit(1000.0), F.lit(150.0), F.lit(110.0))
    return df.select("frame", "ord", "crop", F.round(col, 2).alias("u"), F.round(row, 2).alias("v"), r4(x, "x"), r4(y, "y"), g.toward_zero((F.col("u") - 37.5) / 3).alias("cell"), r4(z, "z"))


@query("dsm", "SELECT row, col, round(2*(z-100)/50-1,6) AS signed, round((z-100)/50,6) AS unsigned, round(z,6) AS back FROM dsm")
def normalised_heights(df):
    a = g.scaled(F.col("z"), F.lit(50.0), F.lit(100.0), "minmax_11")
    b = g.scaled(F.col("z"), F.lit(50.0), F.lit(100.0), "minmax_01")
    return df.select("row", "col", F.round(a, 6).alias("signed"), F.round(b, 6).alias("unsigned"), F.round(g.unscaled(a, F.lit(50.0), F.lit(100.0), "minmax_11"), 6).alias("back"))


@query("boxes", """SELECT box, round((maxy-miny)*10/(2*tan(radians(20.0+box%60)/2)),4) AS fy, CAST(CASE WHEN greatest(maxx-minx,maxy-miny)<=64 THEN maxx-minx ELSE floor((maxx-minx)*(64/greatest(maxx-minx,maxy-miny))) END AS INTEGER) AS width,
    least(7, greatest(3, CAST(ceil(log2(greatest(84.0, 0.1*greatest(minx,miny))/10.5)) AS INTEGER))) AS level FROM boxes""")
def camera_parameters(df):
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return df.select("box", r4(g.focal_length(h * 10, 20.0 + F.col("box") % 60), "fy"), g.downsample_size(w, h, 64)[0].alias("width"), g.pyramid_level(F.col("minx"), F.col("miny")).alias("level"))


# --- ordered sequences --------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY seq ORDER BY ord)"
_STEP = "sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w))"


@query("path", f"SELECT seq, ord, round({_STEP}*30,4) AS speed FROM path {_W}")
def frame_speeds(df):
    return df.select("seq", "ord", r4(windows.step_length(["x", "y", "z"], windows.of()) * 30, "speed"))


@query("path", """, d AS (SELECT seq, ord, yaw, yaw-lag(yaw) OVER (PARTITION BY seq ORDER BY ord) AS d FROM path), m AS (SELECT *, CASE WHEN (((d+180)%360)+360)%360-180=-180 AND d>0 THEN 180 ELSE (((d+180)%360)+360)%360-180 END AS m FROM d)
    SELECT seq, ord, round(yaw+sum(coalesce(CASE WHEN abs(d)<180 THEN 0 ELSE m-d END,0)) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING),4) AS yaw FROM m""")
def unwrapped_angles(df):
    return windows.unwrapped(df, "yaw", "out").select("seq", "ord", r4(F.col("out"), "yaw"))


@query("path", """, n AS (SELECT seq, ord, x, count(*) OVER (PARTITION BY seq) AS n, first_value(x) OVER w AS fx, last_value(x) OVER w AS lx, sum(x) OVER (PARTITION BY seq ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM path WINDOW w AS (PARTITION BY seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT seq, ord, round((s+greatest(0,3-ord)*fx+greatest(0,3-(n-ord-1))*lx)/7,4) AS x FROM n""")
def smoothed_positions(df):
    return df.select("seq", "ord", r4(windows.smoothed("x", 3), "x"))


@query("path", "SELECT seq, ord, round(1/(avg(0.01+err/100) OVER (PARTITION BY seq ORDER BY ord ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),4) AS fps FROM path")
def rolling_frame_rate(df):
    return df.withColumn("s", 0.01 + F.col("err") / 100).select("seq", "ord", r4(windows.rolling_rate("s", 30), "fps"))


@query("path", """, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM path)
    SELECT seq, ord, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY seq, g ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM g""")
def failure_runs(df):
    return windows.run_length(df, "failed", "failures").select("seq", "ord", F.col("failures").cast("long").alias("failures"))


@query("path", """, g AS (SELECT *, sum(CASE WHEN is_kf THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM path),
    s AS (SELECT *, CASE WHEN g>0 THEN row_number() OVER (PARTITION BY seq, g ORDER BY ord)-1 END AS since FROM g),
    k AS (SELECT *, first_value(tracked) OVER k AS initial, first_value(err) OVER k AS base, 20+seq%40 AS sx, 25+ord%30 AS sy, 2*greatest(0.0,1-since/15.0) AS slack, least(1.0,(since-15)/100.0) AS gone FROM s WINDOW k AS (PARTITION BY seq, g ORDER BY ord))
    SELECT seq, ord, CAST(since AS BIGINT) AS since, CASE WHEN since>=60 THEN 'max_interval' WHEN since<5 THEN '' WHEN tracked<100 THEN 'low_points' WHEN initial>0 AND tracked<0.4e0*initial AND tracked<300 THEN 'point_drop' WHEN tracked>=10 AND (sx<30 OR sy<30) THEN 'spatial_collapse'
      WHEN err>CASE WHEN base>0 AND base>2+slack THEN base+slack ELSE 2+slack END THEN 'reproj_abs' WHEN base>0 AND since>=15 AND err>base*(1+(1-gone)+0.35e0*gone) THEN 'reproj_growth' ELSE '' END AS reason FROM k""")
def keyframe_rule(df):
    """The rule as a Column: points and error of the last keyframe are the first of its run."""
    since = windows.frames_since(df, "is_kf", "since").withColumn("_g", F.sum(F.col("is_kf").cast("int")).over(windows.of().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("seq", "_g").orderBy("ord")
    since = since.withColumn("initial", F.first("tracked").over(run)).withColumn("base", F.first("err").over(run))
    spread = (F.col("tracked"), 20 + F.col("seq") % 40, 25 + F.col("ord") % 30)
    reason = g.keyframe_reason(F.col("tracked"), F.col("since"), initial=F.col("initial"), error=F.col("err"), baseline=F.col("base"), spread=spread, max_interval=60)
    return since.select("seq", "ord", F.col("since").cast("long").alias("since"), reason.alias("reason"))


@query("path", """, k AS (SELECT seq, ord, CASE WHEN failed THEN NULL ELSE x END AS x FROM path), f AS (SELECT seq, ord, x, last_value(x IGNORE NULLS) OVER b AS lo, first_value(x IGNORE NULLS) OVER a AS hi,
      last_value(CASE WHEN x IS NOT NULL THEN ord END IGNORE NULLS) OVER b AS lo_at, first_value(CASE WHEN x IS NOT NULL THEN ord END IGNORE NULLS) OVER a AS hi_at FROM k
      WINDOW b AS (PARTITION BY seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY seq ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT seq, ord, lo AS carried, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR hi_at=lo_at THEN lo ELSE lo+(hi-lo)*((ord-lo_at)/CAST(hi_at-lo_at AS DOUBLE)) END AS x FROM f""")
def filled_positions(df):
    known = df.withColumn("x", F.when(~F.col("failed"), F.col("x")))
    return known.select("seq", "ord", windows.filled_forward("x").alias("carried"), windows.interpolated("x").alias("x"))


@query("path", """, s AS (SELECT seq, ord, x, y, sum(CASE WHEN is_kf THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM path),
    d AS (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)) AS step FROM s WINDOW w AS (PARTITION BY seq, g ORDER BY ord)),
    m AS (SELECT *, quantile_cont(step, 0.5) OVER h AS med, count(step) OVER h AS n FROM d WINDOW h AS (PARTITION BY seq, g ORDER BY ord ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))
    SELECT seq, ord, NOT coalesce(n>=3 AND step>greatest(20.0, 10*(CASE WHEN med<=0 THEN 2.0 ELSE med END)), false) AS allowed FROM m""")
def jump_guard(df):
    return windows.jump_allowed(df, "x", "y", "is_kf", "allowed").select("seq", "ord", "allowed")


@query("path", """, b AS (SELECT seq, min(ord) AS lo, max(ord) AS hi FROM path WHERE NOT failed GROUP BY seq) SELECT p.seq, p.ord FROM path p JOIN b USING (seq) WHERE p.ord BETWEEN lo AND hi""")
def trimmed_sequences(df):
    return windows.trimmed(df.withColumn("ok", ~F.col("failed")), "ok").select("seq", "ord")


@query("path", """, n AS (SELECT seq, count(*) AS n FROM path GROUP BY seq HAVING count(*)>=4) SELECT seq, s AS start, least(16, n-s) AS frames FROM n, LATERAL (SELECT unnest(generate_series(0, n-4, 5)) AS s)""")
def sliding_samples(df):
    return windows.sliding_samples(df, 16, 5, 4)


@query("path", """, s AS (SELECT seq, ord, sum(CASE WHEN is_kf THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING) - CASE WHEN is_kf THEN 1 ELSE 0 END AS k FROM path) SELECT seq, ord FROM s WHERE k < 3""")
def first_keyframes(df):
    return windows.within_keyframes(df, "is_kf", 3).select("seq", "ord")


@query("path", "SELECT seq, ord FROM path WHERE ord >= 2 AND ord < 60 AND (ord-2) % 3 = 0")
def frame_range(df):
    return df.where("ord >= 2 and ord < 60 and (ord - 2) % 3 = 0").select("seq", "ord")


@query("path", """, n AS (SELECT seq, ord, count(*) OVER (PARTITION BY seq) AS n FROM path) SELECT DISTINCT p.seq, p.ord FROM n p, generate_series(0,4) k(i) WHERE p.ord = CAST(trunc(i*(p.n-1)/4.0) AS BIGINT)""")
def uniform_frames(df):
    n = df.groupBy("seq").agg(F.count("*").alias("n"))
    picked = n.select("seq", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / 4.0))).alias("ord"))
    return df.join(picked.distinct(), ["seq", "ord"], "left_semi").select("seq", "ord")


# --- aggregates ---------------------------------------------------------------------------------------


@query("results", f""", e AS (SELECT *, {_ERR} AS err FROM results)
    SELECT seq, method, count(*) AS frames, count(err) AS with_gt, CAST(count(*) FILTER (WHERE is_keyframe AND success) AS BIGINT) AS keyframes, round(avg(err),4) AS pos_mean, round(quantile_cont(err,0.5),4) AS pos_median, round(stddev_pop(err),4) AS pos_std, round(max(err),4) AS pos_max, round(sqrt(avg(err*err)),4) AS pos_rmse,
      round(100*avg(CASE WHEN err<1 THEN 1.0 WHEN err IS NOT NULL THEN 0.0 END),4) AS recall_1m, round(100*avg(CASE WHEN err<2 THEN 1.0 WHEN err IS NOT NULL THEN 0.0 END),4) AS recall_2m, round(count(*)/sum(seconds),4) AS fps FROM e GROUP BY seq, method""")
def tracking_summary(df):
    errors = df.withColumn("err", g.position_error(["ex", "ey", "ez"], ["gx", "gy", "gz"]))
    recalls = [r4(aggregates.share_below("err", k), f"recall_{k}m") for k in (1, 2)]
    return errors.groupBy("seq", "method").agg(F.count("*").alias("frames"), F.count("err").alias("with_gt"), F.count_if(F.col("is_keyframe") & F.col("success")).alias("keyframes"), *aggregates.error_summary("err", "pos"), *recalls, r4(F.count("*") / F.sum("seconds"), "fps"))


@query("results", f"SELECT coalesce(method,'all') AS method, count(*) AS n, round(avg({_ERR}),4) AS mean, round(min({_ERR}),4) AS least, round(sum(seconds),4) AS seconds FROM results WHERE success GROUP BY ROLLUP(method)")
def method_totals(df):
    errors = df.where("success").withColumn("err", g.position_error(["ex", "ey", "ez"], ["gx", "gy", "gz"]))
    out = errors.rollup("method").agg(F.count("*").alias("n"), r4(F.avg("err"), "mean"), r4(F.min("err"), "least"), r4(F.sum("seconds"), "seconds"))
    return out.withColumn("method", F.coalesce("method", F.lit("all")))


_DEPTH = """avg(abs(gt-pred)/gt) AS abs_rel, avg((gt-pred)*(gt-pred)/gt) AS sq_rel, sqrt(avg((gt-pred)*(gt-pred))) AS rmse, sqrt(avg((ln(greatest(gt,1e-6))-ln(greatest(pred,1e-6)))*(ln(greatest(gt,1e-6))-ln(greatest(pred,1e-6))))) AS rmse_log,
  avg(CASE WHEN greatest(gt/pred,pred/gt)<1.25 THEN 1.0 ELSE 0.0 END) AS delta1, avg(CASE WHEN greatest(gt/pred,pred/gt)<1.5625 THEN 1.0 ELSE 0.0 END) AS delta2, avg(CASE WHEN greatest(gt/pred,pred/gt)<1.953125 THEN 1.0 ELSE 0.0 END) AS delta3"""
_ROUND = ", ".join(f"round({c},4) AS {c}" for c in ("abs_rel", "sq_rel", "rmse", "rmse_log", "delta1", "delta2", "delta3"))


@query("depth", f", m AS (SELECT seq, frame, count(*) AS n, {_DEPTH} FROM depth WHERE gt>10 AND gt<2000 AND pred>0 GROUP BY seq, frame) SELECT seq, frame, n, {_ROUND} FROM m")
def depth_metrics(df):
    return _depth_by_frame(df).select("seq", "frame", "n", *[F.round(c, 4).alias(c) for c in aggregates.depth_metrics(F.col("gt"), F.col("pred"))])


def _depth_by_frame(df):
    valid = df.where("gt > 10 and gt < 2000 and pred > 0")
    return valid.groupBy("seq", "frame").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.depth_metrics(F.col("gt"), F.col("pred")).items()])


@query("depth", f""", s AS (SELECT *, CASE WHEN quantile_cont(pred,0.5) OVER (PARTITION BY seq, frame)>1e-6 THEN quantile_cont(gt,0.5) OVER (PARTITION BY seq, frame)/quantile_cont(pred,0.5) OVER (PARTITION BY seq, frame) ELSE 1 END AS s FROM depth WHERE gt>10 AND gt<2000 AND pred>0),
    d AS (SELECT seq, frame, gt, pred*s AS pred FROM s), m AS (SELECT seq, frame, {_DEPTH} FROM d GROUP BY seq, frame), q AS (SELECT seq, avg(abs_rel) AS abs_rel, avg(rmse) AS rmse FROM m GROUP BY seq)
    SELECT count(*) AS sequences, round(avg(abs_rel),4) AS abs_rel, round(avg(rmse),4) AS rmse FROM q""")
def scaled_depth_macro_mean(df):
    valid = df.where("gt > 10 and gt < 2000 and pred > 0")
    medians = valid.groupBy("seq", "frame").agg(F.percentile("gt", F.lit(0.5)).alias("mg"), F.percentile("pred", F.lit(0.5)).alias("mp"))
    scaled = valid.join(medians, ["seq", "frame"]).withColumn("pred", F.col("pred") * F.when(F.col("mp") > 1e-6, F.col("mg") / F.col("mp")).otherwise(1.0))
    by_seq = _depth_by_frame(scaled).groupBy("seq").agg(F.avg("abs_rel").alias("abs_rel"), F.avg("rmse").alias("rmse"))
    return by_seq.agg(F.count("*").alias("sequences"), r4(F.avg("abs_rel"), "abs_rel"), r4(F.avg("rmse"), "rmse"))


@query("path", f""", s AS (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)) AS xy, {_STEP}*30 AS v FROM path {_W})
    SELECT seq, count(*) AS n, round(sum(xy),3) AS path_m, round((max(x)-min(x))*(max(y)-min(y)),3) AS area, round(max(z)-min(z),4) AS altitude, round(min(v),4) AS v_min, round(max(v),4) AS v_max, round(avg(v),4) AS v_mean, round(stddev_samp(yaw),4) AS yaw_std FROM s GROUP BY seq""")
def trajectory_statistics(df):
    stepped = df.withColumn("xy", windows.step_length(["x", "y"], windows.of())).withColumn("v", windows.step_length(["x", "y", "z"], windows.of()) * 30)
    span = {c: F.max(c) - F.min(c) for c in "xyz"}
    return stepped.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum("xy"), 3).alias("path_m"), F.round(span["x"] * span["y"], 3).alias("area"), r4(span["z"], "altitude"), r4(F.min("v"), "v_min"), r4(F.max("v"), "v_max"), r4(F.avg("v"), "v_mean"), r4(F.stddev_samp("yaw"), "yaw_std"))


@query("path", """, f AS (SELECT seq, x, y, z, x*2+e AS px, y*2-e AS py, z*2 AS pz, ord FROM (SELECT *, (event_id%5)*0.1e0 AS e FROM path) t), o AS (SELECT * FROM f WHERE ord=0)
    , d AS (SELECT f.seq, f.px-o.px AS a, f.py-o.py AS b, f.pz-o.pz AS c, f.x-o.x AS u, f.y-o.y AS v, f.z-o.z AS w FROM f JOIN o USING (seq)) SELECT seq, round(CASE WHEN sum(a*a+b*b+c*c)>1e-12 THEN sum(a*u+b*v+c*w)/sum(a*a+b*b+c*c) ELSE 1 END,6) AS scale FROM d GROUP BY seq""")
def first_frame_scale(df):
    e = (F.col("event_id") % 5) * 0.1
    pred = df.withColumns({"px": F.col("x") * 2 + e, "py": F.col("y") * 2 - e, "pz": F.col("z") * 2})
    return aggregates.first_frame_alignment(pred, ["px", "py", "pz"], ["x", "y", "z"]).select("seq", F.round("scale", 6).alias("scale"))


@query("path", "SELECT seq, count(*) AS n, 2.5 AS scale, CAST(0 AS DOUBLE) AS rmse FROM path GROUP BY seq HAVING count(*) >= 3 AND var_pop(x)+var_pop(y)+var_pop(z) > 0")
def similarity_alignment(df):
    """Predictions are the truth turned by 90 degrees, shrunk and shifted: the alignment must undo that."""
    pred = df.withColumns({"px": -F.col("y") / 2.5 + 7, "py": F.col("x") / 2.5 - 3, "pz": F.col("z") / 2.5})
    found = aggregates.similarity_alignment(pred, ["px", "py", "pz"], ["x", "y", "z"])
    placed = aggregates.aligned(pred, found, ["px", "py", "pz"])
    error = (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 + (F.col("az") - F.col("z")) ** 2
    rmse = placed.groupBy("seq").agg(F.round(F.sqrt(F.avg(error)), 6).alias("rmse"))
    return found.join(rmse, "seq").select("seq", "n", F.round("scale", 6).alias("scale"), "rmse")


@query("matches", """, c AS (SELECT *, CAST(floor(u/8) AS BIGINT) AS cu, CAST(floor(v/8) AS BIGINT) AS cv FROM matches), r AS (SELECT *, row_number() OVER (PARTITION BY frame, cu, cv ORDER BY depth, ord, crop) AS k FROM c)
    SELECT frame, cu AS cell_u, cv AS cell_v, round(depth,4) AS depth FROM r WHERE k=1""")
def nearest_in_cells(df):
    return aggregates.nearest_in_cells(df, ["frame"], "u", "v", "depth", "ord", 8).select("frame", "cell_u", "cell_v", r4(F.col("depth"), "depth"))


@query("matches", "SELECT frame, count(*) AS n, round(quantile_cont(u,0.02),4) AS x_low, round(quantile_cont(u,0.98),4) AS x_high, round(quantile_cont(v,0.02),4) AS y_low, round(quantile_cont(v,0.98),4) AS y_high, round(quantile_cont(u,0.5),4) AS cx, round(quantile_cont(v,0.5),4) AS cy FROM matches GROUP BY frame HAVING count(*) >= 20")
def region_boxes(df):
    boxes = aggregates.spread_box(["frame"], df, "u", "v", 0.02, 0.98).where("n >= 20")
    return boxes.select("frame", "n", *[F.round(c, 4).alias(c) for c in ("x_low", "x_high", "y_low", "y_high", "cx", "cy")])


@query("matches", """, r AS (SELECT *, row_number() OVER (PARTITION BY frame, round_even(u,0), round_even(v,0) ORDER BY crop, ord, gx) AS k FROM matches) SELECT frame, CAST(count(*) AS BIGINT) AS n, round(sum(conf),4) AS conf FROM r WHERE k=1 GROUP BY frame""")
def merged_matches(df):
    first = Window.partitionBy("frame", F.rint("u"), F.rint("v")).orderBy("crop", "ord", "gx")
    kept = df.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.groupBy("frame").agg(F.count("*").alias("n"), r4(F.sum("conf"), "conf"))


@query("matches", """, c AS (SELECT *, count(*) FILTER (WHERE conf>=0.4) OVER (PARTITION BY frame) AS strong FROM matches), k AS (SELECT * FROM c WHERE conf >= CASE WHEN strong>=50 THEN 0.4 ELSE 0.1 END) SELECT frame, count(*) AS n, round(min(conf),2) AS least FROM k GROUP BY frame HAVING count(*) >= 30""")
def adaptive_confidence(df):
    strong = F.count_if(F.col("conf") >= 0.4).over(Window.partitionBy("frame"))
    kept = df.withColumn("strong", strong).where(F.col("conf") >= F.when(F.col("strong") >= 50, 0.4).otherwise(0.1))
    return kept.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.min("conf"), 2).alias("least")).where("n >= 30")


@query("matches", """, m AS (SELECT frame, min(gx) AS lo, max(gx) AS hi FROM matches GROUP BY frame), b AS (SELECT m.frame, least(29, CAST(floor((gx-lo)/((hi-lo)/30)) AS BIGINT)) AS bin FROM matches JOIN m USING (frame) WHERE hi>lo) SELECT frame, bin, count(*) AS n FROM b GROUP BY frame, bin""")
def histograms(df):
    ends = df.groupBy("frame").agg(F.min("gx").alias("lo"), F.max("gx").alias("hi")).where("hi > lo")
    bins = F.least(F.lit(29).cast("long"), F.floor((F.col("gx") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30)))
    return df.join(ends, "frame").groupBy("frame", bins.alias("bin")).agg(F.count("*").alias("n"))


# --- order and sets -----------------------------------------------------------------------------------


@query("matches", ", r AS (SELECT frame, ord, crop, conf, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, ord, crop) AS k FROM matches) SELECT frame, ord, crop, CAST(k AS BIGINT) AS k FROM r WHERE k <= 25")
def strongest_matches(df):
    w = Window.partitionBy("frame").orderBy(F.desc("conf"), "ord", "crop")
    return df.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 25").select("frame", "ord", "crop", "k")


@query("matches", ", s AS (SELECT frame, crop, quantile_cont(conf,0.5) AS med, max(conf) AS top FROM matches GROUP BY frame, crop), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY med DESC, top DESC, crop) AS k FROM s) SELECT frame, crop, round(med,4) AS median FROM r WHERE k=1")
def best_tile(df):
    scores = df.groupBy("frame", "crop").agg(F.percentile("conf", F.lit(0.5)).alias("med"), F.max("conf").alias("top"))
    best = scores.groupBy("frame").agg(F.max_by(F.struct("crop", "med"), F.struct("med", "top", -F.col("crop"))).alias("b"))
    return best.select("frame", F.col("b.crop").alias("crop"), r4(F.col("b.med"), "median"))


@query("results", "SELECT frame_id FROM results WHERE success INTERSECT SELECT frame_id FROM results WHERE is_keyframe")
def successful_keyframes(df):
    return df.where("success").select("frame_id").intersect(df.where("is_keyframe").select("frame_id"))


@query("results", "SELECT seq FROM results WHERE method='O' UNION SELECT seq FROM results WHERE method='P'")
def sequence_union(df):
    return df.where("method = 'O'").select("seq").union(df.where("method = 'P'").select("seq")).distinct()


# --- joins --------------------------------------------------------------------------------------------


@query("boxes tiles", "SELECT box, tile FROM boxes b JOIN tiles t ON b.minx<=t.maxx AND b.maxx>=t.minx AND b.miny<=t.maxy AND b.maxy>=t.miny")
def boxes_touching_tiles(boxes, tiles):
    return joins.overlapping(boxes, tiles, "box", "tile", 100.0, closed=True)


@query("boxes tiles", "SELECT box, tile FROM boxes b JOIN tiles t ON b.minx<t.maxx AND b.maxx>t.minx AND b.miny<t.maxy AND b.maxy>t.miny")
def boxes_inside_tiles(boxes, tiles):
    return joins.overlapping(boxes, tiles, "box", "tile", 100.0, closed=False)


@query("boxes", "SELECT box, x*100.0 AS east, y*100.0 AS north FROM boxes, LATERAL (SELECT unnest(generate_series(CAST(floor(minx/100) AS BIGINT), CAST(floor(maxx/100) AS BIGINT))) AS x), LATERAL (SELECT unnest(generate_series(CAST(floor(miny/100) AS BIGINT), CAST(floor(maxy/100) AS BIGINT))) AS y)")
def discovered_tiles(boxes):
    return joins.covering_cells(boxes, "box", 100.0)


@query("path", """, s AS (SELECT seq, ord AS sid, t+((event_id%3)-1)*0.02e0 AS st FROM path WHERE ord%3=0), n AS (SELECT p.seq, p.ord, s.sid, row_number() OVER (PARTITION BY p.seq, p.ord ORDER BY abs(p.t-s.st), s.sid) AS k FROM path p JOIN s ON p.seq=s.seq AND abs(p.t-s.st)<=0.06e0)
    SELECT p.seq, p.ord, n.sid FROM path p LEFT JOIN n ON p.seq=n.seq AND p.ord=n.ord AND n.k=1""")
def nearest_timestamps(df):
    samples = df.where("ord % 3 = 0").select("seq", F.col("ord").alias("sid"), (F.col("t") + ((F.col("event_id") % 3) - 1) * 0.02).alias("st"))
    return joins.nearest_in_time(df.select("seq", "ord", "t"), samples, ["seq"], "t", "st", 0.06, "sid", row_key=["seq", "ord"]).select("seq", "ord", "sid")


@query("results", """, g AS (SELECT frame_id, max(gx) AS gx FROM results WHERE gx IS NOT NULL AND frame_id%3<>0 GROUP BY frame_id) SELECT r.frame_id, g.gx IS NOT NULL AS valid, coalesce(g.gx,0) AS gx FROM results r LEFT JOIN g USING (frame_id)""")
def ground_truth_join(df):
    gt = df.where("gx is not null and frame_id % 3 <> 0").groupBy("frame_id").agg(F.max("gx").alias("g"))
    return df.join(gt, "frame_id", "left").select("frame_id", F.col("g").isNotNull().alias("valid"), F.coalesce("g", F.lit(0.0)).alias("gx"))


@query("matches", "SELECT o.frame, o.ord, o.crop FROM matches o WHERE o.crop>1 AND NOT EXISTS (SELECT 1 FROM matches n WHERE n.crop=1 AND n.frame=o.frame AND (n.u-o.u)*(n.u-o.u)+(n.v-o.v)*(n.v-o.v)<=9)")
def surviving_points(df):
    return joins.apart_from(df.where("crop > 1"), df.where("crop = 1"), ["frame"], 3.0).select("frame", "ord", "crop")


@query("matches", """, s AS (SELECT frame, crop, CAST(floor(v/30) AS BIGINT) AS cell, max(conf+ord/1e7) AS s FROM matches GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame, crop ORDER BY s DESC, cell) AS rb, row_number() OVER (PARTITION BY frame, cell ORDER BY s DESC, crop) AS ra FROM s) SELECT frame, crop, cell FROM r WHERE ra=1 AND rb=1""")
def mutual_best_matches(df):
    scores = df.groupBy("frame", "crop", F.floor(F.col("v") / 30).alias("cell")).agg(F.max(F.col("conf") + F.col("ord") / 1e7).alias("s"))
    return joins.mutual_best(scores, "crop", "cell", "s", ["frame"]).select("frame", "crop", "cell")


@query("matches", """, r AS (SELECT frame, crop, ord, depth+ord/1e7 AS d, row_number() OVER (PARTITION BY frame, crop ORDER BY depth+ord/1e7, ord) AS k, lead(depth+ord/1e7) OVER (PARTITION BY frame, crop ORDER BY depth+ord/1e7, ord) AS s FROM matches) SELECT frame, crop, ord FROM r WHERE k=1 AND d<0.75*s""")
def ratio_test(df):
    return joins.ratio_test(df.withColumn("d", F.col("depth") + F.col("ord") / 1e7), "crop", "ord", "d", ["frame"]).select("frame", "crop", "ord")


# --- rasters ------------------------------------------------------------------------------------------


@query("matches dsm", """, p AS (SELECT frame, ord, crop, u/8 AS c, v/8 AS r FROM matches), k AS (SELECT *, CAST(floor(c) AS BIGINT) AS c0, CAST(floor(r) AS BIGINT) AS r0 FROM p)
    SELECT k.frame, k.ord, k.crop, (CASE WHEN a.z IS NOT NULL AND b.z IS NOT NULL AND d.z IS NOT NULL AND e.z IS NOT NULL THEN a.z*(1-(c-c0))*(1-(r-r0))+b.z*(c-c0)*(1-(r-r0))+d.z*(1-(c-c0))*(r-r0)+e.z*(c-c0)*(r-r0) ELSE n.z END) AS z FROM k
      LEFT JOIN dsm a ON a.col=c0 AND a.row=r0 LEFT JOIN dsm b ON b.col=c0+1 AND b.row=r0 LEFT JOIN dsm d ON d.col=c0 AND d.row=r0+1 LEFT JOIN dsm e ON e.col=c0+1 AND e.row=r0+1 LEFT JOIN dsm n ON n.col=CAST(round_even(c,0) AS BIGINT) AND n.row=CAST(round_even(r,0) AS BIGINT)""")
def sampled_heights(points, dsm):
    placed = points.select("frame", "ord", "crop", (F.col("u") / 8).alias("c"), (F.col("v") / 8).alias("r"))
    return raster.sampled(placed, dsm, "c", "r", "z", key=["frame", "ord", "crop"])


@query("dsm", ", s AS (SELECT max(row) AS h, max(col) AS w FROM dsm) SELECT CAST(floor(row/4) AS BIGINT) AS row, CAST(floor(col/4) AS BIGINT) AS col, round(max(z),4) AS z FROM dsm, s WHERE row<floor((h+1)/4)*4 AND col<floor((w+1)/4)*4 GROUP BY 1,2")
def pooled_heights(dsm):
    return raster.pooled(dsm, 4, F.max).select("row", "col", r4(F.col("z"), "z"))


@query("dsm", "SELECT r AS wr, c AS wc, round(coalesce(z,-9999),4) AS z FROM generate_series(0,19) a(r), generate_series(0,24) b(c) LEFT JOIN dsm ON row=r+30 AND col=c+30")
def padded_window(dsm):
    return raster.window(dsm, 30, 30, 20, 25, -9999.0).select("wr", "wc", r4(F.col("z"), "z"))


@query("dsm", """, n AS (SELECT o.row, o.col, (e.z-w.z)/2 AS dx, (s.z-t.z)/2 AS dy FROM dsm o JOIN dsm e ON e.row=o.row AND e.col=o.col+1 JOIN dsm w ON w.row=o.row AND w.col=o.col-1 JOIN dsm s ON s.row=o.row+1 AND s.col=o.col JOIN dsm t ON t.row=o.row-1 AND t.col=o.col)
    SELECT row, col, round(-dx/sqrt(dx*dx+dy*dy+1),4)+0e0 AS nx, round(-dy/sqrt(dx*dx+dy*dy+1),4)+0e0 AS ny, round(1/sqrt(dx*dx+dy*dy+1),4) AS nz FROM n""")
def surface_normals(dsm):
    return raster.normals(dsm).select("row", "col", *[(F.round(c, 4) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query("dsm", ", t AS (SELECT CAST(floor(row/3) AS BIGINT) AS r, col AS c, row AS tile, z FROM dsm WHERE z > 95) SELECT r, c, round(arg_min(z,tile),4) AS first_z, round(arg_max(z,tile),4) AS last_z FROM t GROUP BY r, c")
def mosaics(dsm):
    tiles = dsm.select(F.floor(F.col("row") / 3).alias("r"), F.col("col").alias("c"), F.col("row").alias("tile"), "z")
    first = raster.first_tile(tiles, ["r", "c"], "z", "tile", F.col("z") > 95).withColumnRenamed("z", "f")
    last = raster.last_tile(tiles, ["r", "c"], "z", "tile", F.col("z") > 95)
    return first.join(last, ["r", "c"]).select("r", "c", r4(F.col("f"), "first_z"), r4(F.col("z"), "last_z"))


# --- meshes -------------------------------------------------------------------------------------------


@query("faces vertices", """, g AS (SELECT f.f, (p.x+q.x+s.x)/3 AS cx, (q.y-p.y)*(s.z-p.z)-(q.z-p.z)*(s.y-p.y) AS nx, (q.z-p.z)*(s.x-p.x)-(q.x-p.x)*(s.z-p.z) AS ny, (q.x-p.x)*(s.y-p.y)-(q.y-p.y)*(s.x-p.x) AS nz FROM faces f JOIN vertices p ON p.v=f.a JOIN vertices q ON q.v=f.b JOIN vertices s ON s.v=f.c)
    SELECT f, round(cx,4) AS cx, round(sqrt(nx*nx+ny*ny+nz*nz)/2,3) AS area, round(CASE WHEN sqrt(nx*nx+ny*ny+nz*nz)>0 THEN nz/sqrt(nx*nx+ny*ny+nz*nz) ELSE 0 END,4)+0e0 AS nz FROM g""")
def face_geometry(faces, vertices):
    return mesh.face_geometry(faces, vertices).select("f", r4(F.col("cx"), "cx"), F.round("area", 3).alias("area"), (F.round("nz", 4) + 0.0).alias("nz"))


@query("faces", "SELECT least(a,b) AS low, greatest(a,b) AS high FROM faces UNION SELECT least(b,c), greatest(b,c) FROM faces UNION SELECT least(a,c), greatest(a,c) FROM faces")
def mesh_edges(faces):
    return mesh.edges(faces)


@query("boxes", """, RECURSIVE_LINKS AS (SELECT a.box AS a, b.box AS b FROM boxes a JOIN boxes b ON a.box<b.box AND a.minx<=b.maxx AND a.maxx>=b.minx AND a.miny<=b.maxy AND a.maxy>=b.miny), l AS (SELECT a, b FROM RECURSIVE_LINKS UNION ALL SELECT b, a FROM RECURSIVE_LINKS),
    walk AS (SELECT a AS node, a AS reach FROM l UNION SELECT w.node, l.b FROM walk w JOIN l ON l.a=w.reach) SELECT node, min(reach) AS component FROM walk GROUP BY node""")
def merged_buildings(boxes):
    """Buildings are boxes that touch, directly or through others."""
    return mesh.components(joins.touching(boxes, "box", 100.0))
