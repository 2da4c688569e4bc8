"""Queries of cameras, poses, images and point maps, each with its SQL."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cameras as cam
from ..functions import geometry as g
from ..operators import aggregates, joins, mesh, quantiles, raster, windows
from ..scratch import saved
from .queries import query

WIDTH, HEIGHT, FOCAL = 640.0, 480.0, 500.0
#: The colour of the sky in blue, green and red, and how near to it a pixel counts as sky.
SKY_BGR, SKY_NEAR, SKY_SHARE, BLACK = (235, 206, 135), 20, 0.9, 1.0

_RAYS = "c(k, u, v) AS (VALUES (1, 0e0, 0e0), (2, 640e0, 0e0), (3, 640e0, 480e0), (4, 0e0, 480e0), (5, 320e0, 240e0)), r AS (SELECT *, m0*((u-320)/500)+m1*((v-240)/500)+m2 AS dx, m3*((u-320)/500)+m4*((v-240)/500)+m5 AS dy, m6*((u-320)/500)+m7*((v-240)/500)+m8 AS dz FROM cameras, c)"


def _camera(df: DataFrame) -> tuple[Column, list[Column], list[Column]]:
    """Rotation, centre and fx, fy, cx, cy of the rows of ``cameras``."""
    return F.array(*[F.col(f"m{k}") for k in range(9)]), [F.col(c) for c in "xyz"], [F.lit(v) for v in (FOCAL, FOCAL, WIDTH / 2, HEIGHT / 2)]


# --- cameras ------------------------------------------------------------------------------------------


@query("cameras", f""", {_RAYS}, n AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS l FROM r), p AS (SELECT *, -z/(dz/l) AS t FROM n WHERE abs(dz/l)>=1e-6), h AS (SELECT cam, x+least(t,1000)*dx/l AS hx, y+least(t,1000)*dy/l AS hy FROM p WHERE t>=0),
    b AS (SELECT cam, min(hx) AS x0, min(hy) AS y0, max(hx) AS x1, max(hy) AS y1 FROM h GROUP BY cam) SELECT cam, coalesce(x0,x-100) AS minx, coalesce(y0,y-100) AS miny, coalesce(x1,x+100) AS maxx, coalesce(y1,y+100) AS maxy FROM cameras LEFT JOIN b USING (cam)""")
def visible_footprints(df):
    m, centre, k = _camera(df)
    box = cam.footprint_box(m, centre, F.lit(WIDTH), F.lit(HEIGHT), k, F.lit(0.0))
    return df.select("cam", *[c.alias(n) for c, n in zip(box, ("minx", "miny", "maxx", "maxy"), strict=True)])


@query("cameras", f""", {_RAYS}, t AS (SELECT *, sqrt(dx*dx+dy*dy) AS flat, CASE WHEN abs(dz)>1e-6 THEN (5-z)/dz ELSE -1 END AS t FROM r WHERE k<=4), f AS (SELECT *, CASE WHEN t<=0 OR t*flat>2000 THEN 2000/flat ELSE t END AS far FROM t)
    SELECT cam, CAST(k AS INTEGER) AS corner, x+far*dx AS px, y+far*dy AS py FROM f""")
def ground_frustums(df):
    m, centre, k = _camera(df)
    corners = cam.frustum_corners(m, centre, F.lit(WIDTH), F.lit(HEIGHT), k, F.lit(5.0))
    return df.select("cam", F.inline(F.array(*[F.struct(F.lit(i).alias("corner"), x.alias("px"), y.alias("py")) for i, (x, y) in enumerate(corners, 1)])))


@query("cameras", """, a AS (SELECT *, CASE WHEN sqrt(m2*m2+m5*m5)>=1e-6 THEN m2/sqrt(m2*m2+m5*m5) ELSE m0/sqrt(m0*m0+m3*m3) END AS fx, CASE WHEN sqrt(m2*m2+m5*m5)>=1e-6 THEN m5/sqrt(m2*m2+m5*m5) ELSE m3/sqrt(m0*m0+m3*m3) END AS fy FROM cameras)
    SELECT cam, x AS tx, y AS ty, x+5*fx-3*fy AS lx, y+5*fy+3*fx AS ly, x+5*fx+3*fy AS rx, y+5*fy-3*fx AS ry FROM a""")
def camera_triangles(df):
    m, centre, _ = _camera(df)
    points = cam.camera_triangle(m, centre, 5.0)
    return df.select("cam", *[c.alias(f"{p}{a}") for p, point in zip("tlr", points, strict=True) for a, c in zip("xy", point, strict=True)])


@query("cameras", f""", {_RAYS}, u AS (SELECT *, CASE WHEN cam%7=0 THEN 200 WHEN cam%7=1 THEN 200 ELSE greatest(z-cam%20,10) END AS up FROM r WHERE k<=4)
    SELECT cam, least(greatest(2.5*max(CASE WHEN dz>=-1e-6 THEN 10*up ELSE up/(-dz)*sqrt(dx*dx+dy*dy) END),100),8000) AS region FROM u GROUP BY cam""")
def ground_regions(df):
    m, centre, k = _camera(df)
    ground = F.when(F.col("cam") % 7 == 1, -500.0).when(F.col("cam") % 7 > 1, (F.col("cam") % 20).cast("double"))
    return df.select("cam", cam.ground_region(m, centre, F.lit(WIDTH), F.lit(HEIGHT), k, ground).alias("region"))


@query("cameras", """, p(r, c) AS (SELECT a.i, b.i FROM generate_series(0,2) a(i), generate_series(0,3) b(i)), d AS (SELECT cam, r, c, m0*((c*200-320)/500e0)+m1*((r*200-240)/500e0)+m2 AS dx, m3*((c*200-320)/500e0)+m4*((r*200-240)/500e0)+m5 AS dy, m6*((c*200-320)/500e0)+m7*((r*200-240)/500e0)+m8 AS dz FROM cameras, p)
    SELECT cam, r AS row, c AS col, dx/sqrt(dx*dx+dy*dy+dz*dz) AS dx, dy/sqrt(dx*dx+dy*dy+dz*dz) AS dy, dz/sqrt(dx*dx+dy*dy+dz*dz) AS dz FROM d""")
def view_rays(df):
    """Unit directions of a grid of pixels of each camera."""
    m, _, k = _camera(df)
    grid = df.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    ray = cam.unit(cam.pixel_ray(F.col("col") * 200.0, F.col("row") * 200.0, m, *k))
    return grid.select("cam", "row", "col", *[c.alias(n) for c, n in zip(ray, ("dx", "dy", "dz"), strict=True)])


@query("matches", """, p AS (SELECT *, CASE WHEN ord%13=0 THEN 0 ELSE depth END AS d FROM matches) SELECT frame, crop, ord, CASE WHEN d>0 THEN 10-d*((v-110)/90e0) ELSE 0 END AS x, CASE WHEN d>0 THEN 20+d*((u-150)/80e0) ELSE 0 END AS y, CASE WHEN d>0 THEN 30+d ELSE 0 END AS z FROM p""")
def depth_points(df):
    turn = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    depth = F.when(F.col("ord") % 13 == 0, 0.0).otherwise(F.col("depth"))
    point = cam.unprojected(F.col("u"), F.col("v"), depth, turn, [F.lit(10.0), F.lit(20.0), F.lit(30.0)], F.lit(80.0), F.lit(90.0), F.lit(150.0), F.lit(110.0))
    return df.select("frame", "crop", "ord", *[c.alias(n) for c, n in zip(point, "xyz", strict=True)])


@query("matches", """, e AS (SELECT frame, sqrt((100*(u/50)/(5+depth/10)+150-u)*(100*(u/50)/(5+depth/10)+150-u)+(100*(v/50)/(5+depth/10)+110-v)*(100*(v/50)/(5+depth/10)+110-v)) AS e FROM matches WHERE conf>0.3) SELECT frame, count(*) AS points, avg(e) AS error FROM e GROUP BY frame""")
def reprojection_errors(df):
    """Mean distance in pixels of projected points from where they were seen, over the confident ones of a frame."""
    still = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    u, v, _ = g.project([F.col("u") / 50, F.col("v") / 50, 5 + F.col("depth") / 10], still, [F.lit(0.0)] * 3, F.lit(100.0), F.lit(100.0), F.lit(150.0), F.lit(110.0))
    seen = df.where("conf > 0.3").select("frame", u.alias("pu"), v.alias("pv"), "u", "v").where("pu is not null")
    return seen.groupBy("frame").agg(F.count("*").alias("points"), F.avg(g.position_error(["pu", "pv"], ["u", "v"])).alias("error"))


@query("cameras", "SELECT cam, x-(m0*100+m3*200+m6*50) AS tx, y-(m1*100+m4*200+m7*50) AS ty, z-(m2*100+m5*200+m8*50) AS tz FROM cameras")
def local_translations(df):
    """Translations for vertices that are stored without their offset."""
    w2c = F.array(*[F.col(f"m{3 * c + r}") for r in range(3) for c in range(3)])
    t = cam.shifted_translation(w2c, [F.col(c) for c in "xyz"], [F.lit(-100.0), F.lit(-200.0), F.lit(-50.0)])
    return df.select("cam", *[c.alias(f"t{n}") for c, n in zip(t, "xyz", strict=True)])


@query("places", """, r AS (SELECT place, radians(lat) AS p, radians(lon) AS l, radians(place%360) AS a, radians((place*7)%180-90) AS b, radians((place*13)%360) AS c FROM places),
    e AS (SELECT *, cos(b)*cos(c) AS m0, -cos(b)*sin(c) AS m1, sin(b) AS m2, cos(a)*sin(c)+sin(a)*sin(b)*cos(c) AS m3, cos(a)*cos(c)-sin(a)*sin(b)*sin(c) AS m4, -sin(a)*cos(b) AS m5, sin(a)*sin(c)-cos(a)*sin(b)*cos(c) AS m6, sin(a)*cos(c)+cos(a)*sin(b)*sin(c) AS m7, cos(a)*cos(b) AS m8 FROM r)
    SELECT place, round(-sin(l)*m0+cos(l)*m3,6) AS r00, round(-sin(p)*cos(l)*m1-sin(p)*sin(l)*m4+cos(p)*m7,6) AS r11, round(cos(p)*cos(l)*m2+cos(p)*sin(l)*m5+sin(p)*m8,6) AS r22, round(-sin(p)*cos(l)*m2-sin(p)*sin(l)*m5+cos(p)*m8,6) AS r12 FROM e""")
def local_rotations(df):
    """Rotations given in earth-centred axes, turned to east, north and up where the camera is."""
    x, y, z = g.ecef(F.col("lat"), F.col("lon"), F.col("height"))
    m = cam.euler_matrix((F.col("place") % 360).cast("double"), ((F.col("place") * 7) % 180 - 90).cast("double"), ((F.col("place") * 13) % 360).cast("double"))
    turned = df.select("place", m.alias("m"), x.alias("x"), y.alias("y"), z.alias("z")).withColumn("r", cam.local_rotation(F.col("m"), F.col("x"), F.col("y"), F.col("z")))
    return turned.select("place", *[F.round(F.col("r")[k], 6).alias(n) for k, n in ((0, "r00"), (4, "r11"), (8, "r22"), (5, "r12"))])


@query("quats", """, n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS i, vec_id%3=0 AS known, qw/s AS w, qx/s AS x, qy/s AS y, qz/s AS z FROM (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS s FROM quats) t WHERE s>0),
    k AS (SELECT *, CASE WHEN known THEN {'i': i, 'w': w, 'x': x, 'y': y, 'z': z} END AS q FROM n), f AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY label ORDER BY i) AS a, first_value(q IGNORE NULLS) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k),
    g AS (SELECT vec_id, i, coalesce(a, b) AS a, coalesce(b, a) AS b FROM f), d AS (SELECT *, a.w*b.w+a.x*b.x+a.y*b.y+a.z*b.z AS dot, CASE WHEN b.i>a.i THEN (i-a.i)/CAST(b.i-a.i AS DOUBLE) ELSE 0 END AS s FROM g WHERE a IS NOT NULL),
    h AS (SELECT *, acos(least(abs(dot),1.0)) AS o FROM d), w AS (SELECT *, CASE WHEN sin(o)<1e-9 THEN 1-s ELSE sin((1-s)*o)/sin(o) END AS p, CASE WHEN dot<0 THEN -1 ELSE 1 END*CASE WHEN sin(o)<1e-9 THEN s ELSE sin(s*o)/sin(o) END AS r FROM h)
    SELECT vec_id, round((p*a.w+r*b.w)*(p*a.w+r*b.w),6) AS ww, round((p*a.x+r*b.x)*(p*a.y+r*b.y),6) AS xy, round((p*a.z+r*b.z)*(p*a.z+r*b.z),6) AS zz FROM w""")
def interpolated_rotations(df):
    """Rotations of frames without one, on the way from the known one before to the one after; the nearest beyond the ends."""
    order, size = Window.partitionBy("label").orderBy("vec_id"), F.sqrt(sum((F.col(f"q{c}") * F.col(f"q{c}") for c in "xyz"), F.col("qw") * F.col("qw")))
    unit = df.withColumn("s", size).where("s > 0").select("vec_id", "label", *[(F.col(f"q{c}") / F.col("s")).alias(c) for c in "wxyz"]).withColumn("i", F.row_number().over(order) - 1)
    known = unit.withColumn("q", F.when(F.col("vec_id") % 3 == 0, F.struct("i", "w", "x", "y", "z")))
    before = F.last("q", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("q", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    ends = known.select("vec_id", "i", before.alias("a"), after.alias("b")).select("vec_id", "i", F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a is not null")
    share = F.when(F.col("b.i") > F.col("a.i"), (F.col("i") - F.col("a.i")) / (F.col("b.i") - F.col("a.i"))).otherwise(0.0)
    w, x, y, z = cam.slerp([F.col(f"a.{c}") for c in "wxyz"], [F.col(f"b.{c}") for c in "wxyz"], share)
    return ends.select("vec_id", F.round(w * w, 6).alias("ww"), F.round(x * y, 6).alias("xy"), F.round(z * z, 6).alias("zz"))


@query("path", """, f AS (SELECT seq, ord, x AS gx, y AS gy, z AS gz, x+(event_id%5)*0.1e0 AS ex, y-(event_id%3)*0.2e0 AS ey, z*1.01e0 AS ez, radians(yaw) AS yaw FROM path), p AS (SELECT *, -ey/2 AS px, ex/2 AS py, ez/2 AS pz FROM f), o AS (SELECT seq, gx AS gx0, gy AS gy0, gz AS gz0, px AS px0, py AS py0, pz AS pz0 FROM p WHERE ord=0),
    m AS (SELECT p.*, o.*, (py-py0) AS mx, -(px-px0) AS my, (pz-pz0) AS mz FROM p JOIN o ON p.seq=o.seq), s AS (SELECT seq, CASE WHEN sum(mx*mx+my*my+mz*mz)>1e-12 THEN sum(mx*(gx-gx0)+my*(gy-gy0)+mz*(gz-gz0))/sum(mx*mx+my*my+mz*mz) ELSE 1 END AS s FROM m GROUP BY seq),
    e AS (SELECT m.seq, s.s, sqrt((gx0+mx-gx)*(gx0+mx-gx)+(gy0+my-gy)*(gy0+my-gy)+(gz0+mz-gz)*(gz0+mz-gz)) AS e1, sqrt((gx0+s.s*mx-gx)*(gx0+s.s*mx-gx)+(gy0+s.s*my-gy)*(gy0+s.s*my-gy)+(gz0+s.s*mz-gz)*(gz0+s.s*mz-gz)) AS es FROM m JOIN s ON m.seq=s.seq)
    SELECT seq, count(*) AS n, max(s) AS scale, avg(e1) AS mean_metric, max(e1) AS max_metric, sqrt(avg(e1*e1)) AS rmse_metric, avg(es) AS mean_scaled, sqrt(avg(es*es)) AS rmse_scaled, 100*avg(CASE WHEN es<5 THEN 1.0 ELSE 0.0 END) AS recall_5m FROM e GROUP BY seq""")
def anchored_trajectories(df):
    """Drift once the first pose is the truth's, with the scale as it is and with a fitted one."""
    e = F.col("event_id")
    est = {"ex": F.col("x") + (e % 5) * 0.1, "ey": F.col("y") - (e % 3) * 0.2, "ez": F.col("z") * 1.01}
    c, s = F.cos(F.radians("yaw")), F.sin(F.radians("yaw"))
    frames = df.withColumns(est).withColumns({"px": -F.col("ey") / 2, "py": F.col("ex") / 2, "pz": F.col("ez") / 2})
    frames = frames.withColumn("rg", F.array(c, -s, F.lit(0.0), s, c, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    frames = frames.withColumn("rp", F.array(-s, -c, F.lit(0.0), c, -s, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))  # the truth's turned by 90 degrees
    out = None
    for with_scale, name in ((False, "metric"), (True, "scaled")):
        placed = aggregates.anchored(frames, ["px", "py", "pz"], ["x", "y", "z"], "rp", "rg", with_scale).withColumn("e", g.position_error(["ax", "ay", "az"], ["x", "y", "z"]))
        sums = [F.avg("e").alias(f"mean_{name}"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias(f"rmse_{name}")]
        sums += [F.max("scale").alias("scale"), F.count("*").alias("n"), (100 * F.avg((F.col("e") < 5).cast("double"))).alias("recall_5m")] if with_scale else [F.max("e").alias("max_metric")]
        found = placed.groupBy("seq").agg(*sums)
        out = found if out is None else out.join(found, "seq")
    return out


# --- joins by place and name ----------------------------------------------------------------------------


@query("path", """, k AS (SELECT seq, ord, CASE WHEN NOT failed THEN x END AS x FROM path) SELECT seq, ord, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY seq ORDER BY ord), first_value(x IGNORE NULLS) OVER (PARTITION BY seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS x FROM k""")
def carried_poses(df):
    """Requested frames with the pose of the last tracked one; those before the first tracked one have its pose."""
    sparse = df.where(~F.col("failed")).select("seq", "ord", F.col("x").alias("known"))
    whole = Window.partitionBy("seq").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = df.select("seq", "ord").join(sparse, ["seq", "ord"], "left")
    return found.select("seq", "ord", F.coalesce(windows.filled_forward("known"), F.first("known", ignorenulls=True).over(whole), F.lit(0.0)).alias("x"))


@query("boxes", """, f AS (SELECT row_number() OVER (ORDER BY box)-1 AS pos, 'seq/frame_'||lpad(CAST((box*10)%7000 AS VARCHAR),4,'0')||'.png' AS name FROM boxes), m AS (SELECT CAST(regexp_extract(name, '(\\d+)[^/]*$', 1) AS BIGINT) AS num, max(pos) AS pos FROM f GROUP BY 1)
    SELECT b.box, m.pos FROM boxes b JOIN m ON m.num=b.box*3""")
def remapped_frames(df):
    """Frame numbers in file names, back to the places of the files; of files with one number the last counts."""
    place = F.row_number().over(Window.orderBy("box")) - 1  # one task: a row for each file name of one folder
    name = F.concat(F.lit("seq/frame_"), F.lpad(((F.col("box") * 10) % 7000).cast("string"), 4, "0"), F.lit(".png"))
    files = df.select(place.cast("long").alias("pos"), cam.first_number(name).alias("num")).groupBy("num").agg(F.max("pos").alias("pos"))
    return df.select("box", (F.col("box") * 3).alias("num")).join(files, "num").select("box", "pos")


@query("path", """, a AS (SELECT seq, ord, event_id, row_number() OVER (PARTITION BY seq ORDER BY ord) AS k FROM path WHERE ord%2=0), b AS (SELECT seq, ord AS file, row_number() OVER (PARTITION BY seq ORDER BY ord DESC) AS k FROM path WHERE NOT failed) SELECT a.seq, a.ord, b.file FROM a JOIN b ON a.seq=b.seq AND a.k=b.k""")
def paired_by_place(df):
    """Frames and files joined by their places in their sequence, as far as the shorter one goes."""
    frames = df.where("ord % 2 = 0").select("seq", "ord", F.row_number().over(Window.partitionBy("seq").orderBy("ord")).alias("k"))
    files = df.where(~F.col("failed")).select("seq", F.col("ord").alias("file"), F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("ord"))).alias("k"))
    return frames.join(files, ["seq", "k"]).select("seq", "ord", "file")


@query("tiles path", """, b AS (SELECT seq, min(x)-800 AS x0, max(x)+800 AS x1, min(y)-800 AS y0, max(y)+800 AS y1 FROM path GROUP BY seq), n AS (SELECT tile, CAST(floor(minx/100) AS BIGINT)||'_'||CAST(floor(miny/100) AS BIGINT)||'_-002' AS name FROM tiles),
    p AS (SELECT name, CAST(split_part(name,'_',1) AS BIGINT)*100e0 AS e, CAST(split_part(name,'_',2) AS BIGINT)*100e0 AS n FROM n) SELECT DISTINCT seq, name FROM b JOIN p ON e<=x1 AND e+400>=x0 AND n<=y1 AND n+400>=y0""")
def mesh_folders(tiles, df):
    """Folders of mesh tiles, named by their corner in hectometres, that a trajectory comes within 800 metres of."""
    km = lambda c: F.floor(F.col(c) / 100).cast("string")
    names = tiles.select(F.concat(km("minx"), F.lit("_"), km("miny"), F.lit("_-002")).alias("name")).distinct()
    at = [F.regexp_extract("name", r"^(\d+)_(\d+)_", k).cast("long") * 100.0 for k in (1, 2)]
    boxes = names.where(F.col("name").rlike(r"^\d+_\d+_")).select("name", at[0].alias("minx"), at[1].alias("miny"), (at[0] + 400).alias("maxx"), (at[1] + 400).alias("maxy"))
    around = df.groupBy("seq").agg((F.min("x") - 800).alias("minx"), (F.min("y") - 800).alias("miny"), (F.max("x") + 800).alias("maxx"), (F.max("y") + 800).alias("maxy"))
    return joins.overlapping(around, boxes, "seq", "name", 1000.0)


@query("tiles boxes", """, b AS (SELECT box%10 AS level, avg(minx) AS px, avg(miny) AS py FROM boxes GROUP BY 1) SELECT tile, CAST(row_number() OVER (PARTITION BY tile%10 ORDER BY (minx-px)*(minx-px)+(miny-py)*(miny-py), tile) AS BIGINT) AS place FROM tiles JOIN b ON b.level=tile%10""")
def tiles_by_proximity(tiles, boxes):
    """Tiles of a level in the order of their distance from the best centre of the level before."""
    best = boxes.groupBy((F.col("box") % 10).alias("level")).agg(F.avg("minx").alias("bx"), F.avg("miny").alias("by"))
    near = (F.col("minx") - F.col("bx")) * (F.col("minx") - F.col("bx")) + (F.col("miny") - F.col("by")) * (F.col("miny") - F.col("by"))
    placed = tiles.withColumn("level", F.col("tile") % 10).join(best, "level")
    return placed.select("tile", F.row_number().over(Window.partitionBy("level").orderBy(near, "tile")).cast("long").alias("place"))


@query("boxes", "SELECT box, CASE WHEN box%3=0 THEN NULL ELSE 'als_33'||CAST(floor(minx/1000) AS BIGINT)||'-'||CAST(floor(miny/1000) AS BIGINT) END AS als, (((box%21)-10)/10e0+1)/2*640 AS u FROM boxes")
def neighbour_tile_names(df):
    """Names of one region's tiles in the other's convention, and pixels of normalised coordinates."""
    tile = F.when(F.col("box") % 3 == 0, F.lit("readme")).otherwise(g.tile_id(F.col("minx"), F.col("miny"), "als"))
    return df.select("box", cam.neighbour_als_id(tile).alias("als"), cam.normalised_to_pixel(((F.col("box") % 21) - 10) / 10, F.lit(WIDTH)).alias("u"))


# --- filters ------------------------------------------------------------------------------------------


@query("matches dsm", """, p AS (SELECT frame, crop, ord, CAST(least(greatest(round_even(u/6,0),0),49) AS BIGINT) AS c, CAST(least(greatest(round_even(v/6,0),0),40) AS BIGINT) AS r, CASE WHEN ord%17=0 THEN -200 WHEN ord%19=0 THEN NULL ELSE gy END AS h FROM matches)
    SELECT frame, crop, ord FROM p JOIN dsm ON dsm.row=p.r AND dsm.col=p.c WHERE h>-100 AND (dsm.row*dsm.col)%5>0""")
def valid_matches(df, dsm):
    """Matches with a known height on a pixel of the map that is not black."""
    image = dsm.select("row", "col", ((F.col("row") * F.col("col")) % 5).alias("colour"))
    clip = lambda c, most: F.least(F.greatest(F.rint(F.col(c) / 6), F.lit(0.0)), F.lit(most)).cast("long")
    height = F.when(F.col("ord") % 17 == 0, -200.0).when(F.col("ord") % 19 != 0, F.col("gy"))
    placed = df.withColumn("h", height).where("h > -100").select("frame", "crop", "ord", clip("v", 40.0).alias("row"), clip("u", 49.0).alias("col"))
    return placed.join(image.where("colour > 0"), ["row", "col"]).select("frame", "crop", "ord")


@query("pixels", """SELECT frame, avg((b+g+r)/3.0)<1 AS black, avg(CASE WHEN abs(b-235)<20 AND abs(g-206)<20 AND abs(r-135)<20 THEN 1.0 ELSE 0.0 END)>0.9 AS sky, avg((b+g+r)/3.0)<1 OR avg(CASE WHEN abs(b-235)<20 AND abs(g-206)<20 AND abs(r-135)<20 THEN 1.0 ELSE 0.0 END)>0.9 AS invalid FROM pixels GROUP BY frame""")
def invalid_frames(df):
    """Images that are black, or nearly all of the colour of the sky."""
    near = F.abs(F.col("b") - SKY_BGR[0]) < SKY_NEAR
    near = near & (F.abs(F.col("g") - SKY_BGR[1]) < SKY_NEAR) & (F.abs(F.col("r") - SKY_BGR[2]) < SKY_NEAR)
    found = df.groupBy("frame").agg((F.avg((F.col("b") + F.col("g") + F.col("r")) / 3) < BLACK).alias("black"), (F.avg(near.cast("double")) > SKY_SHARE).alias("sky"))
    return found.withColumn("invalid", F.col("black") | F.col("sky"))


@query("matches", """, e AS (SELECT *, sqrt(((ord%9)*0.2e0-0.63e0)*((ord%9)*0.2e0-0.63e0)+((ord%5)*0.2e0-0.4e0)*((ord%5)*0.2e0-0.4e0)) AS fb FROM matches), g AS (SELECT frame, crop, ord, count(*) OVER (PARTITION BY frame, crop) AS n FROM e WHERE fb<1) SELECT frame, crop, ord FROM g WHERE n>=20""")
def flow_checked_points(df):
    """Points that flow there and back again to within a pixel, of the frames where 20 or more do."""
    back = df.withColumns({"bu": F.col("u") + (F.col("ord") % 9) * 0.2 - 0.63, "bv": F.col("v") + (F.col("ord") % 5) * 0.2 - 0.4})
    good = back.where(g.position_error(["u", "v"], ["bu", "bv"]) < 1.0)
    enough = good.groupBy("frame", "crop").agg(F.count("*").alias("n")).where("n >= 20")
    return good.join(enough, ["frame", "crop"], "left_semi").select("frame", "crop", "ord")


#: Metres around the trajectories, and the least extent that these count with.
NEAR, LEAST_EXTENT = 300.0, 200.0


@query("faces vertices path", """, t AS (SELECT avg(x) AS cx, avg(y) AS cy, greatest(max(x)-min(x), max(y)-min(y), 200e0)+300 AS radius FROM path), m AS (SELECT f, 40*(a.x+b.x+c.x)/3 AS x, 40*(a.y+b.y+c.y)/3 AS y FROM faces JOIN vertices a ON a.v=faces.a JOIN vertices b ON b.v=faces.b JOIN vertices c ON c.v=faces.c)
    SELECT f FROM m, t WHERE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))<radius""")
def faces_near_path(faces, vertices, df):
    """Faces of a mesh in units of 40 metres whose centre is nearer to the middle of the trajectories than their extent and NEAR."""
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(LEAST_EXTENT))
    middle = df.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (extent + NEAR).alias("radius"))  # one row
    placed = mesh.face_geometry(faces, vertices).select("f", (40 * F.col("cx")).alias("cx"), (40 * F.col("cy")).alias("cy")).join(F.broadcast(middle))
    return placed.where(g.position_error(["cx", "cy"], ["mx", "my"]) < F.col("radius")).select("f")


# --- point maps ----------------------------------------------------------------------------------------


def around(dsm: DataFrame) -> DataFrame:
    """``dsm`` with the heights of the four neighbours: l, r, u, d."""
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    beside = lambda c, k, w: F.when(F.lead(c, k).over(w) == F.col(c) + k, F.lead("z", k).over(w))
    return dsm.withColumns({"l": beside("col", -1, by_row), "r": beside("col", 1, by_row), "u": beside("row", -1, by_col), "d": beside("row", 1, by_col)})


AROUND = "a AS (SELECT dsm.row, dsm.col, dsm.z, l.z AS l, r.z AS r, u.z AS u, d.z AS d FROM dsm LEFT JOIN dsm l ON l.row=dsm.row AND l.col=dsm.col-1 LEFT JOIN dsm r ON r.row=dsm.row AND r.col=dsm.col+1 LEFT JOIN dsm u ON u.row=dsm.row-1 AND u.col=dsm.col LEFT JOIN dsm d ON d.row=dsm.row+1 AND d.col=dsm.col)"


_MAP = "dz AS (SELECT row, col, z-0.5e0*row+CASE WHEN (row*7+col*3)%29=0 THEN 5 ELSE 0 END AS z FROM dsm)"
_DIAMOND = {k: "(VALUES " + ", ".join(f"({r}, {c})" for r in range(-k, k + 1) for c in range(-k, k + 1) if abs(r) + abs(c) <= k) + ") o(r, c)" for k in (1, 2)}


@query("dsm", f""", {_MAP}, {AROUND.replace("dsm", "dz")}, g AS (SELECT *, (coalesce(r,z)-coalesce(l,z))/((CASE WHEN r IS NULL THEN 0 ELSE 1 END+CASE WHEN l IS NULL THEN 0 ELSE 1 END)*0.5e0) AS gx, (coalesce(d,z)-coalesce(u,z))/((CASE WHEN d IS NULL THEN 0 ELSE 1 END+CASE WHEN u IS NULL THEN 0 ELSE 1 END)*0.5e0) AS gy FROM a WHERE (l IS NOT NULL OR r IS NOT NULL) AND (u IS NOT NULL OR d IS NOT NULL)),
    s AS (SELECT row, col FROM a WHERE coalesce(abs(z-l),0)>2 OR coalesce(abs(z-u),0)>2), w AS (SELECT DISTINCT row+r AS row, col+c AS col FROM s, {_DIAMOND[1]}), m AS (SELECT row, col FROM g WHERE 1/sqrt(gx*gx+gy*gy+1)>0.75 AND (row, col) NOT IN (SELECT (row, col) FROM w)),
    k AS (SELECT DISTINCT row+r AS row, col+c AS col FROM m, {_DIAMOND[2]}), f AS (SELECT row, col FROM k WHERE (row, col) IN (SELECT (row, col) FROM dz)), e AS (SELECT row+r AS row, col+c AS col FROM f, {_DIAMOND[2]}), q AS (SELECT row, col FROM e GROUP BY row, col HAVING count(*)=13)
    SELECT row, col, -gx/sqrt(gx*gx+gy*gy+1) AS nx, gy/sqrt(gx*gx+gy*gy+1) AS ny, 1/sqrt(gx*gx+gy*gy+1) AS nz, (row, col) IN (SELECT (row, col) FROM q) AS horizontal FROM g""")
def point_map_normals(dsm):
    """Upward normals of a height map on a grid of half a metre, one-sided at its edges, and what is level: next to no step, and gaps closed."""
    z = F.col("z") - 0.5 * F.col("row") + F.when((F.col("row") * 7 + F.col("col") * 3) % 29 == 0, 5.0).otherwise(0.0)
    a = saved(around(dsm.select("row", "col", z.alias("z"))), "point-map")
    step = (F.coalesce(F.abs(F.col("z") - F.col("l")), F.lit(0.0)) > 2) | (F.coalesce(F.abs(F.col("z") - F.col("u")), F.lit(0.0)) > 2)
    both = lambda p, q: (F.col(p).isNotNull().cast("int") + F.col(q).isNotNull().cast("int")) * 0.5
    edged = a.where("(l is not null or r is not null) and (u is not null or d is not null)")
    slopes = edged.select("row", "col", ((F.coalesce("r", "z") - F.coalesce("l", "z")) / both("l", "r")).alias("gx"), ((F.coalesce("d", "z") - F.coalesce("u", "z")) / both("u", "d")).alias("gy"))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    level = slopes.where(1 / size > 0.75).join(raster.dilated(a.where(step), a, 1), ["row", "col"], "left_anti")
    filled = raster.closed(level, a, 2).withColumn("horizontal", F.lit(True))
    return slopes.join(filled, ["row", "col"], "left").select("row", "col", (-F.col("gx") / size).alias("nx"), (F.col("gy") / size).alias("ny"), (1 / size).alias("nz"), F.coalesce("horizontal", F.lit(False)).alias("horizontal"))


_P = "struct_pack(x := {d}*xn{k}/sqrt(xn{k}*xn{k}+yn{k}*yn{k}+1), y := {d}*yn{k}/sqrt(xn{k}*xn{k}+yn{k}*yn{k}+1), z := {d}/sqrt(xn{k}*xn{k}+yn{k}*yn{k}+1))"


_CROSS = f"""dz AS (SELECT row, col, CASE WHEN (row*50+col)%97=0 THEN 0 ELSE z END AS z FROM dsm), {AROUND.replace("dsm", "dz")}, n AS (SELECT *, (col-1-20)/60e0 AS xnl, (row-15)/60e0 AS ynl, (col+1-20)/60e0 AS xnr, (row-15)/60e0 AS ynr, (col-20)/60e0 AS xnu, (row-1-15)/60e0 AS ynu, (col-20)/60e0 AS xnd, (row+1-15)/60e0 AS ynd FROM a),
    p AS (SELECT row, col, z, l+r+u+d IS NOT NULL AS inner_cell, {', '.join(_P.format(d=c, k=c) + f' AS p{c}' for c in 'lrud')} FROM n), v AS (SELECT row, col, z, inner_cell, pr.x-pl.x AS ax, pr.y-pl.y AS ay, pr.z-pl.z AS az, pd.x-pu.x AS ex, pd.y-pu.y AS ey, pd.z-pu.z AS ez FROM p),
    c AS (SELECT row, col, z, inner_cell, ay*ez-az*ey AS nx, az*ex-ax*ez AS ny, ax*ey-ay*ex AS nz FROM v), s AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM c)"""


def _crosses(dsm: DataFrame) -> DataFrame:
    """Of a map of distances along the rays, 0 where there is none: z, and the cross product of the differences over both neighbours, null at the border."""
    def point(value: str, dr: int, dc: int) -> list[Column]:
        x, y = (F.col("col") + dc - 20) / 60, (F.col("row") + dr - 15) / 60
        depth = F.col(value) / F.sqrt(x * x + y * y + 1)
        return [x * depth, y * depth, depth]

    a = [q - p for p, q in zip(point("l", 0, -1), point("r", 0, 1), strict=True)]
    b = [q - p for p, q in zip(point("u", -1, 0), point("d", 1, 0), strict=True)]
    cross = {"nx": a[1] * b[2] - a[2] * b[1], "ny": a[2] * b[0] - a[0] * b[2], "nz": a[0] * b[1] - a[1] * b[0]}
    depth = F.when((F.col("row") * 50 + F.col("col")) % 97 == 0, 0.0).otherwise(F.col("z"))
    found = around(dsm.withColumn("z", depth)).select("row", "col", "z", *[c.alias(n) for n, c in cross.items()])
    return found.withColumn("s", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))


@query("dsm", f""", {_CROSS} SELECT row, col, {', '.join(f"CASE WHEN inner_cell AND z<>0 THEN CASE WHEN nz<0 THEN -1 ELSE 1 END*{n}/CASE WHEN l<1e-8 THEN 1 ELSE l END ELSE 0 END AS {n}" for n in ("nx", "ny", "nz"))} FROM s""")
def camera_normals(dsm):
    """Normals turned to one side of the camera; zeros at the border and where there is no distance."""
    size, sign = F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")), F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    known = F.col("s").isNotNull() & (F.col("z") != 0)
    return _crosses(dsm).select("row", "col", *[F.when(known, sign * F.col(n) / size).otherwise(0.0).alias(n) for n in ("nx", "ny", "nz")])


@query("dsm", f""", {_CROSS} SELECT row, col, {', '.join(f"CASE WHEN inner_cell AND z>0 AND l>1e-6 THEN {n}/(l+1e-9) ELSE 0 END AS {n}" for n in ("nx", "ny", "nz"))} FROM s""")
def depth_normals(dsm):
    """Normals as the differences give them, with no side forced; zeros at the border, without distance and of no length."""
    known = (F.col("s") > 1e-6) & (F.col("z") > 0)
    return _crosses(dsm).select("row", "col", *[F.when(known, F.col(n) / (F.col("s") + 1e-9)).otherwise(0.0).alias(n) for n in ("nx", "ny", "nz")])


@query("dsm", """, s AS (SELECT max(row) AS h, max(col) AS w FROM dsm) SELECT row, col, 1000+col*(500e0/w) AS x, 2300-row*(300e0/h) AS y, CASE WHEN (row*50+col)%97=0 THEN 0 ELSE z END AS z FROM dsm, s""")
def height_points(dsm):
    """Points of a height map between its bounds, the first row at the top; heights below -1000 are none and count as 0."""
    size = dsm.agg(F.max("row").alias("h"), F.max("col").alias("w"))  # one row
    z = F.when((F.col("row") * 50 + F.col("col")) % 97 == 0, -9999.0).otherwise(F.col("z"))
    placed = dsm.withColumn("z", z).join(F.broadcast(size))
    return placed.select("row", "col", (1000 + F.col("col") * (500.0 / F.col("w"))).alias("x"), (2300 - F.col("row") * (300.0 / F.col("h"))).alias("y"), F.when(F.col("z") < -1000, 0.0).otherwise(F.col("z")).alias("z"))


@query("dsm", """SELECT (1000+1500)/2e0 AS x, (2000+2300)/2e0 AS y, quantile_cont(z, 0.5) AS z, min(z) AS least, max(z)-min(z)+1e-8 AS span, avg(z) AS mean, stddev_samp(z)+1e-8 AS spread FROM dsm WHERE (row*50+col)%97<>0""")
def height_statistics(dsm):
    """Offset of a scene: the middle of its bounds and its median height; and the two ways to normalise its heights."""
    z = F.when((F.col("row") * 50 + F.col("col")) % 97 == 0, -9999.0).otherwise(F.col("z"))
    valid = saved(dsm.select(z.alias("z")).where("z > -9000"), "heights")
    return valid.agg(
        F.lit(1250.0).alias("x"), F.lit(2150.0).alias("y"), F.lit(quantiles.quantile(valid, "z", 0.5)).cast("double").alias("z"), F.min("z").alias("least"),
        (F.max("z") - F.min("z") + 1e-8).alias("span"), F.avg("z").alias("mean"), (F.stddev_samp("z") + 1e-8).alias("spread"),
    )


@query("faces", None)
def face_buildings(faces):
    """(f, building): faces that share an edge are of one building, named by its least face."""
    return faces.select("f").join(mesh.joined_faces(faces), "f", "left").select("f", F.coalesce("component", "f").alias("building"))


#: Shares of sequences from the slowest on, and the top speeds in km/h that each share is given.
SPEED_BINS = ((0.4, 15, 30), (0.3, 30, 50), (0.2, 50, 72), (0.1, 72, 100))


@query("path", f""", s AS (SELECT seq, ord, {"sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w))"}*30e0*3.6e0 AS v FROM path WINDOW w AS (PARTITION BY seq ORDER BY ord)), m AS (SELECT seq, round(coalesce(max(v),0),6) AS v FROM s GROUP BY seq),
    r AS (SELECT seq, row_number() OVER (ORDER BY v, seq)-1 AS k, count(*) OVER () AS n FROM m) SELECT seq, CASE WHEN k<CAST(floor(0.4e0*n) AS BIGINT) THEN 15 WHEN k<CAST(floor((0.4e0+0.3e0)*n) AS BIGINT) THEN 30 WHEN k<CAST(floor((0.4e0+0.3e0+0.2e0)*n) AS BIGINT) THEN 50 ELSE 72 END AS low,
      CASE WHEN k<CAST(floor(0.4e0*n) AS BIGINT) THEN 30 WHEN k<CAST(floor((0.4e0+0.3e0)*n) AS BIGINT) THEN 50 WHEN k<CAST(floor((0.4e0+0.3e0+0.2e0)*n) AS BIGINT) THEN 72 ELSE 100 END AS high FROM r""")
def target_speeds(df):
    """Ranges of top speeds for sequences by the rank of their own: slower ones get slower ranges."""
    speed = windows.step_length(["x", "y", "z"], windows.of()) * 30 * 3.6
    top = df.withColumn("v", speed).groupBy("seq").agg(F.round(F.coalesce(F.max("v"), F.lit(0.0)), 6).alias("v"))
    n = top.agg(F.count("*").alias("n"))  # one row
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy("v", "seq")) - 1).join(F.broadcast(n))  # one task: a row for each sequence
    low, high = F.lit(SPEED_BINS[-1][1]), F.lit(SPEED_BINS[-1][2])
    for share, (_, a, b) in reversed(list(zip(accumulate(s for s, _, _ in SPEED_BINS), SPEED_BINS[:-1], strict=False))):
        below = F.col("k") < F.floor(share * F.col("n"))
        low, high = F.when(below, a).otherwise(low), F.when(below, b).otherwise(high)
    return ranked.select("seq", low.alias("low"), high.alias("high"))
