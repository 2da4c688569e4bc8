"""Further queries of the trajectory and geodata operators, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, neighbours, segments, windows
from ..scratch import saved
from .pose_queries import AROUND, around
from .queries import query, r4


@query("path", """, d AS (SELECT seq, ord, ((yaw-lag(yaw) OVER (PARTITION BY seq ORDER BY ord)+540)%360+360)%360-180 AS rate FROM path) SELECT seq, ord, round(coalesce(rate,0)*0.15,4) AS bank FROM d""")
def turn_banking(df):
    rate = F.pmod(F.col("yaw") - F.lag("yaw").over(windows.of()) + 540, F.lit(360.0)) - 180
    return df.select("seq", "ord", r4(F.coalesce(rate, F.lit(0.0)) * 0.15, "bank"))


@query("path", """, d AS (SELECT seq, ord, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w))*30 + 0.1*abs(yaw-lag(yaw) OVER w)*30 AS m FROM path WINDOW w AS (PARTITION BY seq ORDER BY ord)),
    k AS (SELECT seq, ord, coalesce(m, lead(m) OVER (PARTITION BY seq ORDER BY ord)) AS m FROM d) SELECT seq, ord, round(m,3) AS motion, CAST(2*floor(least(greatest((m-15)*0.25+3,3),9)/2)+1 AS INTEGER) AS kernel FROM k""")
def motion_blur_kernels(df):
    w = windows.of()
    motion = windows.step_length(["x", "y", "z"], w) * 30 + 0.1 * F.abs(F.col("yaw") - F.lag("yaw").over(w)) * 30
    filled = df.withColumn("m", motion).withColumn("m", F.coalesce("m", F.lead("m").over(w)))
    size = F.least(F.greatest((F.col("m") - 15) * 0.25 + 3, F.lit(3.0)), F.lit(9.0))
    return filled.select("seq", "ord", F.round("m", 3).alias("motion"), F.when(F.col("m").isNull(), 3).otherwise((2 * F.floor(size / 2) + 1).cast("int")).alias("kernel"))


@query("path", """, s AS (SELECT seq, ord, err, tracked, row_number() OVER (PARTITION BY seq, g ORDER BY ord)-1 AS since, g FROM (SELECT *, sum(CASE WHEN is_kf THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM path) t)
    SELECT seq, ord, round(2+2*greatest(0.0,1-since/15.0),4) AS absolute, round(CASE WHEN g>0 THEN 1.5*first_value(err) OVER (PARTITION BY seq, g ORDER BY ord) ELSE 999 END,4) AS relative FROM s WHERE g>0 OR since>=0""")
def error_thresholds(df):
    marked = df.withColumn("g", windows.segment("is_kf"))
    w = Window.partitionBy("seq", "g").orderBy("ord")
    since = F.row_number().over(w) - 1
    relative = F.when(F.col("g") > 0, 1.5 * F.first("err").over(w)).otherwise(999.0)
    return marked.select("seq", "ord", r4(2 + 2 * F.greatest(F.lit(0.0), 1 - since / 15), "absolute"), r4(relative, "relative"))


@query("dsm", ", c AS (SELECT CAST(floor(row/10) AS BIGINT) AS tile, avg(CASE WHEN z<95 THEN 1.0 ELSE 0.0 END) AS dark, avg(CASE WHEN z>105 THEN 1.0 ELSE 0.0 END) AS bright FROM dsm GROUP BY 1) SELECT tile, round(greatest(dark,bright),4) AS ratio, dark<=0.15 AND bright<=0.95 AS covered FROM c")
def coverage(dsm):
    shares = dsm.groupBy(F.floor(F.col("row") / 10).alias("tile")).agg(F.avg((F.col("z") < 95).cast("double")).alias("dark"), F.avg((F.col("z") > 105).cast("double")).alias("bright"))
    return shares.select("tile", r4(F.greatest("dark", "bright"), "ratio"), ((F.col("dark") <= 0.15) & (F.col("bright") <= 0.95)).alias("covered"))


@query("places", "SELECT height, count(*) AS n, bool_and(lat BETWEEN 47 AND 53.9 AND lon BETWEEN 6 AND 14.5) AS inside, round(min(lon),4) AS west, round(max(lat),4) AS north FROM places GROUP BY height")
def groups_inside_region(places):
    inside = F.col("lat").between(47, 53.9) & F.col("lon").between(6, 14.5)
    return places.groupBy("height").agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"), r4(F.min("lon"), "west"), r4(F.max("lat"), "north"))


@query("matches", """, t AS (SELECT frame, crop, count(*) AS n, avg(conf) AS conf FROM matches GROUP BY frame, crop), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, conf DESC, crop) AS k FROM t) SELECT frame, crop, n FROM r WHERE k=1""")
def best_models(df):
    """The model of most matches, then of greatest mean confidence, then the first; means count as equal to nine digits, as the order of a sum moves the last ones."""
    models = df.groupBy("frame", "crop").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 9).alias("conf"))
    return models.groupBy("frame").agg(F.max_by(F.struct("crop", "n"), F.struct("n", "conf", -F.col("crop"))).alias("b")).select("frame", "b.crop", "b.n")


@query("matches", "SELECT frame, round(quantile_disc(gx,0.5),4) AS centre, round(least(greatest((max(gx)-min(gx))/500,0.1),2.0),4) AS gsd FROM matches GROUP BY frame")
def crop_bounds(df):
    """The lower of two middle values, unlike the interpolated median."""
    return df.groupBy("frame").agg(r4(F.expr("percentile_disc(0.5) within group (order by gx)"), "centre"), r4(F.least(F.greatest((F.max("gx") - F.min("gx")) / 500, F.lit(0.1)), F.lit(2.0)), "gsd"))


@query("matches", "SELECT frame, count(*) AS n, round(regr_slope(gx,u),4) AS slope, round(regr_intercept(gx,u),3) AS shift, round(covar_pop(u,v),4) AS covariance FROM matches GROUP BY frame HAVING count(*)>100 AND var_pop(u)>0")
def affine_fits(df):
    fits = df.groupBy("frame").agg(F.count("*").alias("n"), r4(F.regr_slope("gx", "u"), "slope"), F.round(F.regr_intercept("gx", "u"), 3).alias("shift"), r4(F.covar_pop("u", "v"), "covariance"), F.var_pop("u").alias("spread"))
    return fits.where("n > 100 and spread > 0").drop("spread")


@query("matches", """, m AS (SELECT *, min(depth) OVER (PARTITION BY frame, floor(u/16), floor(v/16)) AS least FROM matches), k AS (SELECT * FROM m WHERE depth<=least+greatest(0.1*least,2)), a AS (SELECT frame, count(*) AS n, quantile_cont(gx,0.1) AS lo, quantile_cont(gx,0.9) AS hi, sum(gx/greatest(depth,1))/sum(1/greatest(depth,1)) AS cx FROM k GROUP BY frame)
    SELECT frame, n, round((hi-lo)*1.15,4) AS size, round(cx,4) AS cx FROM a WHERE n>=20""")
def visible_crops(df):
    cell = Window.partitionBy("frame", F.floor(F.col("u") / 16), F.floor(F.col("v") / 16))
    near = df.withColumn("least", F.min("depth").over(cell)).where(F.col("depth") <= F.col("least") + F.greatest(0.1 * F.col("least"), F.lit(2.0)))
    weight = 1 / F.greatest(F.col("depth"), F.lit(1.0))
    boxes = near.groupBy("frame").agg(F.count("*").alias("n"), F.percentile("gx", F.lit(0.1)).alias("lo"), F.percentile("gx", F.lit(0.9)).alias("hi"), r4(F.sum(F.col("gx") * weight) / F.sum(weight), "cx"))
    return boxes.where("n >= 20").select("frame", "n", r4((F.col("hi") - F.col("lo")) * 1.15, "size"), "cx")


@query("names", "SELECT part, CASE WHEN name LIKE '%interiorwall%' THEN 'interior' WHEN name LIKE '%wall%' THEN 'wall' WHEN name LIKE '%bdom%' THEN 'roof' WHEN name LIKE '%LoD%' THEN 'ground' ELSE 'building' END AS label, regexp_extract(name, '\\d+', 0) AS number FROM names".replace("\\\\", "\\"))
def part_labels(df):
    cases = (("interiorwall", "interior"), ("wall", "wall"), ("bdom", "roof"), ("LoD", "ground"))
    label = reduce(lambda c, x: c.when(F.col("name").contains(x[0]), x[1]), cases[1:], F.when(F.col("name").contains(cases[0][0]), cases[0][1])).otherwise("building")
    return df.select("part", label.alias("label"), F.regexp_extract("name", r"\d+", 0).alias("number"))


@query("path", "SELECT seq, ord, row_number() OVER (PARTITION BY seq ORDER BY ord)-1 AS number, 'frame_'||lpad(CAST(row_number() OVER (PARTITION BY seq ORDER BY ord)-1 AS VARCHAR),6,'0')||'.jpg' AS name FROM path WHERE NOT failed")
def staged_frames(df):
    place = (F.row_number().over(windows.of()) - 1).cast("long")
    return df.where(~F.col("failed")).withColumn("number", place).select("seq", "ord", "number", F.format_string("frame_%06d.jpg", "number").alias("name"))


@query("path", """, n AS (SELECT DISTINCT seq FROM path), r AS (SELECT seq, row_number() OVER (ORDER BY seq)-1 AS k, count(*) OVER () AS n FROM n) SELECT seq, CASE WHEN k<greatest(1,floor(0.7*n)) THEN 'train' WHEN k<greatest(1,floor(0.7*n))+floor(0.15*n) THEN 'val' ELSE 'test' END AS split FROM r""")
def default_splits(df):
    """Splits of the sorted names: one row for each sequence is all that is numbered. Shares are of whole numbers: 0.7 * 90 is just under 63 as floats."""
    names = df.select("seq").distinct()
    ranked = names.withColumn("k", F.row_number().over(Window.orderBy("seq")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    train = F.greatest(F.lit(1), F.floor(F.col("n") * 7 / 10))
    return ranked.select("seq", F.when(F.col("k") < train, "train").when(F.col("k") < train + F.floor(F.col("n") * 15 / 100), "val").otherwise("test").alias("split"))


@query("boxes tiles", """, h AS (SELECT DISTINCT box FROM boxes b JOIN tiles t ON b.minx<=t.maxx AND b.maxx>=t.minx AND b.miny<=t.maxy AND b.maxy>=t.miny) SELECT box FROM boxes WHERE box NOT IN (SELECT box FROM h)""")
def boxes_without_tiles(boxes, tiles):
    return boxes.select("box").join(joins.overlapping(boxes, tiles, "box", "tile", 100.0), "box", "left_anti")


@query("dsm", """, e AS (SELECT a.row*2147483648+a.col AS a, b.row*2147483648+b.col AS b FROM dsm a JOIN dsm b ON (b.row=a.row AND b.col=a.col+1 OR b.row=a.row+1 AND b.col=a.col) AND abs(a.z-b.z)<0.02*greatest(a.z,b.z)), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    n AS (SELECT DISTINCT a AS node FROM l) SELECT count(*) AS linked, (SELECT count(*) FROM e) AS edges FROM n""")
def plane_links(dsm):
    """Neighbouring cells of nearly equal height."""
    links = _flat_neighbours(dsm)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return nodes.agg(F.count("*").alias("linked")).join(links.agg(F.count("*").alias("edges")))


def _flat_neighbours(dsm):
    at = dsm.select("row", "col", "z")
    moved = at.select("row", (F.col("col") - 1).alias("col"), F.col("z").alias("nz"), F.lit(0).alias("dr"), F.lit(1).alias("dc"))
    moved = moved.unionByName(at.select((F.col("row") - 1).alias("row"), "col", F.col("z").alias("nz"), F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    near = at.join(moved, ["row", "col"]).where(F.abs(F.col("z") - F.col("nz")) < 0.02 * F.greatest("z", "nz"))
    return near.select(_cell(F.col("row"), F.col("col")).alias("a"), _cell(F.col("row") + F.col("dr"), F.col("col") + F.col("dc")).alias("b"))


def _cell(row, col):
    """A number for each cell of any raster of fewer than 2^31 columns."""
    return row * 2147483648 + col


_RELIEF = "dz AS (SELECT row, col, z-0.5e0*row+3*((CAST(floor(row/12e0) AS BIGINT)+CAST(floor(col/13e0) AS BIGINT))%3)+CASE WHEN (row*7+col*3)%61=0 THEN 5 ELSE 0 END AS z FROM dsm)"


@query("dsm", f""", {_RELIEF}, {AROUND.replace("dsm", "dz")}, g AS (SELECT row, col, z, coalesce(r,z)-coalesce(l,z) AS gx, coalesce(d,z)-coalesce(u,z) AS gy FROM a), s AS (SELECT *, sqrt(gx*gx+gy*gy+1) AS n FROM g),
    e AS (SELECT a.row*2147483648+a.col AS a, b.row*2147483648+b.col AS b FROM s a JOIN s b ON (b.row=a.row AND b.col=a.col+1 OR b.row=a.row+1 AND b.col=a.col) AND abs(a.z-b.z)<0.02*greatest(a.z,b.z) AND (a.gx*b.gx+a.gy*b.gy+1)/(a.n*b.n)>=0.995), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT a AS node, a AS via FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a=reach.via), lab AS (SELECT node, min(via) AS segment FROM reach GROUP BY node)
    SELECT segment, count(*) AS cells, round(avg(z),4) AS height FROM lab JOIN dz ON node=row*2147483648+col GROUP BY segment HAVING count(*)>=50""")
def plane_segments(dsm):
    """Planes of a height map of 50 cells at least: segment, cells and mean height."""
    step = (F.floor(F.col("row") / 12) + F.floor(F.col("col") / 13)) % 3
    z = F.col("z") - 0.5 * F.col("row") + 3 * step + F.when((F.col("row") * 7 + F.col("col") * 3) % 61 == 0, 5).otherwise(0)
    a = around(dsm.select("row", "col", z.alias("z")))
    slopes = [-(F.coalesce("r", "z") - F.coalesce("l", "z")), F.coalesce("d", "z") - F.coalesce("u", "z")]
    cells = saved(a.select(F.lit(0).alias("frame"), "row", "col", F.col("z").alias("depth"), slopes[0].alias("nx"), slopes[1].alias("ny"), F.lit(1.0).alias("nz")), "relief")
    found = segments.plane_segments(cells, block=16).join(cells.select("row", "col", "depth"), ["row", "col"])
    return found.groupBy("segment").agg(F.count("*").alias("cells"), r4(F.avg("depth"), "height"))


@query("quats", """, d AS (SELECT a.vec_id AS q, b.vec_id AS n, a.qw*b.qw+a.qx*b.qx+a.qy*b.qy+a.qz*b.qz AS dot, sqrt((a.qw*a.qw+a.qx*a.qx+a.qy*a.qy+a.qz*a.qz)*(b.qw*b.qw+b.qx*b.qx+b.qy*b.qy+b.qz*b.qz)) AS s FROM quats a, quats b WHERE a.vec_id%50=0 AND a.vec_id<>b.vec_id)
    , r AS (SELECT q, n, dot/s AS c, row_number() OVER (PARTITION BY q ORDER BY dot/s DESC, n) AS k FROM d WHERE s>0) SELECT q, n, CAST(k AS BIGINT) AS k FROM r WHERE k<=5""")
def nearest_orientations(quats):
    """The five orientations nearest to each whose id is divisible by 50: a stated query set against all rows."""
    points = quats.select(F.col("vec_id").alias("n"), F.array("qw", "qx", "qy", "qz").alias("v"))
    return neighbours.nearest_by_angle(points, points.where("n % 50 = 0").withColumnRenamed("n", "q"))
