"""Domain relations derived from the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name -> (tables it reads, SQL with the tables in braces).
RELATIONS = {
    # frames of trajectories: position, heading in degrees, time, counters
    "path": ("events", """
        SELECT seq, ord, event_id, ord * 3e0 + v AS x, e97 * 1.5e0 + ord AS y, 100e0 + e13 AS z, ord * 0.1e0 + e7 * 0.01e0 AS t,
               (event_id * 47) % 360 - 180e0 AS yaw, e7 = 0 AS is_kf, e7 IN (1, 2, 5) AS failed, 60 + (event_id * 31) % 300 AS tracked, e13 / 4 AS err
        FROM (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, event_id,
               value AS v, CAST(event_id % 97 AS DOUBLE) AS e97, CAST(event_id % 13 AS DOUBLE) AS e13, CAST(event_id % 7 AS BIGINT) AS e7 FROM {events}) s"""),
    # results of frames: estimate and ground truth, which every eleventh lacks
    "results": ("orders", """
        SELECT o_orderkey AS frame_id, o_custkey % 50 AS seq, o_orderstatus AS method, o_orderstatus <> 'F' AS success, o_orderkey % 9 = 0 AS is_keyframe,
               o_totalprice / 1000 AS ex, CAST(o_orderkey % 101 AS DOUBLE) AS ey, CAST(o_orderkey % 17 AS DOUBLE) AS ez,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 + (o_orderkey % 5) * 0.7e0 - 1 END AS gx,
               CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) + (o_orderkey % 3) * 0.9e0 END AS gy,
               CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 17 AS DOUBLE) - (o_orderkey % 4) * 0.4e0 END AS gz,
               0.01e0 + (o_orderkey % 23) * 0.002e0 AS seconds
        FROM {orders}"""),
    "depth": ("lineitem", """
        SELECT l_suppkey AS seq, CAST(l_linenumber AS BIGINT) AS frame, l_quantity * 50 AS gt, l_extendedprice / 20 AS pred FROM {lineitem}"""),
    "matches": ("lineitem", """
        SELECT l_suppkey AS frame, CAST(l_linenumber AS BIGINT) AS crop, l_orderkey AS ord, l_discount * 10 AS conf,
               (l_partkey % 400) * 0.75e0 AS u, (l_orderkey % 300) * 0.75e0 AS v, CAST(l_orderkey % 90 AS DOUBLE) + 1 AS depth, l_extendedprice / 100 AS gx, l_quantity * 7 AS gy
        FROM {lineitem}"""),
    "dsm": ("part", """
        SELECT CAST(floor(p_partkey / 50e0) AS BIGINT) AS row, CAST(p_partkey % 50 AS BIGINT) AS col, p_retailprice / 10 AS z FROM {part}"""),
    "boxes": ("customer", """
        SELECT c_custkey AS box, CAST((c_custkey * 37) % 5000 AS DOUBLE) AS minx, CAST((c_custkey * 53) % 4000 AS DOUBLE) AS miny,
               CAST((c_custkey * 37) % 5000 + 20 + c_custkey % 60 AS DOUBLE) AS maxx, CAST((c_custkey * 53) % 4000 + 10 + c_custkey % 90 AS DOUBLE) AS maxy FROM {customer}"""),
    "tiles": ("supplier", """
        SELECT s_suppkey AS tile, CAST((s_suppkey * 211) % 5000 AS DOUBLE) AS minx, CAST((s_suppkey * 97) % 4000 AS DOUBLE) AS miny,
               CAST((s_suppkey * 211) % 5000 + 100 AS DOUBLE) AS maxx, CAST((s_suppkey * 97) % 4000 + 100 AS DOUBLE) AS maxy FROM {supplier}"""),
    "quats": ("embeddings", "SELECT vec_id, {q1} AS qw, {q2} AS qx, {q3} AS qy, {q4} AS qz, label FROM {embeddings}"),
    # cameras: a rotation to the world by rows, and a centre
    "cameras": ("embeddings", """
        SELECT vec_id AS cam, 1-2*(qy*qy+qz*qz)/n AS m0, 2*(qx*qy-qz*qw)/n AS m1, 2*(qx*qz+qy*qw)/n AS m2, 2*(qx*qy+qz*qw)/n AS m3, 1-2*(qx*qx+qz*qz)/n AS m4, 2*(qy*qz-qx*qw)/n AS m5,
               2*(qx*qz-qy*qw)/n AS m6, 2*(qy*qz+qx*qw)/n AS m7, 1-2*(qx*qx+qy*qy)/n AS m8, vec_id * 0.5e0 AS x, vec_id % 7 + 1e0 AS y, 40e0 + vec_id % 61 AS z
        FROM (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz AS n FROM (SELECT vec_id, {q1} AS qw, {q2} AS qx, {q3} AS qy, {q4} AS qz FROM {embeddings}) q) s WHERE n > 0"""),
    # pixels of images, every fifth of which is nearly the colour of the sky, and every seventh dark
    # world points as frames see them from above: turned by yaw, tilted, of a focal length of the frame; 4 or 6 of 10 in the right place
    "sights": ("lineitem", """
        SELECT frame, focal, cx, cy, cz, fits, X, Y, Z, CASE WHEN frame % 9 = 8 AND row % 60 <> 0 THEN NULL WHEN fits THEN 320 + focal * a / c ELSE 370 + focal * a / c + row * 7 % 200 END AS u,
               CASE WHEN fits THEN 240 + focal * (b * cos(tilt) + d * sin(tilt)) / c ELSE 200 + focal * (b * cos(tilt) + d * sin(tilt)) / c - row * 13 % 150 END AS v
        FROM (SELECT *, dx * cos(yaw) + dy * sin(yaw) AS a, dx * sin(yaw) - dy * cos(yaw) AS b, -dz AS d, -(dx * sin(yaw) - dy * cos(yaw)) * sin(tilt) - dz * cos(tilt) AS c
        FROM (SELECT *, X - cx AS dx, Y - cy AS dy, Z - cz AS dz, row % 10 < CASE WHEN frame % 4 = 0 THEN 4 ELSE 6 END AS fits
        FROM (SELECT frame, row, 240 / tan(radians((40.5e0 + frame % 30) / 2)) AS focal, radians(frame * 37e0) AS yaw, radians((frame % 11 - 5) * 3e0) AS tilt, frame % 10 * 30e0 AS cx, frame % 7 * 20e0 AS cy, 120e0 + frame % 40 AS cz,
               frame % 10 * 30e0 + part * 37 % 971 * 0.17e0 - 80 AS X, frame % 7 * 20e0 + ord * 41 % 887 * 0.15e0 - 65 AS Y, CASE WHEN frame % 5 = 0 THEN 10e0 ELSE part * 17 % 211 * 0.1e0 END AS Z
        FROM (SELECT l_suppkey AS frame, l_orderkey * 7 + l_linenumber AS row, l_partkey AS part, l_orderkey AS ord FROM {lineitem}) l) p) q) r"""),
    # points in two views: turned about the axis of view and tilted, moved by one in a direction of the pair; flat or in relief
    "views": ("lineitem", """
        SELECT pair, fits, u1, v1, CASE WHEN fits THEN 320 + 500 * qx / qz ELSE u1 + 40 + row * 7 % 120 END AS u2, CASE WHEN fits THEN 240 + 500 * qy / qz ELSE v1 - 30 - row * 13 % 100 END AS v2
        FROM (SELECT *, 320 + 500 * ax / az AS u1, 240 + 500 * ay / az AS v1, ax * cos(yaw) - ay * sin(yaw) + tx AS qx,
               (ax * sin(yaw) + ay * cos(yaw)) * cos(tilt) - az * sin(tilt) + ty AS qy, (ax * sin(yaw) + ay * cos(yaw)) * sin(tilt) + az * cos(tilt) + tz AS qz
        FROM (SELECT *, sx * az AS ax, sy * az AS ay
        FROM (SELECT *, CASE WHEN pair % 3 = 0 THEN 9e0 ELSE 7 + part * 17 % 211 * 0.02e0 END AS az
        FROM (SELECT l_suppkey AS pair, l_partkey AS part, l_orderkey * 7 + l_linenumber AS row, (l_orderkey * 7 + l_linenumber) % 10 < 7 AS fits, l_partkey * 37 % 971 / 971e0 - 0.5e0 AS sx, l_orderkey * 41 % 887 / 887e0 - 0.5e0 AS sy,
               radians(l_suppkey % 9 * 2e0 - 8) AS yaw, radians(l_suppkey % 7 - 3e0) AS tilt, cos(radians(l_suppkey * 40e0)) * 0.8e0 AS tx, sin(radians(l_suppkey * 40e0)) * 0.8e0 AS ty, CASE WHEN l_suppkey % 2 = 0 THEN 0.6e0 ELSE -0.6e0 END AS tz
        FROM {lineitem}) l) p) q) r"""),
    "pixels": ("lineitem", """
        SELECT l_suppkey AS frame, l_orderkey * 10 + l_linenumber AS px, CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 5 = 0 AND l_orderkey % 40 <> 0 THEN 235 + l_orderkey % 9 ELSE l_partkey % 256 END AS b,
               CASE WHEN l_suppkey % 7 = 0 THEN l_orderkey % 2 WHEN l_suppkey % 5 = 0 AND l_orderkey % 40 <> 0 THEN 206 - l_orderkey % 9 ELSE l_partkey * 3 % 256 END AS g,
               CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 5 = 0 AND l_orderkey % 40 <> 0 THEN 135 + l_orderkey % 5 ELSE l_partkey * 7 % 256 END AS r FROM {lineitem}"""),
    "places": ("customer", """
        SELECT c_custkey AS place, 47e0 + (c_custkey % 700) / 100e0 AS lat, 6e0 + (c_custkey % 890) / 100e0 AS lon, CAST(c_custkey % 500 AS DOUBLE) AS height FROM {customer}"""),
    "names": ("part", """
        SELECT p_partkey AS part, CASE p_partkey % 9 WHEN 6 THEN '32' || (600 + p_partkey % 99) || '_' || (5300 + p_partkey % 50) || '_20_DOM.tif' WHEN 7 THEN 'x_' || (390 + p_partkey % 20) || '_' || (5800 + p_partkey % 30) || '_y.tif' WHEN 8 THEN (600 + p_partkey % 99) || '_' || (5300 + p_partkey % 50) || '_DSM.a.tif' WHEN 0 THEN 'bdom_33' || (390 + p_partkey % 20) || '-' || (5800 + p_partkey % 30) || '.tif'
               WHEN 1 THEN '3dm_33_' || (390 + p_partkey % 20) || '_' || (5800 + p_partkey % 30) || '_1_be' WHEN 2 THEN 'LoD1_' || (390 + p_partkey % 20) || '_' || (5800 + p_partkey % 30) || '.xml'
               WHEN 3 THEN (600 + p_partkey % 99) || '_' || (5300 + p_partkey % 50) || '.gml' WHEN 4 THEN '32' || (600 + p_partkey % 99) || '_' || (5300 + p_partkey % 50) || '.tif'
               ELSE 'readme' END AS name FROM {part}"""),
    "vertices": ("part", "SELECT p_partkey AS v, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST((p_partkey * 7) % 41 AS DOUBLE) AS y, p_retailprice / 100 AS z FROM {part}"),
    "faces": ("lineitem", """
        SELECT l_orderkey * 10 + l_linenumber AS f, l_partkey AS a, 1 + (l_partkey + l_suppkey) % 100 AS b, 1 + (l_partkey * 3 + l_linenumber) % 100 AS c FROM {lineitem}"""),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = RELATIONS[name]
    parts = {f"q{k}": f"CAST(embedding[{k - 1}] AS DOUBLE)" for k in range(1, 5)}
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(_named(sql, table, parts), source=source)


def _named(sql: str, table: str, parts: dict[str, str]) -> str:
    sql = sql.replace("{" + table + "}", "{source}")
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def with_relations(names: list[str], query: str) -> str:
    """``query`` for DuckDB, after the relations that it reads."""
    parts = {f"q{k}": f"CAST(embedding[{k}] AS DOUBLE)" for k in range(1, 5)}
    ctes = []
    for name in names:
        table, sql = RELATIONS[name]
        sql = sql.replace("{" + table + "}", table)
        for k, v in parts.items():
            sql = sql.replace("{" + k + "}", v)
        ctes.append(f"{name} AS ({sql})")
    return f"WITH RECURSIVE {', '.join(ctes)}{'' if query.lstrip().startswith(',') else ' '}{query}" if names else query
