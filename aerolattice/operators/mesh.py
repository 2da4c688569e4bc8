"""Meshes as tables of vertices (v, x, y, z) and faces (f, a, b, c): normals, edges, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from .joins import HEAVY, heavy_keys, looked_up

#: Links that one task joins up at the end.
FEW = 200_000


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """f, centroid, area and unit normal of each face; a face without area has normal 0."""
    out = faces
    for corner in ("a", "b", "c"):
        out = out.join(vertices.select(F.col("v").alias(corner), *[F.col(k).alias(f"{corner}{k}") for k in "xyz"]), corner)
    p = {k: F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"}
    q = {k: F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"}
    n = {"x": p["y"] * q["z"] - p["z"] * q["y"], "y": p["z"] * q["x"] - p["x"] * q["z"], "z": p["x"] * q["y"] - p["y"] * q["x"]}
    size = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
    centroid = [((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"c{k}") for k in "xyz"]
    return out.select("f", *centroid, (size / 2).alias("area"), *[F.when(size > 0, n[k] / size).otherwise(0.0).alias(f"n{k}") for k in "xyz"])


def edges(faces: DataFrame) -> DataFrame:
    """Distinct undirected edges (low, high)."""
    sides = F.array(*[F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])
    return faces.select(F.inline(sides)).distinct()


def joined_faces(faces: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(f, component) of the faces that share an edge with others: the least face that is reached through shared edges. Other faces may be missing; null f joins nothing.

    Each face goes home to the least face of that of its edges which most faces share, so few homes are left where edges are crowded. Only homes
    that meet in an edge are linked. Edges and homes of ``heavy`` rows or more are looked up without bringing these to one task.
    """
    faces = faces.where("f IS NOT NULL")
    sides = F.array(*[F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    of_edge, edge = faces.select("f", F.inline(sides)).where("low <> high"), ["low", "high"]
    shared = saved(of_edge.groupBy(*edge).agg(F.min("f").alias("least"), F.count("*").alias("n")).where("n > 1"), "shared")
    often = shared.where(F.col("n") >= heavy).select(*edge)
    found = looked_up(of_edge, shared, edge, None if often.isEmpty() else often)
    homes = saved(found.groupBy("f").agg(F.max_by("least", "n").alias("home")), "homes")
    met = faces.join(homes, "f").select("home", F.inline(sides)).where("low <> high").distinct()
    links = met.select(F.col("home").alias("a"), F.lag("home").over(Window.partitionBy(*edge).orderBy("home")).alias("b")).where("b IS NOT NULL")
    of_home = homes.select("home").distinct().join(components(links).withColumnRenamed("node", "home"), "home", "left").select("home", F.coalesce("component", "home").alias("component"))
    return looked_up(homes, of_home, ["home"], heavy_keys(homes, ["home"], heavy)).select("f", "component")


def components(links: DataFrame, few: int = FEW, heavy: int = HEAVY) -> DataFrame:
    """(node, component): the least node reachable from each node that ``links`` (a, b) name.

    While there are over ``few`` links, each node goes to that of itself and its neighbours with the least hash, and links are drawn anew between these:
    a share of the nodes is left of each round. One task joins up the rest. Tables of each round are in the shared folder; nodes that ``heavy``
    rows or more go to are looked up without bringing these to one task.
    """
    links, steps = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), []
    while links.count() > few:
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
        hashed = links.select(F.inline(ends)).withColumn("order", F.struct(F.xxhash64("near", F.lit(len(steps))).alias("h"), "near"))
        own = F.struct(F.xxhash64("node", F.lit(len(steps))).alias("h"), F.col("node").alias("near"))
        step = saved(hashed.groupBy("node").agg(F.min("order").alias("order")).select("node", F.least("order", own)["near"].alias("to")), "steps")
        for end in ("a", "b"):
            to = step.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
            links = saved(looked_up(links, to, [end], heavy_keys(links, [end], heavy)), "links")
        links = saved(links.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        steps.append(step)
    found = saved(links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_joined_up, "node long, component long"), "joined")
    for step in reversed(steps):
        up = step.select(F.col("to").alias("_to")).distinct().join(found, F.col("_to") == F.col("node"), "left").select(F.col("_to").alias("to"), F.coalesce("component", "_to").alias("component"))
        found = saved(looked_up(step, up, ["to"], heavy_keys(step, ["to"], heavy)).select("node", "component"), "joined")
    if not steps:
        return found
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return looked_up(found, least, ["component"], heavy_keys(found, ["component"], heavy)).select("node", F.col("least").alias("component"))


def _joined_up(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, ends = np.unique(rows[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, np.concatenate([label[a], label[b]]), np.concatenate([low, low]))
        while (label[label] != label).any():
            label = label[label]
    return pd.DataFrame({"node": nodes, "component": nodes[label]})
