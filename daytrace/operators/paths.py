"""Paths for a table of pairs: ways are followed back from predecessors, simple paths are searched from both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, join_groups, written
from .components import connected_components
from .graph import bfs, shortest_paths


def pairs_with_a_way(edges: DataFrame, sources: DataFrame, goals: DataFrame, block: int = 1024) -> DataFrame:
    """``source, goal``: of ``sources(source, k)`` and ``goals(goal, k)`` the pairs with equal ``k`` that lie in one component of the
    graph, whose edges go both ways: no other pair has a way, so none is made. Vertices without an edge have no row.

    The goals of a component and ``k`` are dealt into blocks of about ``block``, and each source meets each block.
    """
    roots = cut_lineage(connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    a, b = cut_lineage(sources.join(roots, F.col("source") == F.col("v")).select("source", "k", "root")), cut_lineage(goals.join(roots, F.col("goal") == F.col("v")).select("goal", "k", "root"))
    sizes = b.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n"))
    # a component with many goals has many sources, too
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    total = b.count()
    a = join_groups(a, sizes, ["k", "root"], "n", total).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("source", "k", "root", "at")
    b = join_groups(b, sizes, ["k", "root"], "n", total).withColumn("at", F.pmod(F.xxhash64("goal"), F.col("blocks")).cast("int")).select("goal", "k", "root", "at")
    return a.join(b, ["k", "root", "at"]).select("source", "goal")


def difficulty(steps: Column) -> Column:
    """Difficulty by the number of vertices on a path."""
    return F.when(steps <= 2, "beginner").when(steps <= 4, "intermediate").when(steps <= 6, "advanced").otherwise("expert")


def predecessors(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """``source, id, parent`` of ``distances(source, id, distance)``: the smallest vertex over which a vertex is reached at its
    distance; null for the source itself. Weights must be above 0."""
    near = distances.select("source", F.col("id").alias("src"), F.col("distance").alias("d"))
    step = near.join(edges.select("src", "dst", "weight"), "src").select("source", F.col("dst").alias("id"), (F.col("d") + F.col("weight")).alias("distance"), "src")
    parents = step.join(distances, ["source", "id", "distance"]).groupBy("source", "id").agg(F.min("src").alias("parent"))
    return distances.select("source", "id").join(parents, ["source", "id"], "left").withColumn("parent", F.when(F.col("id") != F.col("source"), F.col("parent")))


def followed(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, goal, path``: the way to each goal of ``pairs(source, goal)`` that ``parents(source, id, parent)`` has.

    One join a step for the pairs that are still on their way; a pair whose goal isn't reached has no row.
    """
    parents = cut_lineage(parents)
    on = pairs.select("source", "goal").distinct().withColumnsRenamed({"goal": "id"}).withColumn("goal", F.col("id")).withColumn("path", F.array("id"))
    done = None
    while True:
        x = written(on.join(parents, ["source", "id"]), "ways")
        arrived = x.filter("parent is null").select("source", "goal", "path")
        done = arrived if done is None else done.union(arrived)
        on = x.filter("parent is not null").select("source", F.col("parent").alias("id"), "goal", F.concat(F.array("parent"), "path").alias("path"))
        if on.isEmpty():
            return done


def shortest_routes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, goal, path, total_steps, total_cost, difficulty``: the cheapest path of each pair that has one; of equal
    ones that over the smallest vertices, from the goal backwards. Weights must be above 0."""
    e = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    found = cut_lineage(shortest_paths(e, pairs.select(F.col("source").alias("id")).distinct()))
    ways = followed(predecessors(e, found), pairs)
    out = ways.join(found.withColumnRenamed("id", "goal"), ["source", "goal"])
    steps = F.size("path").cast("long")
    return out.select("source", "goal", "path", steps.alias("total_steps"), F.round("distance", 3).alias("total_cost"), difficulty(steps).alias("difficulty"))


def hop_routes(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """``source, goal, path, total_weight``: the path with the fewest edges, ``depth`` at most, of each pair that has one;
    of equal ones that over the smallest vertices, from the goal backwards."""
    found = bfs(edges, pairs.select(F.col("source").alias("id")).distinct(), depth)
    ways = cut_lineage(followed(found.select("source", "id", "parent"), pairs))
    hops = ways.select("source", "goal", F.posexplode("path").alias("p", "src"), F.col("path").alias("way")).withColumn("dst", F.get("way", F.col("p") + 1))
    weights = hops.join(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")), ["src", "dst"]).groupBy("source", "goal").agg(F.sum("weight").alias("total_weight"))
    return ways.join(weights, ["source", "goal"], "left").fillna(0, ["total_weight"])


def all_routes(edges: DataFrame, pairs: DataFrame, most_vertices: int = 7, most: int = 5) -> DataFrame:
    """``source, goal, path, total_steps, total_cost, difficulty, rank``: for each pair the first ``most`` simple paths, fewest
    edges first and then in order of their vertices, of at most ``most_vertices``; ranked by cost, then in that order.

    Half paths grow from both ends, one join each a level, and meet in the middle, so that no path longer than half is
    grown. Pairs that have enough paths take no part in longer ones. A pair of one vertex has that one path.
    """
    e = cut_lineage(edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight")))
    pairs = cut_lineage(pairs.select("source", "goal").distinct())
    found = pairs.filter("source = goal").select("source", "goal", F.array("source").alias("path"), F.lit(0.0).alias("cost"))
    left = pairs.filter("source <> goal")
    ahead = [left.select("source", F.col("source").alias("at"), F.array("source").alias("path"), F.lit(0.0).alias("cost")).distinct()]
    behind = [left.select("goal", F.col("goal").alias("at"), F.array("goal").alias("path"), F.lit(0.0).alias("cost")).distinct()]
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    def grown(rows: DataFrame, end: str, steps: DataFrame, append: bool, open_: DataFrame) -> DataFrame:
        x = rows.join(open_.select(end).distinct(), end, "left_semi").join(steps, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        path = F.concat("path", F.array("dst")) if append else F.concat(F.array("dst"), "path")
        return written(x.select(end, F.col("dst").alias("at"), path.alias("path"), (F.col("cost") + F.col("weight")).alias("cost")), "halves")

    order = F.row_number().over(Window.partitionBy("source", "goal").orderBy(F.size("path"), "path"))
    for hops in range(1, most_vertices):
        first, second = (hops + 1) // 2, hops // 2
        if len(ahead) <= first:
            ahead.append(grown(ahead[-1], "source", e, True, left))
        if len(behind) <= second:
            behind.append(grown(behind[-1], "goal", back, False, left))
        a, b = ahead[first], behind[second].select("goal", "at", F.col("path").alias("rest"), F.col("cost").alias("more"))
        rest = F.slice("rest", 2, second + 1)
        met = left.join(a, "source").join(b, ["goal", "at"]).filter(~F.arrays_overlap("path", rest))
        met = met.select("source", "goal", F.concat("path", rest).alias("path"), (F.col("cost") + F.col("more")).alias("cost"))
        found = written(found.unionByName(met).withColumn("k", order).filter(F.col("k") <= most).drop("k"), "routes")
        left = cut_lineage(left.join(found.groupBy("source", "goal").count().filter(F.col("count") >= most), ["source", "goal"], "left_anti"))
        if left.isEmpty():
            break
    steps = F.size("path").cast("long")
    rank = F.row_number().over(Window.partitionBy("source", "goal").orderBy(F.round("cost", 3), F.size("path"), "path")).cast("long")
    return found.select("source", "goal", "path", steps.alias("total_steps"), F.round("cost", 3).alias("total_cost"), difficulty(steps).alias("difficulty"), rank.alias("rank"))
