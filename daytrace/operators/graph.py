"""Graphs as edge tables: co-occurrence, centrality, communities, paths, link prediction, edge rules.

Edges are ``src, dst, weight``. Undirected graphs have each edge in both directions (``both_ways``).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import bounded, cut_lineage, written


# how many rows or pairs a task is to hold; the number of tasks follows from that and from the tables
HELD = 1_000_000


def pairs_within(rows: DataFrame, block: int = 1024, carried: tuple[str, ...] = ()) -> DataFrame:
    """``u, src, dst`` with ``src < dst``: the pairs of items ``i`` of each unit ``u``; the rows are distinct. Further columns
    ``carried`` come along as ``<name>_src`` and ``<name>_dst``.

    The rows are written once. The items of a unit with more than ``block`` are dealt into blocks by a hash, and each pair of
    blocks is a group of its own, so that one unit with very many items is spread over many tasks; other units are joined
    as they are, in as many tasks as the rows and pairs need.
    """
    return sized_pairs(rows, block, carried)[0]


def sized_pairs(rows: DataFrame, block: int = 1024, carried: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``pairs_within`` and in how many parts to group its pairs, so that a task's part doesn't grow with the tables."""
    rows = written(rows.select("u", "i", *carried), "units")
    sizes, seen = rows.groupBy("u").agg(F.count(F.lit(1)).alias("n")), Observation()
    pairs = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1.0) / 2), F.lit(0.0))
    large = written(sizes.observe(seen, pairs.alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).filter(F.col("n") > block), "hot-units")
    none, parts = large.isEmpty(), int(seen.get["pairs"] // HELD) + 1
    usual = rows if none else rows.join(bounded(large), "u", "left_anti")
    if (tasks := max(parts, seen.get["rows"] // HELD + 1)) > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        usual = usual.repartition(tasks, "u")
    side = lambda x, c: x.select(*[k for k in x.columns if k not in ("i", "own", *carried)], F.col("i").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in carried])
    out = ["u", "src", "dst", *[f"{k}_{c}" for c in ("src", "dst") for k in carried]]
    met = side(usual, "src").join(side(usual, "dst"), "u").filter("src < dst").select(*out)
    if none:
        return met, parts
    x = rows.join(bounded(large), "u").withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("i"), F.col("k")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("u", "i", "own", *carried, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a, b = side(x.withColumn("oa", F.col("own")), "src"), side(x.withColumn("ob", F.col("own")), "dst")
    hot = a.join(b, ["u", "lo", "hi"]).filter((F.col("src") < F.col("dst")) & ((F.col("lo") == F.col("hi")) | (F.col("oa") != F.col("ob"))))
    return met.union(hot.select(*out)), parts


def by_pair(pairs: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``pairs`` dealt out by ``keys`` in ``parts``, if these are more than a shuffle has anyway."""
    return pairs.repartition(parts, *keys) if parts > int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pairs


def co_occurrence(links: DataFrame, unit: str = "activity_id", item: str = "entity_id", block: int = 1024) -> DataFrame:
    """Pairs of items in the same unit, ``a < b``, with the number of units and the strength against the largest.

    The pairs are counted once, for the largest as well as for the rows."""
    met, parts = sized_pairs(links.select(F.col(unit).alias("u"), F.col(item).alias("i")).distinct(), block)
    counts = written(by_pair(met.select("src", "dst"), parts, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")), "pairs")
    most = counts.agg(F.max("weight").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("src", "dst", "weight", (F.col("weight") / F.col("most")).alias("strength"))  # one row


def entity_neighbors(links: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` items that occur most often together with each item; equal counts in order of the identifier."""
    both = both_ways(co_occurrence(links))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return both.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select(F.col("src").alias("entity_id"), F.col("dst").alias("neighbor_id"), F.col("weight").alias("n"), "rank")


def cross_type(links: DataFrame, entities: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """Co-occurring entities of different types, at least ``least`` times, the ``k`` strongest of each pair of types."""
    kinds = entities.select("id", "entity_type")
    x = co_occurrence(links).filter(F.col("weight") >= least)
    x = x.join(kinds.withColumnsRenamed({"id": "src", "entity_type": "t1"}), "src").join(kinds.withColumnsRenamed({"id": "dst", "entity_type": "t2"}), "dst").filter("t1 <> t2")
    x = x.select(F.least("t1", "t2").alias("type_a"), F.greatest("t1", "t2").alias("type_b"), F.when(F.col("t1") < F.col("t2"), F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(F.col("t1") < F.col("t2"), F.col("dst")).otherwise(F.col("src")).alias("b"), "weight")
    rank = F.row_number().over(Window.partitionBy("type_a", "type_b").orderBy(F.desc("weight"), "a", "b"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def both_ways(edges: DataFrame) -> DataFrame:
    """K1: each edge in both directions."""
    e = edges.select("src", "dst", "weight")
    return e.union(e.select("dst", "src", "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """K2: out-degree and out-weight of each vertex; vertices that are only reached have 0."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    reached = edges.select(F.col("dst").alias("id")).distinct()
    return reached.join(out, "id", "full_outer").fillna(0, ["degree", "weight"])


# up to how many rows of a table of vertices are sent to every executor at once, which leaves the edges where they are
SENT = 2_000_000


def _weighed(edges: DataFrame, rank: DataFrame, n: int, weight: str, out: str) -> DataFrame:
    """``dst`` and the sum of the scores of its neighbours times ``weight``. The edges lie by ``dst``, so as the scores are
    sent, in as many parts as ``n`` vertices need, partial sums have each vertex once and nothing else is shuffled."""
    parts = -(-n // SENT) or 1
    met, scores = edges, []
    for k in range(parts):
        part = rank if parts == 1 else rank.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        met = met.join(F.broadcast(part.select(F.col("id").alias(f"id{k}"), F.col("score").alias(f"score{k}"))), F.col("src") == F.col(f"id{k}"), "inner" if parts == 1 else "left")
        scores.append(F.col(f"score{k}"))
    score = scores[0] if parts == 1 else F.coalesce(*scores)
    return met.groupBy("dst").agg(F.sum(score * F.col(weight)).alias(out))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """K7: weighted PageRank in a fixed number of rounds; mass of vertices without an edge is lost and the scores are
    divided by their sum in the end. Each round is a join and an aggregation.

    The edges are written once, by ``dst``, with their weights; what a vertex gives is divided by its weights' sum before
    it's sent.
    """
    shared = written(edges.select("src", "dst", "weight").repartition("dst"), "edges")
    gives = shared.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("gives"))
    ids = written(shared.select(F.col("dst").alias("id")).distinct().join(gives, "id", "full_outer"), "vertices")
    n = ids.count()
    rank = ids.withColumn("score", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        sums = _weighed(shared, rank.filter("gives is not null").select("id", (F.col("score") / F.col("gives")).alias("score")), n, "weight", "got")
        rank = ids.join(sums, ids.id == sums.dst, "left").select("id", "gives", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if n > SENT or (k + 1) % cut_every == 0:
            rank = written(rank, "scores")
    total = rank.agg(F.sum("score").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("id", (F.col("score") / F.col("total")).alias("score"))  # one row


def pagerank_engine(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """K6: PageRank as graph engines give it: directed, weighted, from 1 - damping on, not divided by a sum."""
    shares = written(edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share").repartition("dst"), "shares")
    ids = cut_lineage(shares.select(F.col("src").alias("id")).union(shares.select("dst")).distinct())
    n = ids.count()
    rank = ids.withColumn("score", F.lit(1 - damping))
    for k in range(rounds):
        sums = _weighed(shares, rank, n, "share", "got")
        rank = ids.join(sums, ids.id == sums.dst, "left").select("id", (1 - damping + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if n > SENT or (k + 1) % cut_every == 0:
            rank = cut_lineage(rank)
    return rank


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """K5: power iteration with the norm taken in each round, in a fixed number of rounds.

    The edges are written once, by ``dst``; a round writes one row for each vertex, and the driver sees the norm.
    """
    shared = written(edges.select("src", "dst", "weight").repartition("dst"), "edges")
    rank = written(shared.select(F.col("src").alias("id")).union(shared.select("dst")).distinct().withColumn("score", F.lit(1.0)), "scores")
    n = rank.count()
    for _ in range(rounds):
        sums = written(_weighed(shared, rank, n, "weight", "s"), "scores")
        norm = sums.agg(F.sqrt(F.sum(F.col("s") * F.col("s")))).first()[0]
        rank = sums.select(F.col("dst").alias("id"), (F.col("s") / F.lit(norm).cast("double")).alias("score"))
    return rank


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """K9: each vertex takes the label with the most weight among its neighbours and itself; the smallest of equal ones.

    All vertices move at once, with their own label's weight counted once more, so two of them don't swap for ever. Stops
    when no label changes or after ``rounds``.
    """
    shared = cut_lineage(both_ways(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    labels = cut_lineage(shared.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = shared.join(labels, shared.dst == labels.id).select(F.col("src").alias("v"), "label", "weight").union(labels.select("id", "label", F.lit(1)))
        sums = votes.groupBy("v", "label").agg(F.sum("weight").alias("w"))
        best = sums.groupBy("v").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("new"))
        moved = cut_lineage(labels.join(best, labels.id == best.v).select("id", "label", "new"))
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.filter("label <> new").isEmpty():
            break
    return labels


def modularity_both(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition of a graph whose edges go both ways: one row."""
    total = edges.agg(F.sum("weight").alias("m2"))
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("label").alias("cb"))
    sums = edges.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("degree"))
    part = sums.crossJoin(F.broadcast(total)).select((F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2))).alias("q"))  # one row
    return part.agg(F.sum("q").alias("modularity"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition of an undirected graph (each edge once): one row."""
    return modularity_both(both_ways(edges), labels)


def community_stats(labels: DataFrame) -> DataFrame:
    """Number of communities and their sizes: one row."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("deviation"))


def bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """For each vertex with an edge to another community, how many communities and edges it reaches."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("label").alias("cb"))
    out = both_ways(edges).join(a, "src").join(b, "dst").filter("ca <> cb")
    return out.groupBy(F.col("src").alias("id")).agg(F.count_distinct("cb").alias("communities"), F.count(F.lit(1)).alias("edges"))


def bfs(edges: DataFrame, sources: DataFrame, depth: int | None = None, cap: int | None = None) -> DataFrame:
    """``source, id, depth, parent``: vertices within ``depth`` hops of each source (column ``id``), or all that it
    reaches; the parent is the smallest vertex one hop nearer, null for the source itself.

    One join in each round; visited pairs are anti-joined. ``cap`` keeps the first vertices of each source by (depth, id).
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    seen = front = cut_lineage(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    k = 0
    while depth is None or k < depth:
        k += 1
        step = front.join(e, front.id == e.src).groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut_lineage(step.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(k).alias("depth"), F.col("parent").cast("long").alias("parent")))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if k % 8 == 0:
            seen = cut_lineage(seen)
    if cap:
        rank = F.row_number().over(Window.partitionBy("source").orderBy("depth", "id"))
        seen = seen.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")
    return seen


def ego_edges(edges: DataFrame, ego: DataFrame) -> DataFrame:
    """Edges between vertices of the same source's set."""
    a, b = ego.select("source", F.col("id").alias("src")), ego.select("source", F.col("id").alias("dst"))
    return edges.join(a, "src").join(b, ["source", "dst"])


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Least total weight from each source to all vertices it reaches, by rounds of relaxation until none changes; only
    the vertices that came nearer in a round send on. Weights must not be negative."""
    e = cut_lineage(edges.select("src", "dst", "weight"))
    dist = front = cut_lineage(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")))
    while not front.isEmpty():
        step = front.join(e, front.id == e.src).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        x = cut_lineage(dist.join(step, ["source", "id"], "full_outer").select("source", "id", F.least("distance", "new").alias("distance"), (F.col("distance").isNull() | (F.col("new") < F.col("distance"))).alias("nearer")))
        dist, front = x.select("source", "id", "distance"), x.filter("nearer").select("source", "id", "distance")
    return dist


def simple_paths(edges: DataFrame, start: int, goal: int, depth: int = 4, most: int = 5) -> DataFrame:
    """Simple paths from ``start`` to ``goal`` of at most ``depth`` edges, the ``most`` shortest, with their weight."""
    e = edges.select("src", "dst", "weight")
    front = e.filter(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("weight").cast("double").alias("cost"))
    found = front.filter(F.col("at") == goal)
    for _ in range(depth - 1):
        front = front.filter(F.col("at") != goal).join(e, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = front.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("cost") + F.col("weight")).alias("cost"))
        found = found.union(front.filter(F.col("at") == goal))
    return found.select("path", (F.size("path") - 1).cast("long").alias("hops"), "cost").orderBy("hops", "cost", "path").limit(most)


def closeness(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """K4: reachable vertices over the sum of their distances, for the given sources, within ``depth`` hops or at any."""
    d = bfs(edges, sources, depth).filter("depth > 0")
    return d.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("reached"), (F.count(F.lit(1)) / F.sum("depth")).alias("closeness"))


def betweenness(edges: DataFrame, pivots: DataFrame, depth: int | None = None, block: int = 4096) -> DataFrame:
    """K3: shortest-path betweenness, summed over the given pivots as sources (all vertices: exact).

    Level by level for all pivots of a block at once, until none is left or to ``depth``: path counts on the way out,
    dependencies on the way back. The sums of each block, of about ``block`` pivots, are written before the next one.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    starts = cut_lineage(pivots.select("id").distinct())
    blocks = max(1, -(-starts.count() // block))
    sums = [cut_lineage(_dependencies(e, starts.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n), depth)) for n in range(blocks)]
    return reduce(DataFrame.union, sums).groupBy("id").agg(F.sum("dep").alias("betweenness"))


def _dependencies(e: DataFrame, pivots: DataFrame, depth: int | None) -> DataFrame:
    """``id, dep``: the part of all pivots' shortest paths that runs through each vertex."""
    return dependencies(e, pivots, depth).groupBy("id").agg(F.sum("dep").alias("dep"))


def dependencies(e: DataFrame, pivots: DataFrame, depth: int | None) -> DataFrame:
    """``s, id, dep``: the part of each pivot's shortest paths that runs through each other vertex."""
    level = cut_lineage(pivots.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.lit(0).alias("d")))
    levels = [level]
    while depth is None or len(levels) <= depth:
        step = level.join(e, level.v == e.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        # edges may go one way only, so all levels before count, not just the last two
        seen = reduce(DataFrame.union, [x.select("s", "v") for x in levels])
        level = cut_lineage(step.join(seen, ["s", "v"], "left_anti").withColumn("d", F.lit(len(levels))))
        if level.isEmpty():
            break
        levels.append(level)
    below = levels[-1].withColumn("dep", F.lit(0.0))
    out = below
    for level in reversed(levels[:-1]):
        part = level.select("s", "v", "paths", "d").join(e, F.col("v") == F.col("src")).join(below.select("s", F.col("v").alias("dst"), F.col("paths").alias("p2"), "dep"), ["s", "dst"])
        dep = part.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p2") * (1 + F.col("dep"))).alias("dep"))
        below = cut_lineage(level.join(dep, ["s", "v"], "left").fillna(0.0, ["dep"]))
        out = out.union(below.select(out.columns))
    return out.filter("s <> v").select("s", F.col("v").alias("id"), "dep")


def link_prediction(edges: DataFrame, least: float = 0.0, k: int = 5) -> DataFrame:
    """Scores of pairs that share a neighbour and have no edge; a hub's neighbours are paired block by block.

    Common neighbours (against the largest degree), Jaccard, Adamic-Adar (against its bound) and preferential attachment,
    with weights .25, .25, .20, .15 brought to a sum of 1; the ``k`` best of each vertex with at least ``least``.
    """
    e = both_ways(edges).select("src", "dst").distinct()
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    top = deg.agg(F.max("deg").alias("top"))
    wedges = pairs_within(e.select(F.col("dst").alias("u"), F.col("src").alias("i"))).join(deg.select(F.col("src").alias("u"), F.col("deg").alias("dz")), "u").select(F.col("src").alias("a"), F.col("dst").alias("b"), "dz")
    pairs = wedges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("dz") > 1, 1 / F.log("dz")).otherwise(0.0)).alias("aa"))
    pairs = pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    pairs = pairs.join(deg.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b").crossJoin(F.broadcast(top))  # one row
    cn, jac = F.col("common") / F.col("top"), F.col("common") / (F.col("da") + F.col("db") - F.col("common"))
    aa, pa = F.least(F.lit(1.0), F.col("aa") / (F.col("common") / math.log(2))), F.col("da") * F.col("db") / (F.col("top") * F.col("top"))
    score = (0.25 * cn + 0.25 * jac + 0.20 * aa + 0.15 * pa) / 0.85
    scored = pairs.select("a", "b", F.col("common"), jac.alias("jaccard"), F.col("aa").alias("adamic_adar"), (F.col("da") * F.col("db")).alias("preferential"), score.alias("score")).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def each_once(edges: DataFrame) -> DataFrame:
    """``src, dst`` with ``src < dst``: the edges of an undirected graph, each once, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def triangles(edges: DataFrame, once: bool = False, counted: bool = False, block: int = 1_000_000) -> DataFrame:
    """``a, b, c``: each triangle of an undirected graph once or, if ``counted``, sums ``id, n`` of a vertex's triangles, to be
    added up. ``once``: each edge is there once, as ``src < dst``, and was
    written, as it's read some times.

    Edges go from the vertex with the smaller degree, so that no vertex has more than about the square root of twice the
    edges to pair. Vertices are dealt into ranges of their ids with about ``block`` edges. A range gets its own vertices'
    lists of neighbours, and once each those of the vertices that they lead to; a task intersects the lists, so no path of
    two edges is shuffled. It holds its own lists; the others pass by.
    """
    pairs = edges.select("src", "dst") if once else written(each_once(edges), "pairs")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    ranges = max(1, -(-pairs.count() // block))
    bounds = np.array(ends.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else [])

    def placed(batches):
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["id", "deg", "place"])

    places = written(ends.select(F.col("id").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg")).mapInArrow(placed, "id long, deg long, place int"), "places")
    sent = F.broadcast(places) if places.count() <= SENT else places
    side = lambda k, c: sent.select(F.col("id").alias(k), F.struct("deg", "id", "place").alias(c))
    x = pairs.join(side("src", "x"), "src").join(side("dst", "y"), "dst").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("i"))
    home, none = F.col("u.place"), F.lit(None)
    rows = x.select(F.inline(F.array(
        F.struct(F.col("u.id").alias("v"), F.col("i.id").alias("k"), home.alias("at"), home.alias("home")),
        F.struct(F.col("i.id").alias("v"), none.cast("long").alias("k"), home.alias("at"), none.cast("int").alias("home")),
    )))
    lists = rows.groupBy("v").agg(F.collect_list("k").alias("out"), F.collect_set("at").alias("at"), F.max("home").alias("home")).filter(F.size("out") > 0)
    lists = lists.select(F.explode("at").alias("place"), "v", "out", "home").select("place", (F.col("place") != F.col("home")).alias("passes"), "v", "out")
    # own lists come twice: to be held, and to be looked up by the range's other vertices
    lists = lists.select("place", F.explode(F.when(F.col("passes"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("passes"), "v", "out")
    schema = "id long, n long" if counted else "a long, b long, c long"
    return lists.repartition(ranges, "place").sortWithinPartitions("place", "passes").mapInArrow(_intersected(counted), schema)


def _intersected(counted: bool):
    """Task over ``place, passes, v, out``, sorted: triangles of the vertices of each place, or sums of them by vertex."""

    def flat(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def spans(starts, lengths):
        return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())

    class Held:
        def __init__(self, batches):
            table = pa.Table.from_batches(batches)
            self.v, (out, self.sizes) = table.column("v").to_numpy(), flat(table.column("out"))
            self.names, self.out = np.unique(out, return_inverse=True)  # ends of own edges by their place among the names
            self.first = np.cumsum(self.sizes) - self.sizes
            owner = np.repeat(np.arange(len(self.v)), self.sizes)
            order = np.argsort(self.out, kind="stable")
            self.into = owner[order]  # own vertices by the name that they lead to
            self.from_ = np.searchsorted(self.out[order], np.arange(len(self.names) + 1))
            self.mark = np.zeros(len(self.names), bool)

        def meet(self, batch):
            """Triangles as places of the own vertex and of the two names."""
            at = np.searchsorted(self.names, batch.column(2).to_numpy(zero_copy_only=False))
            at[at == len(self.names)] = 0
            led = self.names[at] == batch.column(2).to_numpy(zero_copy_only=False)
            out, sizes = flat(batch.column(3))
            ends = np.searchsorted(self.names, out)
            ends[ends == len(self.names)] = 0
            ends[self.names[ends] != out] = -1
            stops = np.cumsum(sizes)
            for j in np.flatnonzero(led):
                near = ends[stops[j] - sizes[j] : stops[j]]
                near = near[near >= 0]
                us = self.into[self.from_[at[j]] : self.from_[at[j] + 1]]
                self.mark[near] = True
                place = spans(self.first[us], self.sizes[us])
                hit = self.mark[self.out[place]]
                self.mark[near] = False
                if hit.any():
                    yield np.repeat(us, self.sizes[us])[hit], np.full(hit.sum(), at[j]), self.out[place[hit]]

    def summed(ids, places):
        n = np.bincount(places, minlength=len(ids))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64))], ["id", "n"])

    def task(batches):
        key, waiting, held = None, [], None
        for whole in batches:
            places, passes = whole.column(0).to_numpy(zero_copy_only=False), whole.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (passes[1:] != passes[:-1])) + 1).tolist(), len(places)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if places[s] != key:
                    key, waiting, held = places[s], [], None
                batch = whole.slice(s, e - s)
                if not passes[s]:
                    waiting.append(batch)
                    continue
                held = held or (Held(waiting) if waiting else None)
                found = list(held.meet(batch)) if held else []
                if found:
                    u, i, k = map(np.concatenate, zip(*found))
                    if counted:
                        yield from (summed(held.v, u), summed(held.names, np.concatenate([i, k])))
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(held.v[u]), pa.array(held.names[i]), pa.array(held.names[k])], ["a", "b", "c"])

    return task


def clustering(edges: DataFrame, once: bool = False) -> DataFrame:
    """Degree, triangles and clustering coefficient of each vertex of an undirected graph; ``once`` as in ``triangles``."""
    pairs = written(edges.select("src", "dst") if once else each_once(edges), "pairs")
    deg = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    per = triangles(pairs, True, True).groupBy("id").agg(F.sum("n").alias("triangles"))
    x = deg.join(per, "id", "left").fillna(0, ["triangles"])
    d = F.col("degree")
    return x.withColumn("coefficient", F.when(d > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(0.0))


def subgraph_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Of the subgraph of each set of vertices (``source, id``): vertices, edges, density, mean degree, and eccentricity
    of the source (the farthest depth, where ``vertices`` has ``depth``): one row for each source."""
    once = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    inner = ego_edges(once, vertices).select("source", "src", "dst").distinct()
    n = vertices.groupBy("source").agg(F.count_distinct("id").alias("vertices"), F.max("depth").cast("long").alias("eccentricity"))
    m = inner.groupBy("source").agg(F.count(F.lit(1)).alias("edges"))
    x = n.join(m, "source", "left").fillna(0, ["edges"])
    v, k = F.col("vertices"), F.col("edges")
    return x.select("source", "vertices", "edges", F.when(v > 1, 2 * k / (v * (v - 1))).otherwise(0.0).alias("density"), (2 * k / v).alias("mean_degree"), "eccentricity")


# Strength of an edge's source, and least confidence by relationship type.
SOURCE_STRENGTH = {"activity": 1.0, "api": 0.95, "user_input": 0.85, "inference": 0.7, "embedding": 0.6}
DEFAULT_STRENGTH = 0.5


def edge_weight(rel: Column, position: Column, count: Column, score: Column) -> Column:
    """Weight of an edge by its type, 0.1 at least."""
    w = (
        F.when(rel == "AUTHORED", F.when(position == 1, 2.0).when(position <= 3, 1.5).otherwise(1.0))
        .when(rel == "CITES", F.least(F.lit(3.0), 1 + count * 0.1))
        .when(rel == "COLLABORATES_WITH", F.least(F.lit(5.0), count * 0.5))
        .when(rel.isin("ON_TOPIC", "RELATED_TO"), score * 2)
        .otherwise(1.0)
    )
    return F.greatest(F.lit(0.1), w)


def edge_confidence(sources: Column, confirmed: Column, inferred: Column, validated: Column) -> Column:
    """The strongest source, times 1.1 for several, 1.2 if confirmed, 0.8 if inferred and not validated; 1 at most."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_STRENGTH.items() for x in kv])
    base = F.coalesce(F.array_max(F.transform(sources, lambda s: F.coalesce(F.element_at(table, s), F.lit(DEFAULT_STRENGTH)))), F.lit(DEFAULT_STRENGTH))
    c = base * F.when(F.size(sources) > 1, 1.1).otherwise(1.0) * F.when(confirmed, 1.2).otherwise(1.0) * F.when(inferred & ~validated, 0.8).otherwise(1.0)
    return F.least(F.lit(1.0), c)


def inferred_weight(count: Column, age_days: Column, strength: Column) -> Column:
    """(1 + log10 n) halved for each year of age, times the strength of the context, in 0.1 to 5."""
    return F.least(F.lit(5.0), F.greatest(F.lit(0.1), (1 + F.log10(count)) * F.pow(F.lit(2.0), -age_days / 365) * strength))


def louvain_moves(edges: DataFrame, start: DataFrame, rounds: int = 16, least_moved: float = 0.02) -> DataFrame:
    """``id, label`` after local moves that raise modularity, from the labels of ``start`` (``id, label``) on. ``edges`` go
    both ways, each pair once.

    In each round a vertex looks at its neighbours' communities and moves to the one with the largest gain; half of the
    vertices, by a hash with the round, may move at once, so that two don't swap. A round is one written table: degrees and
    weights to the own vertex are found once, the communities' totals are summed from the last table, and the number of
    moved vertices is observed while the next one is written. Stops when two rounds in a row moved less than
    ``least_moved`` of the vertices, or after ``rounds``.
    """
    e = edges.filter("src <> dst")
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    labels = written(start.join(deg, "id"), "louvain")
    total, n = edges.agg(F.sum("weight")).first()[0] or 1.0, labels.count()
    idle = 0
    for k in range(rounds):
        held = bounded(labels, 100_000) if k == 0 or not small else F.broadcast(labels)
        small = held is not labels
        sums = labels.groupBy("label").agg(F.sum("k").alias("tot"))
        near = e.join(held.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("inside"))
        cand = near.join(held.select("id", F.col("label").alias("own"), "k"), "id").join(F.broadcast(sums) if small else sums, "label")
        gain = lambda tot: F.round(F.col("inside") - tot * F.col("k") / total, 9)
        stays = F.col("label") == F.col("own")
        best = cand.groupBy("id").agg(
            F.min(F.when(~stays, F.struct((-gain(F.col("tot"))).alias("loss"), "label"))).alias("best"),
            F.max(F.when(stays, F.col("inside"))).alias("inside"),
        )
        joined = labels.join(sums.withColumnRenamed("label", "own"), F.col("label") == F.col("own")).join(best, "id", "left")
        here = F.round(F.coalesce("inside", F.lit(0.0)) - (F.col("tot") - F.col("k")) * F.col("k") / total, 9)
        may = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0
        moves = may & F.coalesce(-F.col("best.loss") > here, F.lit(False))
        seen = Observation()
        new = joined.select("id", F.when(moves, F.col("best.label")).otherwise(F.col("label")).alias("label"), "k", moves.alias("moved")).observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved"))
        labels = written(new, "louvain").drop("moved")
        idle = idle + 1 if seen.get["moved"] <= least_moved * n else 0
        if idle == 2:
            break
    return labels.select("id", "label")


def louvain(edges: DataFrame, least_gain: float = 1e-6) -> DataFrame:
    """``id, label``: communities by local moves and contraction. ``edges`` go both ways.

    After the moves the communities become the vertices of a smaller graph, whose edges carry the sums, loops included;
    that repeats until modularity rises no more. Then single vertices move once more between the communities found, and
    what that gains is contracted again. A community is named by its smallest vertex.
    """
    e = written(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")), "louvain")
    labels = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.col("id"))
    best = -1.0
    for _ in ("single vertices", "single vertices between the communities found"):
        new = louvain_moves(e, labels)
        graph = contracted(e, new)
        while (q := _modularity_of_contracted(graph)) > best + least_gain:
            labels, best = new, q
            step = louvain_moves(graph, graph.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
            graph = contracted(graph, step)
            new = written(labels.join(step.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label")), "louvain")
    names = labels.groupBy("label").agg(F.min("id").alias("name"))
    return labels.join(names, "label").select("id", F.col("name").alias("label"))


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph whose vertices are the labels and whose edges, loops included, carry the sums of ``edges``."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return written(edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain")


def _modularity_of_contracted(graph: DataFrame) -> float:
    """Modularity of the communities that are the vertices of ``graph``, whose edges go both ways and carry sums."""
    per = graph.groupBy("src").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("degree").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("degree") * F.col("degree")).alias("d")).first()
    return row.i / row.m - row.d / row.m**2 if row.m else 0.0


def node2vec_walks(edges: DataFrame, starts: DataFrame, p: float = 1.0, q: float = 1.0, length: int = 10, per_vertex: int = 30, seed: int = 7) -> DataFrame:
    """``id, walk, path``: seeded second-order walks of ``length`` vertices over a graph whose ``edges`` go both ways.

    From the vertex before and the present one, a neighbour's weight is divided by ``p`` if it is the one before, kept if it
    is a neighbour of the one before, and divided by ``q`` else; the draw is the smallest of exponentials by hash. One join
    for the neighbours and one for the edges from the vertex before in each step; walks at a vertex without edges end.
    """
    e = cut_lineage(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")))
    back = e.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("known"))
    walks = starts.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_vertex))).alias("walk")).withColumn("path", F.array("id"))
    for step in range(1, length):
        x = walks.withColumn("here", F.element_at("path", -1)).withColumn("prev", F.try_element_at("path", F.lit(-2)))
        x = x.join(e, x.here == e.src, "left").join(back, ["prev", "dst"], "left")
        bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("dst") == F.col("prev"), 1.0 / p).when(F.col("known"), 1.0).otherwise(1.0 / q)
        uniform = (F.pmod(F.xxhash64(F.lit(seed), "id", "walk", F.lit(step), "dst"), F.lit(1_000_003)) + 1) / 1_000_004
        choice = F.min(F.when(F.col("dst").isNotNull(), F.struct((-F.log(uniform) / (F.col("weight") * bias)).alias("draw"), F.col("dst").alias("to"))))["to"]
        nxt = x.groupBy("id", "walk", "path").agg(choice.alias("to"))
        walks = nxt.select("id", "walk", F.when(F.col("to").isNotNull(), F.array_append("path", F.col("to"))).otherwise(F.col("path")).alias("path"))
        if step % 3 == 0:
            walks = cut_lineage(walks)
    return walks


def walk_vectors(walks: DataFrame, size: int = 128, window: int = 5, spread: int = 4) -> DataFrame:
    """``id, vector`` of unit length from walks: how often vertices are within ``window`` steps of each other, as positive
    pointwise mutual information, projected to ``size`` dimensions by hashing each context vertex to ``spread`` of them with
    a sign. All of it are sums by key: no vocabulary goes to the driver."""
    at = walks.select(F.posexplode("path").alias("i", "v"), "path")
    pairs = at.select("v", F.explode(F.concat(F.slice("path", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window))), F.slice("path", F.col("i") + 2, window))).alias("c"))
    counts = cut_lineage(pairs.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    side = lambda k: counts.groupBy(k).agg(F.sum("n").alias("n" + k))
    x = counts.join(side("v"), "v").join(side("c"), "c").crossJoin(F.broadcast(total))  # one row
    x = x.select("v", "c", F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("total") / (F.col("nv") * F.col("nc")))).alias("pmi"))
    places = F.explode(F.sequence(F.lit(1), F.lit(spread)))
    x = x.withColumn("k", places).withColumn("h", F.xxhash64("c", "k"))
    sums = x.groupBy("v", F.pmod("h", F.lit(size)).cast("int").alias("place")).agg(F.sum(F.when(F.pmod(F.shiftright("h", 20), F.lit(2)) == 0, F.col("pmi")).otherwise(-F.col("pmi"))).alias("s"))
    rows = sums.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return rows.select(F.col("v").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0)).alias("vector"))
