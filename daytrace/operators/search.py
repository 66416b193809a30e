"""Search over texts and vectors: BM25, cosine top-k, rank fusion, facets, clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut_lineage, join_groups, written
from .components import connected_components


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of ASCII, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """L2: the ``k`` best documents of each query (``query_id, query``) with their score.

    Only tokens of some query go on: the queries' distinct tokens are broadcast up to 10,000, and joined beyond that. Document lengths and the mean length are over all documents, the idf over those with the token.
    """
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    vocabulary = bounded(q.select("term").distinct())
    d = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    totals = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.select("id", "dl", F.explode("ts").alias("term")).join(vocabulary, "term").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    hits = scored.select("id", "term", part.alias("part")).join(bounded(q), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return top_k(hits, k)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; scores equal to nine digits in order of the identifier."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return hits.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, block: int = 4096) -> DataFrame:
    """L1: the ``k`` vectors (``id, vector``) nearest to each query (``query_id, query_vector``) by cosine, itself excluded.

    A stated query set against all vectors, in blocks: up to ``block`` queries at a time are a matrix that is broadcast. Tasks
    multiply it with batches of vectors and keep each query's ``k`` best, so what is shuffled is ``k`` rows for each query and
    task. Scores equal to nine digits are in order of the identifier; a zero vector has a score of 0.
    """
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    dealt = queries.select("query_id", "query_vector").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for part in range(blocks):
        rows = dealt.filter(F.col("part") == part).select("query_id", "query_vector").collect()
        ids = np.array([r.query_id for r in rows], np.int64)
        shared = spark.sparkContext.broadcast((ids, _unit(np.array([r.query_vector for r in rows], np.float64).reshape(len(rows), -1))))
        hits = vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_best(shared, k, threshold), "query_id long, id long, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(shared, k: int, threshold: float, tile: int = 256):
    """Each query's ``k`` best among a task's vectors; ``tile`` queries meet 1,024 vectors at a time, so a task's memory follows from
    these and from the ``k`` best, whatever the number of queries."""

    def task(batches):
        ids, q = shared.value
        # scores to nine digits, then identifiers, of each query's best so far
        best_s, best_i, best_x = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows if len(ids) else 0, 1024):
                part = batch.slice(start, 1024)
                own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                v = _unit(_matrix(part.column(1))).T
                for low in range(0, len(ids), tile):
                    at = slice(low, low + tile)
                    x = q[at] @ v
                    x[(x < threshold) | (ids[at, None] == own[None, :])] = -np.inf
                    s, i, x = np.hstack([best_s[at], np.round(x, 9)]), np.hstack([best_i[at], np.broadcast_to(own, x.shape)]), np.hstack([best_x[at], x])
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[at], best_i[at], best_x[at] = (np.take_along_axis(y, order, 1) for y in (s, i, x))
        hit = np.isfinite(best_s)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], hit.shape)[hit]), pa.array(best_i[hit]), pa.array(best_x[hit])], ["query_id", "id", "score"])

    return task


def fuse(first: DataFrame, second: DataFrame, k: int = 10, alpha: float = 0.7, constant: int = 60) -> DataFrame:
    """L3: reciprocal rank fusion of two ranked lists (``query_id, id, rank``)."""
    a, b = first.select("query_id", "id", F.col("rank").alias("ra")), second.select("query_id", "id", F.col("rank").alias("rb"))
    score = F.coalesce(alpha / (constant + F.col("ra")), F.lit(0.0)) + F.coalesce((1 - alpha) / (constant + F.col("rb")), F.lit(0.0))
    return top_k(a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", score.alias("score")), k)


def rerank(hits: DataFrame, boosts: dict[str, float], k: int = 10) -> DataFrame:
    """L4: score plus weighted numeric columns; nulls add nothing."""
    score = F.col("score")
    for name, weight in boosts.items():
        score = score + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return top_k(hits.withColumn("score", score).drop("rank"), k)


def expand_query(vectors: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The mean of each query's vector and its hits' vectors."""
    own = queries.select("query_id", F.col("query_vector").alias("vector"))
    all_vectors = own.unionByName(hits.select("query_id", "id").join(vectors.select("id", "vector"), "id").select("query_id", "vector"))
    by_place = all_vectors.select("query_id", F.posexplode("vector").alias("place", "x")).groupBy("query_id", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by_place.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("query_vector"))


def facets(hits: DataFrame, facet: str) -> DataFrame:
    """Hits of each query by the value of a facet."""
    return hits.groupBy("query_id", F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def diversify(hits: DataFrame, field: str, k: int = 10) -> DataFrame:
    """Each next result is the best one left whose field differs from the one before, else the best one left.

    A greedy choice over at most a query's top hits, folded in one row for each query.
    """
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.col(field).alias("f")))).alias("rest"))
    item = listed.schema["rest"].dataType
    start = F.struct(F.array().cast(item).alias("out"), F.col("rest").alias("rest"))

    def step(s, _):
        last = F.element_at(s["out"], -1)["f"]
        other = F.get(F.filter(s["rest"], lambda x: ~x["f"].eqNullSafe(last)), 0)
        chosen = F.when(F.size(s["out"]) == 0, F.get(s["rest"], 0)).otherwise(F.coalesce(other, F.get(s["rest"], 0)))
        return F.when(F.size(s["rest"]) == 0, s).otherwise(F.struct(F.concat(s["out"], F.array(chosen)).alias("out"), F.filter(s["rest"], lambda x: x["id"] != chosen["id"]).alias("rest")))

    out = listed.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["out"]).alias("out"))
    return out.select("query_id", F.posexplode("out").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("long").alias("rank"), F.col("x.id").alias("id"), F.col("x.f").alias(field))


def overlap_scores(docs: DataFrame, query: str, least: float = 0.1) -> DataFrame:
    """``query_id, id, score``: 0.6 of the query's terms in the title, 0.4 in the text, and a bonus of 0.3 or 0.1 for the
    whole phrase; 1 at most. Row by row, without a shuffle."""
    low = query.lower()
    terms = F.lit(sorted(set(low.split()))) if low.split() else F.array().cast("array<string>")
    share = lambda c: F.size(F.array_intersect(terms, tokens(F.coalesce(c, F.lit(""))))) / max(1, len(set(low.split())))
    bonus = F.when(F.contains(F.lower("title"), F.lit(low)), 0.3).otherwise(0.0) + F.when(F.contains(F.lower("text"), F.lit(low)), 0.1).otherwise(0.0)
    scored = docs.select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.least(F.lit(1.0), 0.6 * share(F.col("title")) + 0.4 * share(F.col("text")) + F.coalesce(bonus, F.lit(0.0))).alias("score"))
    return scored.filter(F.col("score") >= least)


def term_overlap(docs: DataFrame, query: str, least: float = 0.1, k: int = 10) -> DataFrame:
    """The ``k`` best of ``overlap_scores``; partitions keep their own best before they meet."""
    return top_k(overlap_scores(docs, query, least), k)


def dbscan(points: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """``id, cluster`` from points and the pairs (``a, b``) within reach; -1 is noise.

    A core has ``least`` points within reach, itself included. Cores in reach of each other are one cluster, named by its
    smallest core; a border point joins the smallest cluster that it reaches.
    """
    pairs = written(pairs.select("a", "b"), "near")
    both = pairs.union(pairs.select("b", "a")).filter("a <> b").distinct()
    cores = points.select("id").join(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= least).select("id")
    inner = both.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    roots = cores.join(connected_components(inner).withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    border = both.join(cores.withColumnRenamed("id", "a"), "a", "left_anti").join(roots.withColumnsRenamed({"id": "b", "cluster": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("cluster"))
    return points.select("id").join(roots.union(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def eps_pairs(vectors: DataFrame, eps: float = 0.35, pivots: int = 64, block: int = 4096, chained: bool = False) -> DataFrame:
    """``a, b``: the pairs of vectors (``id, vector``) with a cosine distance of at most ``eps``; exact. If ``chained``, pairs that
    chain the same vectors together, at most one for each vector of a pair of blocks, however many are alike.

    Each vector is at home in the cell of the nearest of ``pivots`` vectors, chosen by hash; vectors are packed by cell and
    angle into blocks, written once. By the triangle inequality of angles, a vector within ``eps`` of one of a block is no
    farther from the block's pivot than the block's farthest and the angle of ``eps``. Pairs of blocks where that holds for
    some are compared as a product of matrices of what does; a cross join reads the two blocks, and nothing is shuffled for
    it. Vectors that lie all apart from one another are compared in all pairs of blocks.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(vectors.select(F.col("id").cast("long").alias("id"), "vector"))
    centres = np.array([r.vector for r in rows.orderBy(F.xxhash64("id")).limit(pivots).collect()], np.float64)
    if not len(centres):
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    shared, reach = spark.sparkContext.broadcast(_unit(centres)), float(np.arccos(np.clip(1 - eps, -1, 1))) + 1e-7

    def angles(x):
        return np.arccos(np.clip(x @ shared.value.T, -1, 1))

    def at_home(batches):
        for batch in batches:
            if batch.num_rows:
                x = angles(_unit(_matrix(batch.column(1))))
                home = x.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(x[np.arange(len(x)), home]), *batch.columns], ["cell", "angle", "id", "vector"])

    def packed(batches):
        held, n = [], 0
        place = TaskContext.get().partitionId() << 32

        def one():
            table = pa.Table.from_batches(held).combine_chunks()
            x = _unit(_matrix(table.column("vector").combine_chunks()))
            near = angles(x).min(axis=0)
            ids = table.column("id").to_numpy().astype("<i8")
            row = [[place], [int(table.column("cell")[0].as_py())], [float(table.column("angle").to_numpy().max())], [near.tolist()], [ids.tobytes()], [x.astype("<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary()])], ["place", "cell", "far", "near", "ids", "x"])

        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:]):
                while s < e:
                    if held and (n == block or held[0].column(0)[0].as_py() != cells[s]):
                        yield one()
                        place, held, n = place + 1, [], 0
                    stop = min(e, s + block - n)
                    held.append(batch.slice(s, stop - s))
                    n, s = n + stop - s, stop
        if held:
            yield one()

    kind = dict(rows.dtypes)["vector"]
    homes = rows.mapInArrow(at_home, f"cell int, angle double, id long, vector {kind}")
    parts = max(1, -(-rows.count() // block))
    packs = homes.repartitionByRange(parts, "cell", "angle").sortWithinPartitions("cell", "angle").mapInArrow(packed, "place long, cell int, far double, near array<double>, ids binary, x binary")
    packs = written(packs, "blocks")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[k], "<i8") for k in ("ids", "ids2")]
                x = [np.frombuffer(r[k], "<f8").reshape(len(i), -1) for k, i in zip(("x", "x2"), ids)]
                same = r["place"] == r["place2"]
                pivot = shared.value[[r["cell"], r["cell2"]]]
                left = np.flatnonzero(np.arccos(np.clip(x[0] @ pivot[1], -1, 1)) <= r["far2"] + reach)
                right = np.flatnonzero(np.arccos(np.clip(x[1] @ pivot[0], -1, 1)) <= r["far"] + reach)
                mine, rough = x[0][left], x[1][right].astype(np.float32)
                label = np.arange(len(ids[0]) + len(ids[1]))
                for start in range(0, len(left), 512):
                    # single precision leaves out most; what is near the bound is computed again
                    i, j = np.nonzero(mine[start : start + 512].astype(np.float32) @ rough.T >= 1 - eps - 1e-4)
                    i, j = left[start + i], right[j]
                    for k in range(0, len(i), 1 << 17):
                        u, v = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
                        keep = (ids[0][u] != ids[1][v]) & ((u < v) | (not same)) & (1 - np.einsum("ij,ij->i", x[0][u], x[1][v]) <= eps)
                        u, v = u[keep], v[keep]
                        if chained:
                            label = _chained(label, u, v if same else v + len(ids[0]))
                        else:
                            a, b = ids[0][u], ids[1][v]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                if chained:
                    both = np.concatenate(ids)
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    a, b = both[label[moved]], both[moved]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    other = packs.withColumnsRenamed({c: c + "2" for c in packs.columns})
    near = (F.get("near2", F.col("cell")) <= F.col("far") + reach) & (F.get("near", F.col("cell2")) <= F.col("far2") + reach)
    met = packs.crossJoin(other).filter((F.col("place") <= F.col("place2")) & near)
    return met.select("place", "place2", "cell", "cell2", "far", "far2", "ids", "ids2", "x", "x2").mapInArrow(compare, "a long, b long").filter("a <> b").distinct()


def _chained(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place is chained to, after the pairs ``a, b`` were added to ``label``."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def cluster_members(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """``id, cluster, label, similarity`` of each point in a cluster to its cluster's centroid, the mean of its vectors.

    Centroids are sums by cluster and dimension; a vector without length is at a similarity of 0.
    """
    x = cut_lineage(points.select("id", "label", "vector").join(clusters.filter("cluster <> -1"), "id"))
    sums = x.select("cluster", F.posexplode("vector").alias("k", "v")).groupBy("cluster", "k").agg(F.sum(F.col("v").cast("double")).alias("v"))
    centre = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("centre"))
    sizes = x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    met = join_groups(x, cut_lineage(centre.join(sizes, "cluster")), ["cluster"], "n", x.count())
    return met.select("id", "cluster", "label", _cosine("vector", "centre").alias("similarity"))


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def cluster_report(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster, and one for the noise (-1): ``cluster, size, coherence, dominant_type, title, types``.

    Coherence is the mean similarity of all pairs: the squared length of the sum of unit vectors less their own squares, over
    the number of pairs, so no pair is made; 1 for a single point. The dominant type is the most frequent label, of equal
    ones that of the smallest identifier; the title names the point nearest to the centroid.
    """
    near = cluster_members(points, clusters)
    best = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.round("similarity", 3)).alias("s"), "id"))["id"].alias("nearest"))
    kinds = near.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    kinds = kinds.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "label"))["label"].alias("dominant_type"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("label").cast("string"), "n"))), ",").alias("types"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    unit = points.select("id", "vector").join(clusters.filter("cluster <> -1"), "id").withColumn("norm", norm).filter("norm > 0")
    dims = unit.select("cluster", F.posexplode("vector").alias("k", "v"), "norm").groupBy("cluster", "k").agg(F.sum(F.col("v").cast("double") / F.col("norm")).alias("s"))
    sums = dims.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("length")).join(unit.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")), "cluster")
    x = best.join(kinds, "cluster").join(sums, "cluster", "left")
    pairs = F.col("size") * (F.col("size") - 1)
    coherence = F.when(F.col("size") > 1, (F.coalesce("length", F.lit(0.0)) - F.coalesce("m", F.lit(0))) / pairs).otherwise(1.0)
    title = F.concat(F.initcap(F.col("dominant_type").cast("string")), F.lit(" cluster: "), F.col("nearest").cast("string"))
    out = x.select("cluster", "size", F.round(coherence, 3).alias("coherence"), F.col("dominant_type").cast("string").alias("dominant_type"), title.alias("title"), "types")
    noise = clusters.filter("cluster = -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return out.unionByName(noise, allowMissingColumns=True)
