"""Skip-gram vectors: cliques apart, a falling loss, and blocks of parameters that change nothing but the draws."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.operators import graph as G
from daytrace.operators import skipgram as K


@pytest.fixture(scope="module")
def cliques(spark):
    pairs = [(a, b, 5) for half in (range(10), range(10, 20)) for a, b in combinations(half, 2)] + [(9, 10, 1)]
    edges = G.both_ways(spark.createDataFrame(pairs, "src long, dst long, weight long"))
    walks = G.node2vec_walks(edges, edges.select(F.col("src").alias("id")).distinct(), length=6, per_vertex=4)
    return K.context_pairs(walks, 3).cache()


@pytest.mark.parametrize("block,block_pairs", [(4096, 2_000_000), (7, 2_000_000), (4096, 60)])
def test_cliques_lie_apart(cliques, block, block_pairs):
    found, losses = K.skip_gram(cliques, 128, 6, block=block, block_pairs=block_pairs, batch=64)
    rows = {r.id: np.array(r.vector) for r in found.collect()}
    assert len(rows) == 20 and all(len(v) == 128 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in rows.values())
    assert losses[-1] < losses[0] * 0.9 and all(b < a * 1.05 for a, b in zip(losses, losses[1:]))
    for v in set(rows) - {9, 10}:
        near = sorted((u for u in rows if u != v), key=lambda u: -rows[v] @ rows[u])[:5]
        assert all((u < 10) == (v < 10) for u in near)


def test_pairs_by_hand(spark):
    walks = spark.createDataFrame([(1, 1, [1, 2, 1, 3])], "id long, walk int, path array<long>")
    assert {tuple(r) for r in K.context_pairs(walks, 1).collect()} == {(1, 2, 2), (2, 1, 2), (1, 3, 1), (3, 1, 1)}


def test_same_vectors_again_and_none(spark, cliques):
    one, two = ({r.id: r.vector for r in K.skip_gram(cliques.repartition(n), 16, 2, block=7)[0].collect()} for n in (1, 5))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-4) for k in one)
    assert K.skip_gram(cliques.filter("v < 0"))[0].count() == 0
