import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import topk
from roadweave.llm.queries import op9_exact_top_k

SF = "/root/testdata/sf0.01"


def brute(q, qi, p, pi, k):
    out = set()
    for x, i in zip(q.tolist(), qi, strict=True):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for y, j in zip(p.tolist(), pi, strict=True) if i != j)[:k]
        out |= {(int(i), int(j), -s) for s, j in best}
    return out


@pytest.mark.parametrize("seed,spread", [(0, 3), (1, 300), (2, 2**29)])
def test_block_matches_brute_force(seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread + 1, (12, 5))
    p = np.repeat(centres, 40, axis=0) + rng.integers(-1, 2, (480, 5))
    p[:100] = p[0]
    ids = rng.permutation(480)
    got, products = topk.block_top_k(p[::3], ids[::3], p, ids, 4)
    assert 0 < products <= 160 * 480
    got = (ids[::3][got[0]], *got[1:])
    assert set(zip(*(x.tolist() for x in got), strict=True)) == brute(p[::3], ids[::3], p, ids, 4)


def clustered(rng, clusters, each, dim=16):
    centres = rng.normal(size=(clusters, dim))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    x = np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, dim)) * 0.01
    return np.floor(256 * x).astype(np.int64)


def test_tree_prunes_clusters():
    """Where vectors hang together, most pairs are dropped by the bounds."""
    x = clustered(np.random.default_rng(5), 30, 600)
    ids = np.arange(len(x))
    got, products = topk.block_top_k(x[::20], ids[::20], x, ids, 5)
    scores = x[::20] @ x.T
    scores[np.arange(900), ids[::20]] = -(10**9)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    want = {(i, int(j), int(scores[i, j])) for i in range(900) for j in best[i]}
    assert set(zip(*(c.tolist() for c in got), strict=True)) == want
    assert products < 0.1 * scores.size
    again, fewer = topk.block_top_k(x[::20], ids[::20], x, ids, 5, scores[np.arange(900), best[:, 4]])
    assert fewer <= products and set(zip(*(c.tolist() for c in again), strict=True)) == want


def test_blocks_are_pruned_before_they_are_sent(spark, monkeypatch):
    x = clustered(np.random.default_rng(6), 12, 60)
    kept = []
    pairs = topk.surviving_pairs
    monkeypatch.setattr(topk, "surviving_pairs", lambda q, c, *a: kept.append((q.join(c, "dim").count(), (out := pairs(q, c, *a)).count())) or out)
    df = spark.createDataFrame([(i, 16, v) for i, v in enumerate(x.tolist())], "id long, dim int, x array<long>")
    got = topk.top_k(df.where("id % 10 = 0"), df, 5, query_block=50, candidate_block=60).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == brute(x[::10], range(0, len(x), 10), x, range(len(x)), 5)
    (every, some), = kept
    assert every >= 144 and some < 0.4 * every


def test_tree_covers_and_separates():
    x = np.random.default_rng(3).normal(size=(2000, 4))

    def walk(node):
        assert np.sqrt(((x[node.rows] - x[node.centre]) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows) and node.children[0].centre == node.centre
            gaps = [np.sqrt(((x[a.centre] - x[b.centre]) ** 2).sum()) for a in node.children for b in node.children if a is not b]
            assert min(gaps) >= max(c.radius for c in node.children) - 1e-9
        for c in node.children:
            walk(c)

    walk(topk.cover_tree(x))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = {tuple(r) for r in con.execute(topk.SQL).fetchall()}
    got = op9_exact_top_k(spark, SF)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want and got.count() == len(want)


def test_blocks_nulls_ties_and_empty(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(i % 3), 1.0], i) for i in range(40)] + [(50, None, 0), (51, [1.0, None], 0), (52, [nan, 1.0], 0), (53, [inf, 0.0], 0), (54, [2.0], 0), (None, [1.0, 1.0], 0), (55, [], 0)]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), "vec_id", "embedding")
    got = topk.top_k(df.where("id % 10 = 0"), df, 5, query_block=2, candidate_block=7).collect()
    pts = [(i, [(i % 3) * 256, 256]) for i in range(40)]
    want = brute(np.array([x for i, x in pts if i % 10 == 0]), [i for i, _ in pts if i % 10 == 0], np.array([x for _, x in pts]), [i for i, _ in pts], 5)
    assert {(r.query_id, r.vec_id, r.score) for r in got} == want
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 4)
    assert topk.top_k(df.where(F.lit(False)), df).count() == 0


def test_repeated_ids_and_rows(spark):
    """Every row is a candidate, and every row with a query's id a query; only the query's own row is left out."""
    rows = [(0, [2.0, 1.0]), (1, [0.5, 0.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (0, [1.0, -2.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]
    rows += [(100, [1.0, 0.0])] * 9 + [(None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.execute(topk.SQL).fetchall()
    v = topk.integers(df, "vec_id", "embedding")
    for blocks in ((4096, 8192), (2, 3)):
        got = topk.top_k(v.where("id % 50 = 0"), v, 5, *blocks).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(got) == 5 * 13
