"""Operator 3 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import hnsw


def brute(ids, v, k=5):
    norm = np.linalg.norm(v, axis=1)
    for i in np.flatnonzero(ids % 50 == 0):
        score = v @ v[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]][:k]
        yield ids[i], ids[order], score[order]


def test_recall(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows = hnsw.op3_hnsw_search(spark, sf).orderBy("query_id", "rank").collect()
    hit = total = 0
    for q, ids, scores in brute(p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float)):
        got = [r for r in rows if r.query_id == q]
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        hit, total = hit + len({r.vec_id for r in got} & set(ids)), total + len(ids)
        for r in got:
            assert -1.0000001 <= r.score <= 1.0000001
    assert hit / total >= 0.9


def test_shards_of_clusters_and_copies(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 16)) * 5
    v = (centres[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16)) * 0.3).astype(np.float32)
    v[1000:2000] = v[0]  # a third of the rows is one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    rows = hnsw.search(df, df.where("vec_id % 50 = 0"), shard_rows=700).collect()
    hit = total = 0
    for q, ids, scores in brute(np.arange(3000), v.astype(float)):
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        if q == 0 or 1000 <= q < 2000:
            assert [x.vec_id for x in got] == list(ids)
        hit, total = hit + len({x.vec_id for x in got} & set(ids.tolist())), total + 5
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (150, []), (9, [2.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "shard": F.lit("x")})
    rows = hnsw.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 7), (0, 2, 8), (0, 3, 9), (0, 4, 50), (50, 1, 8), (50, 2, 9), (50, 3, 0), (50, 4, 7)]
    assert abs(rows[1].score - 0.5**0.5) < 1e-12
    assert hnsw.search(df.where("false"), df.where("false")).count() == 0


def test_graphs_grow_by_insertion():
    """Links point to nodes of the level, not to the node itself, in bounded number; one build is like another; every node is found from the entries."""
    import pyarrow as pa

    r = np.random.default_rng(9)
    v = r.normal(size=(1500, 12))
    t = pa.table({"id": np.arange(1500), "v": pa.array(v.tolist()), "shard": np.zeros(1500, np.int32)})
    row = hnsw.build(t).to_pylist()[0]
    assert row == hnsw.build(t).to_pylist()[0]
    shard = hnsw.Shard(row["dim"], row["ids"], row["starts"], row["vectors"], row["nodes"], row["links"])
    assert len(shard.nodes) > 1
    for k, (nodes, links) in enumerate(zip(shard.nodes, shard.links)):
        assert links.shape == (len(nodes), hnsw.LINKS * (2 if k == 0 else 1)) and links.max() < len(nodes)
        assert not (links == np.arange(len(nodes))[:, None]).any()
        assert all(len(set(x[x >= 0])) == (x >= 0).sum() > 0 for x in links)
    found = list(shard.search(np.full(1500, -1), v, 1, hnsw.BEAM))
    assert np.mean([best[0] == i for i, (_, best, _) in enumerate(found)]) > 0.99


def test_small_graphs():
    import pyarrow as pa

    for n in (1, 2, 3, 33, 40):
        v = np.random.default_rng(n).normal(size=(n, 4))
        row = hnsw.build(pa.table({"id": np.arange(n) * 7919, "v": pa.array(v.tolist()), "shard": np.zeros(n, np.int32)})).to_pylist()[0]
        shard = hnsw.Shard(row["dim"], row["ids"], row["starts"], row["vectors"], row["nodes"], row["links"])
        for i, (_, best, _) in enumerate(shard.search(np.full(n, -1), v, min(5, n), hnsw.BEAM)):
            assert best[0] == shard.ids[shard.starts[np.flatnonzero((shard.v == v[i]).all(axis=1))[0]]] and len(best) == min(5, n)
