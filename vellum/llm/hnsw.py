"""Approximate nearest neighbours: one navigable small-world graph a shard, results merged.

Rows are dealt to shards of bounded size by id hash. A shard's graph is hierarchical: each
level holds a sixteenth of the level below. Nodes are inserted: each searches the graph so far for
candidates, and its links, kept as one flat neighbour array a level, are chosen so that they point
in different directions. Queries go through every
shard in blocks, descend the levels and explore the lowest with a beam; the shards'
answers are ranked together by exact cosine. Equal vectors of a shard are one node, so a
very common vector costs no more than a rare one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, table

#: Rows of a shard, queries of a block, blocks that meet a shard in one task: memory bounds.
SHARD_ROWS, BLOCK_QUERIES, PART_BLOCKS = 4096, 512, 16
#: Links chosen for a node (twice as many on the lowest level, with those that point back), candidates they are chosen from, beam width.
LINKS, CANDIDATES, BEAM = 16, 48, 96
#: Nodes expanded in one step of the beam search; entries of a search; nodes linked at once at first, and inserted together at most.
STEP, ENTRIES, SEED, BATCH = 4, 16, 32, 256


def levels_of(ids: np.ndarray) -> np.ndarray:
    """A geometric level for each node, from its id alone."""
    h = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int)


def choose(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours (-1 where there is none) of the nodes ``own`` among their candidates ``near`` (-1 for none).

    Candidates are taken from the nearest on. One that is closer to a taken one than to the node adds no direction
    and is passed over; where room is left, the nearest of those fill it.
    """
    sims = np.where(near >= 0, np.einsum("bid,bd->bi", x[near], x[own]), -np.inf)
    order = np.lexsort((near, -sims), axis=1)
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    there = near >= 0
    among = np.einsum("bid,bjd->bij", x[near], x[near], optimize=True)
    taken = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        hidden = (taken[:, :j] & (among[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
        taken[:, j] = there[:, j] & ~hidden & (taken.sum(axis=1) < most)
    first = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(own), most), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(near, first, 1)
    return out


def insert_all(x: np.ndarray, most: int, entries_of) -> np.ndarray:
    """The neighbour array (n, most) of a level, by inserting its nodes in their order, in batches that double with the graph.

    A batch searches the graph so far, from ``entries_of(nodes, size)``, for its candidates; those of one batch are candidates
    for each other too, as if they had come one after the other. Chosen links are added in both directions, and a node with
    too many chooses anew among all it has.
    """
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    done = 0
    while done < n:
        new = np.arange(done, min(n, done + max(1, min(done, BATCH)) if done else min(n, SEED)))
        within = x[new] @ x[new].T
        np.fill_diagonal(within, -np.inf)
        mates = new[np.argsort(-within, axis=1, kind="stable")[:, : min(CANDIDATES, max(0, len(new) - 1))]]
        if done:
            found, _ = beam_search(x[:done], links[:done], x[new], entries_of(new, done), CANDIDATES)
            mates = np.concatenate([found, mates], axis=1)
        links[new, :LINKS] = choose(x, new, mates, LINKS)  # the rest is room for those that choose it
        _link_back(x, links, new)
        done = int(new[-1]) + 1
    return links


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Make the links of new nodes known to those they point to."""
    most = links.shape[1]
    row, place = np.nonzero(links[new] >= 0)
    source, target = new[row], links[new[row], place]
    known = (links[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    changed, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = int(count.max(initial=0))
    rank = np.arange(len(target)) - np.repeat(first, count)
    more = np.full((len(changed), wide), -1, np.int64)
    more[np.repeat(np.arange(len(changed)), count), rank] = source
    for a in range(0, len(changed), 256):
        own = changed[a : a + 256]
        every = np.concatenate([links[own], more[a : a + 256]], axis=1)
        every = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        every = every[:, : max(most, int((every >= 0).sum(axis=1).max()))]
        full = (every >= 0).sum(axis=1) > most
        links[own[~full]] = every[~full, :most]
        if full.any():
            links[own[full]] = choose(x, own[full], every[full], most)


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities (best first) that a beam of each query reaches from its entries; -1 where none."""
    q = len(queries)
    seen = np.zeros((q, len(x) + 1), bool)
    seen[:, -1] = True
    rows = np.arange(q)[:, None]

    def scored(nodes: np.ndarray) -> np.ndarray:
        return np.where(nodes >= 0, np.einsum("qmd,qd->qm", x[nodes], queries[: len(nodes)]), -np.inf)

    beam = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    beam[:, : entries.shape[1]] = entries[:, :width]
    sims[:, : entries.shape[1]] = scored(beam[:, : entries.shape[1]])
    seen[rows, beam] = True
    open_ = beam >= 0
    while True:
        best = np.where(open_, sims, -np.inf)
        pick = np.argpartition(-best, min(STEP, width) - 1, axis=1)[:, :STEP]
        valid = np.take_along_axis(best, pick, 1) > -np.inf
        live = np.flatnonzero(valid.any(axis=1))
        if not len(live):
            break
        pick, valid = pick[live], valid[live]
        open_[live[:, None], pick] = False
        nodes = np.where(valid, beam[live[:, None], pick], -1)
        around = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1).astype(np.int64)
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around[seen[live[:, None], around]] = -1
        seen[live[:, None], around] = True
        fresh = np.where(around >= 0, np.einsum("qmd,qd->qm", x[around], queries[live]), -np.inf)
        all_sims = np.concatenate([sims[live], fresh], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        beam[live] = np.take_along_axis(np.concatenate([beam[live], around], axis=1), keep, 1)
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], around >= 0], axis=1), keep, 1)
        beam[~np.isfinite(sims)] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1), np.take_along_axis(sims, order, 1)


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def distinct_rows(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, and the sorted distinct ids of each as flat ids with starts."""
    marks = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
    _, first, node = np.unique(marks, return_index=True, return_inverse=True)
    order = np.lexsort((ids, node))
    node, ids = node[order], ids[order]
    keep = np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])])
    node, ids = node[keep], ids[keep]
    return v[first], ids, np.searchsorted(node, np.arange(len(first) + 1))


def build(t: pa.Table) -> pa.Table:
    """One shard's index: distinct vectors, their ids, and for each level its nodes and flat neighbour array."""
    v, ids, starts = distinct_rows(t.column("id").to_numpy(), vectors_of(t.column("v")))
    x = unit(v)
    level = levels_of(ids[starts[:-1]])
    top = min(int(level.max()), int(np.sort(level)[-min(len(level), 2)]))  # a level of one node has no links
    nodes: list[np.ndarray] = [np.flatnonzero(level >= k).astype(np.int32) for k in range(top + 1)]
    links: list[np.ndarray] = [np.empty(0)] * (top + 1)
    for k in range(top, -1, -1):
        # nodes of higher levels come first: the level above then leads to nodes that are in the graph already
        order = nodes[k][np.argsort(-level[nodes[k]], kind="stable")]
        place = np.full(len(x), -1)
        place[order] = np.arange(len(order))

        def entries_of(new: np.ndarray, size: int, k=k, order=order, place=place) -> np.ndarray:
            if k == top or size < np.count_nonzero(level[nodes[k]] > k):
                return np.broadcast_to(np.arange(min(size, ENTRIES)), (len(new), min(size, ENTRIES)))
            above = nodes[k + 1]
            start = np.broadcast_to(np.arange(min(len(above), ENTRIES)), (len(new), min(len(above), ENTRIES)))
            found, _ = beam_search(x[above], links[k + 1], x[order[new]], start, 2 * ENTRIES)
            return np.where(found[:, :ENTRIES] >= 0, place[above[found[:, :ENTRIES]]], -1)

        in_order = insert_all(x[order], 2 * LINKS if k == 0 else LINKS, entries_of)
        by_node = np.where(in_order >= 0, np.searchsorted(nodes[k], order[in_order]), -1).astype(np.int32)
        links[k] = by_node[place[nodes[k]]]
    nodes, links = [n.tobytes() for n in nodes], [near.tobytes() for near in links]
    columns = {"dim": [v.shape[1]], "shard": [t.column("shard")[0].as_py()], "ids": [ids.tobytes()], "starts": [starts.tobytes()], "vectors": [v.tobytes()], "nodes": [nodes], "links": [links]}
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns.values(), kinds)], names=list(columns))


class Shard:
    def __init__(self, dim: int, ids: bytes, starts: bytes, vectors: bytes, nodes: list[bytes], links: list[bytes]):
        self.ids, self.starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
        self.v = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.x, self.norm = unit(self.v), np.sqrt((self.v * self.v).sum(axis=1))
        self.nodes = [np.frombuffer(n, np.int32) for n in nodes]
        self.links = [np.frombuffer(b, np.int32).reshape(len(n), -1) for n, b in zip(self.nodes, links)]

    def search(self, ids: np.ndarray, v: np.ndarray, k: int, width: int):
        """Rows (query id, id, score): each query's k best of this shard."""
        q = unit(v)
        top = self.nodes[-1]
        entries = np.broadcast_to(np.arange(min(len(top), width)), (len(q), min(len(top), width)))
        for level in range(len(self.nodes) - 1, 0, -1):
            found, _ = beam_search(self.x[self.nodes[level]], self.links[level], q, entries, max(16, entries.shape[1]) if level > 1 else 32)
            entries = np.where(found[:, :16] >= 0, self.nodes[level][found[:, :16]], -1)
            if level > 1:
                entries = np.where(entries >= 0, np.searchsorted(self.nodes[level - 1], entries), -1)
        found, _ = beam_search(self.x, self.links[0], q, entries, width)
        norms = np.sqrt((v * v).sum(axis=1))
        for i in range(len(q)):
            nodes = found[i][found[i] >= 0]
            scores = (self.v[nodes] * v[i]).sum(axis=1) / (self.norm[nodes] * norms[i])
            members = [self.ids[self.starts[n] : min(self.starts[n + 1], self.starts[n] + k + 1)] for n in nodes]
            own = np.concatenate(members)
            score = np.repeat(scores, [len(m) for m in members])
            own, score = own[own != ids[i]], score[own != ids[i]]
            best = np.lexsort((own, -score))[:k]
            yield int(ids[i]), own[best], score[best]


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v, dim) that take part."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, width: int = BEAM) -> DataFrame:
    """The k rows of largest cosine for each query, among all rows of other ids.

    Returns query_id, rank (from 1, ties to the smaller id), vec_id and score, the cosine of
    the original vectors in double precision. Rows whose id or vector is null, zero, or holds
    null or non-finite components take no part; vectors only meet those of the same length;
    rows repeated with id and vector count once. Empty tables give an empty result; other
    columns are never read.
    """
    base = valid(rows, id_col, vector_col)
    asked = valid(queries, id_col, vector_col)
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    index_schema = "dim int, shard int, ids binary, starts binary, vectors binary, nodes array<binary>, links array<binary>"
    index = cut(base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(build, index_schema))

    def packed(t: pa.Table) -> pa.Table:
        ids, v = t.column("id").to_numpy(), vectors_of(t.column("v"))
        return pa.Table.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["qdim", "block", "qids", "qv"])

    once = asked.dropDuplicates(["id", "v"])
    dealt = once.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks))).groupBy("dim", "block").applyInArrow(packed, "qdim int, block long, qids binary, qv binary")
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to")).withColumn("part", F.floor(F.col("block") / PART_BLOCKS))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // PART_BLOCKS).cast("long"))))

    def answers(shard: pa.Table, asked: pa.Table) -> pa.Table:
        found: list = []
        if shard.num_rows and asked.num_rows:
            row = shard.to_pylist()[0]
            own = Shard(*(row[c] for c in ("dim", "ids", "starts", "vectors", "nodes", "links")))
            for qids, qv in zip(asked.column("qids").to_pylist(), asked.column("qv").to_pylist()):
                found += own.search(np.frombuffer(qids, np.int64), np.frombuffer(qv, np.float64).reshape(-1, row["dim"]), k, width)
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    found = copies.groupBy("dim", "shard", "part").cogroup(sent.groupBy("qdim", "to", "part")).applyInArrow(answers, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 nearest of every row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
