"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of about ``shard_rows`` by a hash of their id.  Each
shard's graph is built in one task from the distinct vectors of the shard (equal
vectors share a node) and stored as a row of flat arrays: per layer the node
numbers and a matrix of neighbour numbers.  Queries are read in blocks of
``query_block`` rows; a block is broadcast (its size is bounded by the parameter),
every shard answers it, and the shards' nearest are merged by query.

Largest inner product becomes nearest neighbour by one more component that
gives all vectors of a shard the same norm.  Insertion and search handle many
nodes at once: the beam of each is a row of a matrix, and each step expands the
best unexpanded entries of all rows.  Scores that are returned are inner
products of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids; an id that repeats counts once, with
its smallest vector; a query's own id is no candidate; only vectors of a
query's length are its candidates; ties go to the smaller id; fewer candidates
than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.llm.common import discard, scratch, shared_fs, stage

INDEX = ("shard int, dim int, ids binary, node_of binary, vectors binary, "
         "layers array<struct<nodes:binary,neighbours:binary>>")
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x (array<double>) of the rows that take part."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")) \
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~F.exists(
            "x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.where(F.exists("x", lambda v: v != 0)).groupBy("vec_id").agg(F.min("x").alias("x"))


# ---------------------------------------------------------------- graph

def level_of(n: int, m: int, seed: int):
    """Top layer of each node: geometric, one in ``m`` rises."""
    return np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)


def diverse(x, node_scores, candidates, keep: int):
    """Of each row's candidates (best first, -1 none): those closer to the row's node than to one already kept."""
    rows, width = candidates.shape
    vectors = x[candidates]
    alike = np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
    taken = np.zeros((rows, width), bool)
    count = np.zeros(rows, int)
    for j in range(width):
        crowded = (taken[:, :j] & (alike[:, j, :j] > node_scores[:, j, None])).any(1)
        taken[:, j] = (candidates[:, j] >= 0) & ~crowded & (count < keep)
        count += taken[:, j]
    # free places go to the best of the rest
    for j in range(width):
        more = (candidates[:, j] >= 0) & ~taken[:, j] & (count < keep)
        taken[:, j] |= more
        count += more
    order = np.argsort(~taken, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(np.where(taken, candidates, -1), order, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def beam_search(x, queries, neighbours, entry, ef: int, step: int = 4):
    """Nodes and scores of each query's ``ef`` best found, best first (-1: none); ``entry`` has starts per query."""
    rows, n = len(queries), len(x)
    seen = np.zeros((rows, n + 1), bool)
    line = np.arange(rows)[:, None]

    def scored(ids):
        return np.where(ids >= 0, np.einsum("bkd,bd->bk", x[ids], queries, optimize=True), -np.inf)

    beam = np.full((rows, ef), -1)
    beam[:, :min(ef, entry.shape[1])] = entry[:, :ef]
    seen[line, beam] = True
    seen[:, n] = True
    score = scored(beam)
    open_ = beam >= 0
    while open_.any():
        rank = np.argsort(np.where(open_, -score, np.inf), axis=1)[:, :step]
        chosen = np.take_along_axis(open_, rank, 1)
        nodes = np.where(chosen, np.take_along_axis(beam, rank, 1), -1)
        np.put_along_axis(open_, rank, False, 1)
        near = np.where(nodes[:, :, None] >= 0, neighbours[nodes], -1).reshape(rows, -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[line, near]] = -1
        seen[line, np.where(near >= 0, near, n)] = True
        ids = np.concatenate([beam, near], 1)
        scores = np.concatenate([score, scored(near)], 1)
        opens = np.concatenate([open_, near >= 0], 1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :ef]
        beam, score, open_ = (np.take_along_axis(a, best, 1) for a in (ids, scores, opens))
        open_ &= beam >= 0
    return beam, score


def descend(x, queries, above, width: int = 16):
    """Entry nodes of each query: the best found in each of the layers ``above``, from the top down."""
    entry = np.tile(above[0][0][:8], (len(queries), 1)).astype(int)
    for _, neighbours in above:
        entry = beam_search(x, queries, neighbours, entry, width)[0]
    return entry


def link_layer(x, nodes, neighbours, degree: int, ef: int, above: list, batch: int = 256):
    """Insert ``nodes`` into the layer, in growing batches; those of the layers ``above`` come first."""
    at, known = 0, len(above[-1][0]) if above else 0
    while at < len(nodes):
        new = nodes[at:at + min(batch, max(1, at))]
        old = nodes[:at]
        width = min(ef, 3 * degree)
        if at:
            if known and at >= known:  # all nodes of the layers above are in this one
                entry = descend(x, x[new], above)
            else:
                entry = np.tile(old[np.linspace(0, at - 1, min(at, 8)).astype(int)], (len(new), 1))
            found, score = beam_search(x, x[new], neighbours, entry, ef)
            found, score = found[:, :width], score[:, :width]
        else:
            found, score = np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf)
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -np.inf)
        k = min(len(new) - 1, degree)
        if k > 0:
            mates = np.argsort(-own, axis=1)[:, :k]
            found = np.concatenate([found, new[mates]], 1)
            score = np.concatenate([score, np.take_along_axis(own, mates, 1)], 1)
            order = np.argsort(-score, axis=1, kind="stable")
            found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        picked = diverse(x, score, found, degree // 2)
        neighbours[new, :picked.shape[1]] = picked
        relink(x, neighbours, np.repeat(new, picked.shape[1]), picked.ravel(), degree)
        at += len(new)


def relink(x, neighbours, sources, targets, degree: int):
    """Add the reverse links source -> target; lists that overflow are chosen anew."""
    ok = targets >= 0
    sources, targets = sources[ok], targets[ok]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    who, first, count = np.unique(targets, return_index=True, return_counts=True)
    if not len(who):
        return
    place = np.arange(len(targets)) - np.repeat(first, count)
    wide = np.full((len(who), int(count.max())), -1)
    wide[np.repeat(np.arange(len(who)), count), place] = sources
    for begin in range(0, len(who), 512):  # bounds the memory of the pairwise scores
        rows = who[begin:begin + 512]
        all_ = np.concatenate([neighbours[rows], wide[begin:begin + 512]], 1)
        all_ = np.sort(all_, axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        score = np.where(all_ >= 0, np.einsum("bkd,bd->bk", x[all_], x[rows], optimize=True), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, :2 * degree]
        all_, score = np.take_along_axis(all_, order, 1), np.take_along_axis(score, order, 1)
        full = (all_ >= 0).sum(1) > degree
        out = np.pad(all_, ((0, 0), (0, max(0, degree - all_.shape[1]))), constant_values=-1)[:, :degree]
        if full.any():
            out[full] = diverse(x, score[full], all_[full], degree)
        neighbours[rows] = out


def same_norm(x):
    """Vectors with one more component that makes all norms equal."""
    square = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def build(x, m: int, ef: int, seed: int = 1) -> list[tuple]:
    """(node numbers, neighbour numbers) of each layer, the lowest first."""
    x = same_norm(np.asarray(x, np.float64) / max(1e-300, np.abs(x).max()))
    level = level_of(len(x), m, seed)
    nodes = np.argsort(-level, kind="stable")
    above, layers = [], []
    for layer in range(level.max(), -1, -1):
        inside = nodes[:int((level >= layer).sum())]
        degree = 2 * m if layer == 0 else m
        neighbours = np.full((len(x), degree), -1, np.int32)
        link_layer(x, inside, neighbours, degree, ef, above)
        above.append((inside, neighbours))
        # upper layers are stored by their own nodes only
        layers.append((inside.astype(np.int32), neighbours if layer == 0 else neighbours[inside]))
    return layers[::-1]


def find(x, layers, queries, ef: int, block: int = 256):
    """Nodes of each query's ``ef`` best found, from the top layer down."""
    scale = max(1e-300, np.abs(x).max())
    x = same_norm(np.asarray(x, np.float64) / scale)
    above, out = [], []
    for nodes, stored in layers[:0:-1]:
        neighbours = np.full((len(x), stored.shape[1]), -1, np.int32)
        neighbours[nodes] = stored
        above.append((nodes, neighbours))
    for begin in range(0, len(queries), block):
        q = np.asarray(queries[begin:begin + block], np.float64)
        q = np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
        entry = descend(x, q, above) if above else np.tile(layers[0][0][:8], (len(q), 1)).astype(int)
        out.append(beam_search(x, q, layers[0][1], entry, ef)[0])
    return np.concatenate(out)


# ---------------------------------------------------------------- Spark

def index(rows: DataFrame, folder: str, shard_rows: int = 8192, m: int = 16, ef: int = 96) -> DataFrame:
    """Write a graph per shard (and vector length) into ``folder``, a file each; return their numbers (shard, dim).

    A file has ids, distinct vectors and the graph's layers.
    """

    def run(key, f):
        every = np.stack(f["x"].to_numpy()).astype(np.float64)
        ids = f["vec_id"].to_numpy(np.int64)
        x, node_of = np.unique(every, axis=0, return_inverse=True)
        layers = [{"nodes": a.tobytes(), "neighbours": np.ascontiguousarray(b, np.int32).tobytes()}
                  for a, b in build(x, m, ef)]
        return pd.DataFrame([(key[0], key[1], ids.tobytes(), node_of.ravel().astype(np.int32).tobytes(), x.tobytes(),
                              layers)], columns=["shard", "dim", "ids", "node_of", "vectors", "layers"])

    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
                        F.size("x").alias("dim"), "vec_id", "x")
    dealt.groupBy("shard", "dim").applyInPandas(run, INDEX).write.partitionBy("shard", "dim").parquet(folder)
    return rows.sparkSession.read.schema(INDEX).parquet(folder).select("shard", "dim").distinct()


def _table(folder: str):
    """The rows of a folder of Parquet files on shared storage, read in a task."""
    import pyarrow.parquet as pq

    fs, path = shared_fs(folder)
    return pq.ParquetDataset(path, filesystem=fs, partitioning=None).read()


def _read_shard(folder: str, shard: int, dim: int, m: int):
    (row,) = _table(f"{folder}/shard={shard}/dim={dim}").to_pylist()
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["node_of"], np.int32),
            np.frombuffer(row["vectors"], np.float64).reshape(-1, dim),
            [(np.frombuffer(a["nodes"], np.int32), np.frombuffer(a["neighbours"], np.int32).reshape(
                -1, m if n else 2 * m)) for n, a in enumerate(row["layers"])])


def _read_block(folder: str, block: int, dim: int):
    found = _table(f"{folder}/block={block}/dim={dim}")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return found.column("vec_id").to_numpy(), x


def _answer(graphs: str, asked: str, k: int, ef: int, m: int):
    """The shards' nearest for rows (shard, dim, block), which come shard by shard."""

    def run(frames):
        at = None
        for f in frames:
            for work in f.itertuples(index=False):
                if at != (work.shard, work.dim):
                    at = (work.shard, work.dim)
                    ids, node_of, x, layers = _read_shard(graphs, work.shard, work.dim, m)
                    # members of a node, smallest id first; only the k+1 smallest can be among a query's k nearest
                    order = np.lexsort((ids, node_of))
                    first = np.searchsorted(node_of[order], np.arange(len(x) + 1))
                query_ids, queries = _read_block(asked, work.block, work.dim)
                out = []
                for q, near in enumerate(find(x, layers, queries, ef)):
                    near = near[near >= 0]
                    score = x[near] @ queries[q]
                    got = [(-s, i) for n, s in zip(near, score, strict=True)
                           for i in ids[order[first[n]:min(first[n + 1], first[n] + k + 1)]]
                           if i != query_ids[q]]
                    out += [(query_ids[q], i, -s) for s, i in sorted(got)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           shard_rows: int = 8192, m: int = 16, ef_build: int = 96, ef: int = 128,
           query_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of every query."""
    spark = rows.sparkSession
    held, held_path = stage(usable(rows, vec_id, vector), "hnsw-rows")
    graphs, asked = scratch(spark, "hnsw-graphs"), scratch(spark, "hnsw-queries")
    shards = index(held, graphs, shard_rows, m, ef_build)
    discard(spark, held_path)
    chosen, chosen_path = stage(usable(queries, vec_id, vector), "hnsw-asked")
    blocks = max(1, -(-chosen.count() // query_block))
    chosen.select("vec_id", "x", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"),
                  F.size("x").alias("dim")).repartition("block", "dim").write.partitionBy("block", "dim").parquet(asked)
    discard(spark, chosen_path)
    kinds = spark.read.schema("vec_id long, block int, dim int").parquet(asked).select("block", "dim").distinct()
    work = shards.join(kinds, "dim")  # numbers only
    some = max(1, work.count())
    # few shards: a task for each item of work; many: the blocks of a shard in one task
    tasks = some if some < 4 * spark.sparkContext.defaultParallelism else max(1, shards.count())
    work = work.repartitionByRange(tasks, "shard", "dim", "block").sortWithinPartitions("shard", "dim", "block")
    found, _ = stage(work.select("shard", "dim", "block").mapInPandas(_answer(graphs, asked, k, ef, m), FOUND), "hnsw-found")
    discard(spark, graphs, asked)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
