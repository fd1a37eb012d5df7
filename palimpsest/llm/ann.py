"""Nearest neighbours by inner product: a robust-pruned directed graph in every shard, searched by beam.

Equal vectors are one point of the graph, with the smallest of their ids (no search can return more than its k). Points
get a coordinate that makes all norms of a shard equal, so that distance orders them as the inner product does; zero in
queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise

#: Points of a shard, edges of a point, beam, relaxation of the pruning; queries of a block and blocks of a search task.
SHARD, DEGREE, BEAM, RELAX = 8192, 32, 64, 1.2
QUERIES, BLOCKS = 256, 64
#: Beam entries that are opened together.
WIDE = 4


def beam_search(points: np.ndarray, squares: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances less the query's own square) of the ``beam`` nearest found for each query; -1 where there are none."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(points) + 1), bool)
    seen[:, [start, -1]] = True
    ids, opened = np.full((n, beam), -1), np.ones((n, beam), bool)
    far = np.full((n, beam), np.inf, np.float32)
    ids[:, 0], opened[:, 0] = start, False
    far[:, 0] = squares[start] - 2 * (queries @ points[start])
    while not opened.all():
        key = np.where(opened, np.inf, far)
        best = np.argpartition(key, min(WIDE, beam - 1), axis=1)[:, :WIDE]
        usable = ~opened[rows, best]
        opened[rows, best] = True
        near = np.where(usable[:, :, None], graph[ids[rows, best]], -1).reshape(n, -1)
        near = np.where(seen[rows, near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows, near] = True
        some = np.flatnonzero((near >= 0).any(axis=1))
        if not len(some):
            continue
        own = near[some]
        distance = (squares[own] - 2 * np.einsum("qkd,qd->qk", points[own], queries[some])).astype(np.float32)
        distance[own < 0] = np.inf
        all_ids, all_far = np.concatenate([ids[some], own], axis=1), np.concatenate([far[some], distance], axis=1)
        all_opened = np.concatenate([opened[some], own < 0], axis=1)
        order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        r = np.arange(len(some))[:, None]
        ids[some], far[some], opened[some] = all_ids[r, order], all_far[r, order], all_opened[r, order]
    return ids, far


def prune(points: np.ndarray, squares: np.ndarray, point: int, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours: the nearest one stays and removes what lies nearer to it, relaxed, than to the point."""
    own = points[candidates]
    to_point = np.maximum(squares[candidates] + squares[point] - 2 * own @ points[point], 0)
    order = np.argsort(to_point, kind="stable")
    candidates, own, to_point = candidates[order], own[order], to_point[order]
    square = squares[candidates]
    between = relax**2 * (square[:, None] + square[None, :] - 2 * own @ own.T)
    alive, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= between[i] > to_point
    return candidates[kept]


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """The graph, as rows of neighbours filled up with -1, and the point where searches start."""
    n = len(points)
    squares = (points**2).sum(axis=1)
    rng = np.random.default_rng(5)
    graph = np.full((n + 1, degree + degree // 2), -1)  # the last row stands for no point
    if n > 1:
        graph[:n, : degree // 2] = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree // 2))) % n
    start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    order = rng.permutation(n)
    for k in range(0, n, QUERIES):
        batch = order[k : k + QUERIES]
        found, _ = beam_search(points, squares, graph, start, points[batch], beam)
        backward: dict[int, list[int]] = {}
        for p, ids in zip(batch.tolist(), found):
            near = np.unique(np.concatenate([ids, graph[p]]))
            near = prune(points, squares, p, near[(near >= 0) & (near != p)], degree, relax)
            graph[p] = -1
            graph[p, : len(near)] = near
            for x in near.tolist():
                backward.setdefault(x, []).append(p)
        for x, added in backward.items():
            near = np.unique(np.concatenate([graph[x], added]))
            near = near[near >= 0]
            if len(near) > graph.shape[1]:
                near = prune(points, squares, x, near, degree, relax)
            graph[x] = -1
            graph[x, : len(near)] = near
    return graph, start


def _smallest(k: int):
    """Each partition's distinct vectors with their k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(vector, [])
                if -i not in own:
                    heapq.heappush(own, -i)
                    if len(own) > k:
                        heapq.heappop(own)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array([sorted(-x for x in own) for own in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    return run


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by the largest of their components, and the squares of their norms: neither overflows."""
    inner = x.astype(np.float64)
    inner /= np.abs(inner).max()
    return inner, (inner**2).sum(axis=1)


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["vec_id", "vector"])

    return run


def nearest(vectors: DataFrame, query: str, k: int = 20, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (vec_id, embedding) where the SQL condition ``query`` holds, the k
    other rows of the largest inner products found, ties to the smaller vec_id.

    Rows without id take no part, nor do vectors that are null, empty, zero or hold null or non-finite components. Vectors of
    different lengths have no inner product: each finds those of its own length. Rows of one id and one vector are one row;
    an id with several vectors has a row, and as a query a list, for each, and only its own row is not among its candidates.
    Components are kept as they are (double, or float for a column of floats), scores are computed from them in double; only
    the graph of a shard works on floats, of vectors scaled to its largest component and of queries of one length.
    """
    kind = "double" if dict(vectors.dtypes)["embedding"] != "array<float>" else "float"
    real = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(real)
    usable = usable.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)))  # no negative zeros
    number = np.float64 if kind == "double" else np.float32
    rows = usable.mapInArrow(_packed(kind if kind == "double" else "float32"), "vec_id long, vector binary")
    classes = rows.mapInArrow(_smallest(k + 1), "vector binary, ids array<long>").groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    classes = materialise(classes.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids")).withColumns({"rep": F.col("ids")[0], "own": F.monotonically_increasing_id()}))
    asked = materialise(rows.where(query).distinct())
    # Shards of each length in proportion to its vectors.
    n = classes.groupBy(F.length("vector").alias("size")).agg(F.count("*").alias("n"))
    shards = n.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / shard) - 1)).alias("shard"), F.ceil(F.col("n") / shard).alias("of"))
    shards = materialise(shards)
    sizes = shards.select("size", "of").distinct()

    def index(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("vector", "ascending")])
        own = table.column("vector").to_pylist()
        x = np.frombuffer(b"".join(own), number).reshape(len(own), -1)
        inner, squares = _scaled(x)
        rest = np.sqrt(np.maximum(squares.max() - squares, 0)).astype(np.float32)
        graph, start = build(np.ascontiguousarray(np.concatenate([inner.astype(np.float32), rest[:, None]], axis=1)))
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "shard": [key[1].as_py()], "start": [start], "reps": pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())), "owns": pa.array([table.column("own").to_pylist()], pa.list_(pa.int64())), "points": pa.array([x.tobytes()], pa.binary()), "rest": pa.array([rest.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary())})

    schema = "size int, shard long, start long, reps array<long>, owns array<long>, points binary, rest binary, graph binary"
    dealt = classes.withColumn("size", F.length("vector")).join(sizes, "size").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("of")))
    graphs = materialise(dealt.select("size", "shard", "rep", "own", "vector").groupBy("size", "shard").applyInArrow(index, schema))
    points = materialise(asked.select("vector").distinct())
    groups = max(-(-points.count() // (QUERIES * BLOCKS)), 1)
    left = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = points.withColumn("group", F.pmod(F.xxhash64("vector", F.lit("group")), F.lit(groups)).cast("int")).withColumn("size", F.length("vector"))
    right = right.join(sizes, "size").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).select("size", "shard", "group", "vector")

    def search(key: tuple, one: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "own": [], "score": []}
        if one.num_rows and queries.num_rows:
            asked_for = queries.column("vector").to_pylist()
            reps, owns = (np.array(one.column(c)[0].as_py()) for c in ("reps", "owns"))
            x = np.frombuffer(one.column("points")[0].as_py(), number).reshape(len(reps), -1)
            inner, norms = _scaled(x)
            augmented = np.concatenate([inner.astype(np.float32), np.frombuffer(one.column("rest")[0].as_py(), np.float32)[:, None]], axis=1)
            graph = np.frombuffer(one.column("graph")[0].as_py(), np.int32).reshape(len(reps) + 1, -1)
            squares = (augmented**2).sum(axis=1)
            for at in range(0, len(asked_for), QUERIES):
                own = asked_for[at : at + QUERIES]
                q = np.frombuffer(b"".join(own), number).reshape(len(own), -1).astype(np.float64)
                unit = q / np.abs(q).max(axis=1, keepdims=True)
                unit *= np.sqrt(norms.max() / (unit**2).sum(axis=1, keepdims=True))  # the order is the same, whatever its length
                low = np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32)
                found, _ = beam_search(augmented, squares, graph, one.column("start")[0].as_py(), low, beam)
                for vector, ids, row in zip(own, found, q):
                    ids = ids[ids >= 0]
                    score = x[ids].astype(np.float64) @ row
                    best = np.lexsort((reps[ids], -score))[: k + 1]
                    out["query"] += [vector] * len(best)
                    out["rep"] += reps[ids[best]].tolist()
                    out["own"] += owns[ids[best]].tolist()
                    out["score"] += score[best].tolist()
        return pa.table([pa.array(out["query"], pa.binary()), pa.array(out["rep"], pa.int64()), pa.array(out["own"], pa.int64()), pa.array(out["score"], pa.float64())], ["query", "rep", "own", "score"])

    found = left.groupBy("size", "shard", "group").cogroup(right.groupBy("size", "shard", "group")).applyInArrow(search, "query binary, rep long, own long, score double")
    first = lambda *c: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), *c))), 1, k + 1)
    best = found.groupBy("query").agg(first("rep", "own").alias("top")).select("query", F.explode("top").alias("x")).select("query", F.col("x.own").alias("own"), (-F.col("x.down")).alias("score"))
    same = (F.xxhash64("query") == F.col("mark")).alias("same")  # the class of the query's own vector
    members = best.join(classes.select("own", "ids", F.xxhash64("vector").alias("mark")), "own").select("query", "score", same, F.explode("ids").alias("vec_id"))
    lists = members.groupBy("query").agg(first("vec_id", "same").alias("top"))
    out = asked.withColumnsRenamed({"vec_id": "query_id", "vector": "query"}).join(lists, "query")
    others = F.filter("top", lambda x: ~(x["same"] & (x["vec_id"] == F.col("query_id"))))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score"))
