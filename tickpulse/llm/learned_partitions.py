"""Nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph.  The graph is cut into
partitions of equal size with few edges across, and a small classifier learns
from a vector in which partitions its neighbours lie.  Every vector is then stored in
its most probable partition; a query goes to as many of its most probable
partitions as the sample needs for the asked recall, and the vectors met there are
ranked by their exact distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm.scratch import written


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Row numbers of the ``k`` nearest other rows of each row."""
    sq = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), block):
        d = sq[s : s + block, None] + sq - 2 * (x[s : s + block] @ x.T)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[s : s + block] = near
    return out


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 25, slack: float = 0.05, seed: int = 3) -> np.ndarray:
    """Partition of each row of a neighbour graph: at most ``(1 + slack) * rows / parts`` in one, few edges between two.

    Starts from balanced clusters of the vectors and moves rows to the partition of most of their neighbours while there is room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(n / parts * (1 + slack)))
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(10):
        d = (centre * centre).sum(axis=1) - 2 * (x @ centre.T)
        part = _fill(-d, room)
        for p in range(parts):
            if (part == p).any():
                centre[p] = x[part == p].mean(axis=0)
    ends = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    others = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(ends * parts + part[others], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        size = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < room and rng.random() < 0.7:  # not all at once: neighbours would swap for ever
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def _fill(preference: np.ndarray, room: int) -> np.ndarray:
    """Each row to the partition it prefers, best margins first, never more than ``room`` in one."""
    n, parts = preference.shape
    order = np.argsort(-preference, axis=1)
    margin = preference[np.arange(n), order[:, 0]] - preference[np.arange(n), order[:, min(1, parts - 1)]]
    size, out = np.zeros(parts, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-margin, kind="stable").tolist():
        for p in order[i].tolist():
            if size[p] < room:
                size[p] += 1
                out[i] = p
                break
    return out


@dataclass
class Router:
    """One hidden layer; the scores order the partitions by the chance that a vector's neighbours lie there."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, : self.probes]


def learn_router(x: np.ndarray, parts: int = 32, graph_k: int = 20, k: int = 10, recall: float = 0.95, hidden: int = 128, epochs: int = 25, seed: int = 5) -> Router:
    """Graph, partitions and classifier of a sample; ``probes`` is the smallest number of partitions that holds ``recall`` of
    the ``k`` nearest sample rows of rows that the classifier did not learn from."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    parts = int(max(1, min(parts, n // 64)))
    mean = x.mean(axis=0) if n else np.zeros(d)
    if parts == 1:
        return Router(mean, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbour_graph(x, min(graph_k, n - 1))
    part = balanced_partition(x, near, parts)
    goal = np.bincount(np.repeat(np.arange(n), near.shape[1]) * parts + part[near].ravel(), minlength=n * parts).reshape(n, parts).astype(float)
    goal[np.arange(n), part] += near.shape[1]
    goal /= goal.sum(axis=1, keepdims=True)
    test = rng.random(n) < 0.2
    learn = np.flatnonzero(~test)
    scale = max(1e-9, float((x - mean).std()))
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) / scale, np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for s in range(0, len(order), 256):
            i = order[s : s + 256]
            xi = x[i] - mean
            h = np.maximum(xi @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - goal[i]) / len(i)
            gh = (g @ p[2].T) * (h > 0)
            grads = [xi.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            t += 1
            for a, ga, ma, va in zip(p, grads, m, v):
                ma += 0.1 * (ga - ma)
                va += 0.001 * (ga * ga - va)
                a -= 0.003 * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)
    router = Router(mean, *p, parts)
    home = router.home(x)
    asked = np.flatnonzero(test)
    rank = np.empty((len(asked), parts), np.int64)
    np.put_along_axis(rank, router.routes(x[asked]), np.broadcast_to(np.arange(parts), rank.shape), axis=1)
    close = near[asked]
    dist = ((x[asked][:, None, :] - x[close]) ** 2).sum(axis=2)
    close = np.take_along_axis(close, np.argsort(dist, axis=1)[:, :k], axis=1)
    at = np.sort(np.take_along_axis(rank, home[close], axis=1).ravel())
    router.probes = int(at[max(0, int(np.ceil(len(at) * recall)) - 1)]) + 1 if len(at) else parts
    return router


def clean_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) without vectors that are null, empty, zero or hold a null or a non-finite number."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = F.col("v")
    bad = F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == F.lit(float("inf"))))
    return base.where("vec_id is not null and v is not null").where(~bad).where(F.exists(v, lambda a: a != 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` nearest other rows of each query among ``ids``: query id, row id, exact distance.

    Equal vectors are compared once; distances come from a matrix product first and are recomputed from the differences for all
    rows that can be among the nearest.
    """
    distinct, code = np.unique(x, axis=0, return_inverse=True)
    code = code.ravel()
    order = np.lexsort((ids, code))
    first = np.searchsorted(code[order], np.arange(len(distinct) + 1))
    members = ids[order]
    sq = (distinct * distinct).sum(axis=1)
    out_q, out_v, out_d = [], [], []
    for s in range(0, len(q), 256):
        block = q[s : s + 256]
        rough = np.maximum((block * block).sum(axis=1)[:, None] + sq - 2 * (block @ distinct.T), 0)
        take = min(k + 1, len(distinct))
        bound = np.partition(rough, take - 1, axis=1)[:, take - 1]
        bound += 1e-9 * (1 + (block * block).sum(axis=1) + sq.max())
        for i, b in enumerate(block):
            close = np.flatnonzero(rough[i] <= bound[i])
            d = np.sqrt(((distinct[close] - b) ** 2).sum(axis=1))
            me = q_ids[s + i]
            # at most k + 1 members of one vector can matter (the query itself may be one)
            v = [members[first[c] : min(first[c + 1], first[c] + k + 1)] for c in close]
            n = [len(m) for m in v]
            v, d = np.concatenate(v), np.repeat(d, n)
            keep = v != me
            v, d = v[keep], d[keep]
            best = np.lexsort((v, d))[:k]
            out_q.append(np.full(len(best), me))
            out_v.append(v[best])
            out_d.append(d[best])
    cat = lambda a, t: np.concatenate([*a, np.empty(0, t)]).astype(t)
    return cat(out_q, np.int64), cat(out_v, np.int64), cat(out_d, float)


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample: int = 6144,
    parts: int = 32,
    recall: float = 0.95,
    block_rows: int = 20_000,
) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; a query
    is never its own neighbour.  ``sample`` bounds the rows that the partitions and the classifier are learned from (chosen by a hash
    of the id); every row is indexed.  ``recall`` is the share of the sample's own neighbours that the probed partitions must
    hold.  Fewer candidates than ``k`` give fewer rows; where the probed partitions hold too few, all partitions are searched.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do those of another
    length than most of the sample.  Null ids take no part.  Of rows that repeat an id each distinct vector is a candidate,
    and an id is returned once, at its nearest.
    """
    clean = clean_vectors(vectors, id_col, vec_col)
    taken = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()  # at most ``sample`` rows
    lengths = taken.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if taken.num_rows else np.empty(0, np.int64)
    kinds = "query_id long, rank int, vec_id long, score double"
    if not len(lengths):
        return vectors.sparkSession.createDataFrame([], kinds)
    dim = int(np.bincount(lengths).argmax())
    x = _matrix(taken.column("v").filter(pa.array(lengths == dim)))
    router = learn_router(np.unique(x, axis=0), parts, recall=recall, k=k)
    n_parts = router.w2.shape[1]

    def place(batches):
        for b in batches:
            m = _matrix(b.column("v"))
            home = router.home(m) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(home)], names=["vec_id", "v", "part"])

    def route(batches):
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                to = router.routes(m)
                pick = pa.array(np.repeat(np.arange(len(m)), to.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pick), b.column("v").take(pick), pa.array(to.ravel())], names=["vec_id", "v", "part"])

    same = clean.where(F.size("v") == dim)
    index = written(same.mapInArrow(place, "vec_id long, v array<double>, part long"), "index")
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # at most ``parts`` rows
    blocks = [max(1, -(-sizes.get(p, 0) // block_rows)) for p in range(n_parts)]
    count = F.element_at(F.array(*[F.lit(b) for b in blocks]), (F.col("part") + 1).cast("int"))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), count)).select("part", "block", "vec_id", "v")
    asked = same.where(F.col("vec_id") % every == 0)

    def rank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """Nearest per block, then over all blocks; a large partition is as many groups as it has blocks."""

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            q, v, d = _nearest(left.column("vec_id").to_numpy(), _matrix(left.column("v")), right.column("vec_id").to_numpy(), _matrix(right.column("v")), k)
            return pa.table({"query_id": q, "vec_id": v, "score": d})

        spread = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
        found = candidates.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInArrow(best, "query_id long, vec_id long, score double")
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        near = one.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k rows per block probed
        return near.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "hit")).select(
            "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
        )

    first = written(rank(dealt, asked.mapInArrow(route, "vec_id long, v array<double>, part long")), "near")
    short = first.groupBy("query_id").agg(F.count("*").alias("n"))
    missing = written(asked.join(short, asked["vec_id"] == short["query_id"], "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v"), "short-queries")
    if router.probes >= n_parts or missing.isEmpty():
        return first
    everywhere = missing.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    rest = rank(dealt, everywhere)
    return first.join(missing.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
