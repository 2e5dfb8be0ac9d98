"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are lifted to points whose Euclidean distances order inner products: x gets the further coordinate
sqrt(M^2 - |x|^2) with M the largest norm, a query gets 0, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Pivots are a bounded
sample of the points. A first pass assigns each point to its nearest pivot and summarises the groups: count, least and
largest distance to the pivot, and the k + 1 least ones of different ids. From the summaries follows an upper bound of each query's k-th
distance (pivot distance plus the k + 1 least distances of each group), and by the triangle inequality the groups that can
hold an answer. Groups are cut into blocks by hash, so that thousands of equal vectors don't meet in one task. Every point moves
once, to its block; only queries, the small side, are replicated, to the blocks of the groups that their bound can't rule out.
A task holds one block of points at a time and streams the queries that were sent there past it, whatever their number; the best
k of each query and block are merged.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; a component of 2^31 or more after scaling, or a score beyond a long, raises; rows that share a vec_id
are candidates of their own but never of a query with that id; equal scores rank by vec_id; query rows that
share an id rank as one query with each neighbour once a row, as in the SQL; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm._shared import table

K, SCALE, EVERY = 10, 1024, 100
#: Bounds of what the driver plans with (pivots; their number grows with the data) and of the rows of a block.
MAX_PIVOTS, MIN_BLOCK, MAX_BLOCK = 2_048, 512, 16_384
#: Bytes of replicated queries that a function gives out at once, and queries that are scored at once.
SENT_BYTES, SCORED = 8 << 20, 256
#: Bytes of the distances from which the bounds of some queries follow.
REACH_BYTES = 32 << 20
LARGEST = 1 << 31
SLACK = 1e-6


def scaled(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): finite vectors as arrays of floor(scale * x); a component whose products may not fit a long raises."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def fitting(x: Column) -> Column:
        return F.when(F.abs(x) < float(LARGEST), F.floor(x)).otherwise(F.raise_error(F.concat(F.lit("a vector's component is too large: "), x)).cast("long"))

    v = F.transform(vector, lambda x: fitting(F.lit(float(scale)) * x.cast("double")))
    return df.where(F.col(vector).isNotNull() & whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


@dataclass
class Space:
    dims: int
    norm2: float
    pivots: np.ndarray  # lifted

    def stack(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), self.dims))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def to_pivots(self, x: np.ndarray, data: bool) -> np.ndarray:
        """Distances of points (data) or queries to all pivots."""
        n2 = (x**2).sum(axis=1)
        last = np.sqrt(np.maximum(0, self.norm2 - n2)) if data else np.zeros(len(x))
        cross = x @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        d2 = (n2 + last**2)[:, None] + (self.pivots**2).sum(axis=1) - 2 * cross
        return np.sqrt(np.maximum(0, d2))


def space_of(vectors: DataFrame, n: int) -> Space:
    """Pivots by least hash of the vector, equal ones once; norms and dimensions of all vectors."""
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims, norm2 = vectors.agg(F.max(F.size("v")), F.max(size)).first()
    want = int(min(MAX_PIVOTS, max(1, math.isqrt(n) // 4)))
    hashed = vectors.select("v", F.xxhash64("v").alias("h"))
    likely = min(1.0, 16 * want / max(1, n))  # the least hashes are below this part of all, unless most vectors are copies

    def least(some: DataFrame) -> list:
        return some.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(want).collect()

    rows = least(hashed.where(F.col("h") < int(-(2**63) + likely * (2**64 - 1)))) if likely < 1 else []
    rows = rows if len(rows) == want else least(hashed)
    space = Space(int(dims), float(norm2), np.zeros((0, int(dims) + 1)))
    x = space.stack(pd.Series([r.v for r in rows]))
    space.pivots = np.hstack([x, np.sqrt(np.maximum(0, space.norm2 - (x**2).sum(axis=1)))[:, None]])
    return space


def mixed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


@dataclass
class Plan:
    """What the driver knows of the groups, a few arrays by pivot: into how many blocks each is cut, its least and largest distance to the
    pivot, and the least distances (near_d) of some of its points (near_of: the group's place)."""

    space: Space
    k: int
    ids: np.ndarray
    blocks: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    near_d: np.ndarray
    near_of: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.cumsum(np.r_[0, self.blocks])
        self.index = {c: i for i, c in enumerate(self.ids.tolist())}

    def bounds(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distances to all pivots: the bound of the k-th distance, and the groups that may hold an answer."""
        own = d[:, self.ids]
        reach = own[:, self.near_of] + self.near_d
        theta = np.partition(reach, self.k, axis=1)[:, self.k] if reach.shape[1] > self.k else np.full(len(d), np.inf)
        theta = theta * (1 + SLACK) + SLACK
        return theta, (own - self.hi <= theta[:, None]) & (self.lo - own <= theta[:, None])

    def sends(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which query, block, bound) of queries for the blocks that may hold an answer, a bounded number of them at once: queries are taken
        by slices whose bounds take REACH_BYTES, and a slice's pairs by what goes out at once; one query's pairs are as many as there are blocks."""
        rows = max(1, REACH_BYTES // (8 * max(1, len(self.near_d) + len(self.space.pivots))))
        step = max(1, SENT_BYTES // (8 * self.space.dims + 40))
        for first in range(0, len(x), rows):
            theta, need = self.bounds(self.space.to_pivots(x[first : first + rows], False))
            upto = np.cumsum(need @ self.blocks)
            i = 0
            while i < len(theta):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + step, side="right")))
                who, group = np.nonzero(need[i:j])
                n = self.blocks[group]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[group], n)
                who = np.repeat(who, n) + i
                for s in range(0, len(who), step):
                    w = who[s : s + step]
                    yield first + w, at[s : s + step], theta[w]
                i = j


def top_k(data: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """data, queries: (id, v) of integer vectors. (query_id, rank, vec_id, score) of each query's k largest products."""
    spark = data.sparkSession
    n, n_queries = data.count(), queries.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = space_of(data, n)
    block = min(MAX_BLOCK, max(MIN_BLOCK, n // 128))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, REACH_BYTES // (8 * len(space.pivots)))
        for b in (b.iloc[s : s + rows] for b in batches for s in range(0, max(1, len(b)), rows)):
            d = space.to_pivots(space.stack(b["v"]), True)
            near = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield b.assign(cell=near.astype(np.int32), d=d[np.arange(len(d)), near])

    placed = data.mapInPandas(lambda b: assign(b), "id long, v array<long>, cell int, d double")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    rank = F.row_number().over(W.partitionBy("cell").orderBy("d"))
    # of rows that share an id only the least, so that a query's own id is at most one of those its bound counts
    once = placed.groupBy("id").agg(F.min(F.struct("d", "cell")).alias("m")).select("m.cell", "m.d")
    least = once.withColumn("r", rank).where(F.col("r") <= k + 1).select("cell", "d").collect()  # k + 1 rows a pivot at most
    cells = {r.cell: r for r in summary.collect()}  # one row a pivot
    ids = np.array(sorted(cells))
    count, lo, hi = (np.array([cells[c][f] for c in ids]) for f in ("n", "lo", "hi"))
    blocks = np.maximum(1, -(-count // block))
    near_d, near_of = np.array([r.d for r in least]), np.searchsorted(ids, [r.cell for r in least])

    plan = Plan(space, k, ids, blocks, lo, hi, near_d, near_of)

    row = "block long, query boolean, id long, v array<long>, bound double"

    def send_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids_, vectors = b["id"].to_numpy(), b["v"].to_numpy()
            for who, at, bound in plan.sends(space.stack(b["v"])):
                yield pd.DataFrame({"block": at, "query": True, "id": ids_[who], "v": vectors[who], "bound": bound})

    def send_data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in assign(batches):
            g = np.array([plan.index[c] for c in b["cell"]], np.int64)
            at = plan.starts[g] + mixed(b["id"].to_numpy()) % plan.blocks[g] if len(g) else g
            yield pd.DataFrame({"block": at, "query": False, "id": b["id"], "v": b["v"], "bound": 0.0})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by block, a block's points before its queries."""
        held, points, x, own = None, [], None, None
        for batch in batches:
            for block, part in batch.groupby("block", sort=False):
                if block != held:
                    held, points, x = block, [], None
                if len(data := part[~part["query"]]):
                    points.append(data[["id", "v"]])
                if len(q := part[part["query"]]) and points:
                    if x is None:
                        every = pd.concat(points).sort_values("id", kind="stable")
                        x, own = space.stack(every["v"]), every["id"].to_numpy()
                    yield from scored(q, x, own)

    def scored(q: pd.DataFrame, x: np.ndarray, own: np.ndarray) -> Iterator[pd.DataFrame]:
        a, who, bound, out = space.stack(q["v"]), q["id"].to_numpy(), q["bound"].to_numpy(), []
        exact = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * space.dims < 2**53
        least = ((a**2).sum(axis=1) + space.norm2 - bound**2) / 2
        for s in range(0, len(a), SCORED):
            c = a[s : s + SCORED]
            score = c @ x.T
            if not exact:
                if np.abs(score).max(initial=0) >= 2**63 * (1 - 1e-9):
                    raise OverflowError("an inner product doesn't fit a long")
                score = c.astype(np.int64) @ x.astype(np.int64).T  # a sum that fits is right although parts of it wrap
            for i, r in enumerate(score, s):
                may = np.flatnonzero((own != who[i]) & (r >= least[i] - 1 - SLACK * abs(least[i])))
                if len(may) > k:
                    cut = np.partition(r[may], -k)[-k]
                    may = may[r[may] >= cut]
                    may = may[np.argsort(-r[may], kind="stable")[:k]]  # ids ascend, so ties keep the smaller ids
                out.append((np.full(len(may), who[i]), own[may], r[may].astype(np.int64)))
        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    sent = data.mapInPandas(send_data, row).unionByName(queries.mapInPandas(send_queries, row))
    found = sent.repartition("block").sortWithinPartitions("block", "query").mapInPandas(solve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
