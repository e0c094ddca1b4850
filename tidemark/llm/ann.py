"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 3).

The tree is fitted on a bounded sample (`SAMPLE` vectors, the smallest digests of their ids): `LEVELS` levels of `BRANCH` clusters.
Every vector of the table is then assigned to a leaf. A query walks the tree through a priority queue: the nearest open node is taken
first, an inner node opens its children, a leaf is visited. How many leaves are visited is calibrated: for `CALIBRATION` queries the
true neighbours among all rows are found in blocks, and the visits are widened until `TARGET` of them lie in leaves visited. A query
goes on until it has met enough candidates, so small tables are searched whole.

Leaves and queries meet in groups of (leaf, part of the leaf, part of the queries) that hold `BLOCK` rows of either side at most, so a
vector that a third of all rows share is many groups. Each group returns its nearest rows per query, the rest is a ranking.

Rows: vectors that are null, empty, all zero, hold null or non-finite components, or differ in length from most take no part; a query
that takes no part has no result. Repeated vectors are all candidates, ties go to the smaller vec_id. Every row with the query's own
vec_id is left out, and repeated rows of a query count as one query. Null ids take no part. An empty table gives no rows. Extra
columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

BRANCH, LEVELS, ROUNDS, SAMPLE = 12, 2, 12, 20_000
CALIBRATION, TARGET, BLOCK = 200, 0.95, 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and `v` (array of double) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


class Tree:
    """Node 0 is the root. `children[i]`: nodes below it, empty for a leaf; `centres[i]`: its centre."""

    def __init__(self, sample: np.ndarray, branch: int, levels: int, seed: int = 7):
        self.centres, self.children = [sample.mean(0)], [[]]
        rng = np.random.default_rng(seed)
        level = [(0, sample)]
        for _ in range(levels):
            below = []
            for node, rows in level:
                for centre, part in self._clusters(rows, branch, rng):
                    self.children[node].append(len(self.centres))
                    below.append((len(self.centres), part))
                    self.centres.append(centre)
                    self.children.append([])
            level = below

    @staticmethod
    def _clusters(rows: np.ndarray, branch: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(rows, axis=0)
        if len(distinct) <= 1:
            return []
        centres = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
        for _ in range(ROUNDS):
            near = _squares(rows, centres).argmin(1)
            centres = np.array([rows[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
        near = _squares(rows, centres).argmin(1)
        return [(c, rows[near == i]) for i, c in enumerate(centres) if (near == i).any()]

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        open_ = {0}
        while open_ := {n for n in open_ if self.children[n]}:
            below = set()
            for node in open_:
                mine = np.flatnonzero(at == node)
                kids = np.array(self.children[node])
                if len(mine):
                    at[mine] = kids[_squares(rows[mine], np.array([self.centres[k] for k in kids])).argmin(1)]
                below.update(kids.tolist())
            open_ = below
        return at

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, the most promising first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield node
            for k in kids:
                dev = query - self.centres[k]
                heapq.heappush(heap, (float(dev @ dev), k))


def nearest(ids: np.ndarray, rows: np.ndarray, qid: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest rows by (distance, id), without the query's own id."""
    dev = rows - query
    d = np.sqrt((dev * dev).sum(1))
    d[ids == qid] = np.inf
    if len(d) > k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        some = np.arange(len(d))
    order = some[np.lexsort((ids[some], d[some]))][:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def brute(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a few queries among all rows: every batch returns its k nearest, the rest is a ranking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = b.column("id").to_numpy(), _matrix(b.column("v"))
            found = [(q, i, d, m[int(np.flatnonzero(ids == i)[0])]) for q, v in queries for i, d in (nearest(ids, m, q, np.array(v), k) if len(ids) else [])]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64()), "v": pa.array([x[3].tolist() for x in found], pa.list_(pa.float64()))})

    return ranked(rows.mapInArrow(run, "query_id long, vec_id long, score double, v array<double>"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query. `queries`: rows of the same form as `vectors`."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = usable(queries, key, vector).dropDuplicates(["id"])
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    some = asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).collect()
    if not sample or not some or len(sample[0]["v"]) != len(some[0]["v"]):
        return empty
    tree = Tree(np.array([r["v"] for r in sample]), BRANCH, LEVELS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf_of(_matrix(b.column("v"))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), b.column("id"), b.column("v")], ["leaf", "id", "v"])

    placed = written(rows.mapInArrow(assign, "leaf int, id long, v array<double>"), "ann-leaves")
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # BRANCH ** LEVELS rows at most

    truth: dict[int, list[int]] = {}
    for r in brute(rows, [(r["id"], r["v"]) for r in some], k).collect():  # CALIBRATION * k rows at most
        truth.setdefault(r["query_id"], []).append(int(tree.leaf_of(np.array([r["v"]]))[0]))
    places = []
    for r in some:
        at = {leaf: i for i, leaf in enumerate(tree.best_bins(np.array(r["v"])))}
        places += [at[leaf] for leaf in truth.get(r["id"], [])]
    visits = 1
    while places and np.mean(np.array(places) < visits) < target:
        visits += max(1, visits // 8)

    n_asked = asked.count()
    query_parts = max(1, -(-n_asked // BLOCK))
    parts = {leaf: max(1, -(-n // BLOCK)) for leaf, n in sizes.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, m = [], _matrix(b.column("v"))
            for i, q in enumerate(b.column("id").to_pylist()):
                met = seen = 0
                for leaf in tree.best_bins(m[i]):
                    if seen >= visits and met > k:
                        break
                    seen += 1
                    met += sizes.get(leaf, 0)
                    out += [(leaf, part, i) for part in range(parts.get(leaf, 0))]
            take = pa.array([x[2] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), b.column("id").take(take), b.column("v").take(take)], ["leaf", "part", "id", "v"])

    visiting = asked.mapInArrow(walk, "leaf int, part int, id long, v array<double>").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int"))
    of = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))
    blocks = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), of[F.col("leaf")]).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, m = right["id"].to_numpy(), np.stack(right["v"].to_numpy())
            found = [(q, i, d) for q, v in zip(left["id"], left["v"]) for i, d in nearest(ids, m, q, v, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    group = ["leaf", "part", "share"]
    found = visiting.groupBy(*group).cogroup(blocks.groupBy(*group)).applyInPandas(scan, "query_id long, vec_id long, score double")
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
