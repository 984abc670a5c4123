"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are turned to integers first. All vectors are dealt to regions around a
bounded number of centres (the top of the tree), and regions to blocks of
bounded size by a hash, so that a region with a third of all rows is many
blocks. A query enters a region only if <q,c> + |q|R reaches its bound: the kth
best score over a bounded set of seed vectors, which the true kth score can't be
below. In a block, queries and data are each indexed by a cover tree, and pairs
of nodes are dropped where

    <cq,cx> + |cq| Rx + |cx| Rq + Rq Rx < the least kth score in the query node

which no pair below them can beat. Ties stay, and go to the smaller id.

Seeds and centres only steer the pruning: any choice gives the same result.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do null ids; rows with the same id and vector count
once; a row is no candidate of a query with its id; vectors of other lengths are
taken as ending in zeros; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: Rows of the seed set; centres of regions; rows of a block.
SEEDS, REGIONS, BLOCK = 1024, 48, 8192
#: Vectors of a leaf, and the ratio of radii from one level of a tree to the next.
LEAF, RATIO = 24, 1.6


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if one is null or not finite, or there are none."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(lists, width: int):
    import numpy as np

    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _scores(a, b):
    """Exact integer inner products: by floats where all sums stay below 2^53, else by Python's integers."""
    import numpy as np

    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**52:
        return a @ b.T
    return a.astype("i8").astype(object) @ b.astype("i8").astype(object).T


class CoverTree:
    """Nodes with a centre (a point of theirs), a covering radius, and children apart by more than the next radius, or points."""

    def __init__(self, points):
        import numpy as np

        self.x, self.center, self.radius, self.kids, self.points = points, [], [], [], []
        todo = [(np.arange(len(points)), None)]
        while todo:
            idx, parent = todo.pop()
            n = len(self.center)
            d = np.sqrt(np.maximum(((points[idx] - points[idx[0]]) ** 2).sum(axis=1), 0))
            big = float(d.max())
            self.center.append(int(idx[0]))
            self.radius.append(big)
            self.kids.append([])
            self.points.append(None)
            if parent is not None:
                self.kids[parent].append(n)
            if len(idx) <= LEAF or big == 0:
                self.points[n] = idx
                continue
            reach, left, lone = big / RATIO, idx, []
            while len(left):
                d = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(axis=1))
                near = d <= reach
                if near.sum() == 1:
                    lone.append(left[:1])
                else:
                    todo.append((left[near], n))
                left = left[~near]
            for at in range(0, len(lone), LEAF):  # points alone in their ball share leaves under the same parent
                todo.append((np.concatenate(lone[at : at + LEAF]), n)) if at or len(lone) < len(idx) else self._leaf(np.concatenate(lone[at : at + LEAF]), n)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.norm = np.sqrt((points[self.center] ** 2).sum(axis=1))

    def _leaf(self, idx, parent: int) -> None:
        import numpy as np

        self.kids[parent].append(len(self.center))
        self.center.append(int(idx[0]))
        self.radius.append(float(np.sqrt(((self.x[idx] - self.x[idx[0]]) ** 2).sum(axis=1)).max()))
        self.kids.append([])
        self.points.append(idx)

    def below(self, n: int):
        import numpy as np

        return self.points[n] if self.points[n] is not None else np.concatenate([self.below(k) for k in self.kids[n]])


def dual(q, qid, x, xid, k: int, worst):
    """(query row, data row, score) of the k best of each query that reach its bound in worst."""
    import numpy as np

    qt, xt = CoverTree(q), CoverTree(x)
    worst = worst.astype("f8").copy()
    best = [(np.empty(0), np.empty(0, "i8")) for _ in q]

    def bound(n: int, nodes):
        c = q[qt.center[n]]
        dots = x[xt.center[nodes]] @ c
        up = dots + qt.norm[n] * xt.radius[nodes] + xt.norm[nodes] * qt.radius[n] + qt.radius[n] * xt.radius[nodes]
        return up + 1e-9 * np.abs(up) + 1

    def base(rows, cols) -> None:
        s = _scores(q[rows], x[cols])
        for i, r in enumerate(rows):
            v = np.asarray(s[i], "f8")
            ok = np.nonzero((v >= worst[r]) & (xid[cols] != qid[r]))[0]
            if len(ok):
                a, b = np.concatenate([best[r][0], s[i][ok]]), np.concatenate([best[r][1], cols[ok]])
                order = np.lexsort((xid[b], -a))[:k]
                best[r] = a[order], b[order]
                if len(order) == k:
                    worst[r] = max(worst[r], float(a[order[-1]]))

    def walk(n: int, nodes) -> None:
        rows = qt.below(n)
        if qt.points[n] is None:
            nodes = nodes[bound(n, nodes) >= worst[rows].min()]
            wide = [m for m in nodes if xt.points[m] is None and xt.radius[m] >= qt.radius[n]]
            if wide:
                nodes = np.array([m for m in nodes if xt.points[m] is not None or xt.radius[m] < qt.radius[n]] + [c for m in wide for c in xt.kids[m]])
            for child in qt.kids[n]:
                if len(nodes):
                    walk(child, nodes)
            return
        while len(nodes):
            up = bound(n, nodes)
            live = up >= worst[rows].min()
            nodes, up = nodes[live], up[live]
            order = np.argsort(-up, kind="stable")
            leaves = [m for m in nodes[order] if xt.points[m] is not None]
            for at in range(0, len(leaves), 16):
                part = np.array(leaves[at : at + 16])
                part = part[bound(n, part) >= worst[rows].min()]
                if len(part):
                    base(rows, np.concatenate([xt.points[m] for m in part]))
            nodes = np.array([c for m in nodes[order] if xt.points[m] is None for c in xt.kids[m]], dtype=int)

    walk(0, np.array([0]))
    return [(r, int(c), s) for r, (a, b) in enumerate(best) for s, c in zip(a.tolist(), b.tolist(), strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, seeds: int = SEEDS, regions: int = REGIONS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k highest scores of each query; both tables have the columns id and vector."""
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        return df.select(F.col(id).cast("long").alias("id"), integers(F.col(vector), scale).alias("v")).where("id is not null and v is not null").distinct()

    data = written(ready(vectors), "vectors")
    sample = [(r.id, r.v) for r in data.orderBy(F.xxhash64("id", "v"), "id").limit(seeds).collect()]  # bounded by seeds
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id)
    if not sample:
        return none
    width = data.agg(F.max(F.size("v"))).first()[0]
    seed_ids, seed_rows = [i for i, _ in sample], _matrix([v for _, v in sample], width)
    centers = seed_rows[:regions]

    def region(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("v").to_pylist(), width)
            near, dist = np.zeros(len(x), "i4"), np.full(len(x), np.inf)
            for i, c in enumerate(centers):
                d = ((x - c) ** 2).sum(axis=1)
                less = d < dist
                near[less], dist[less] = i, d[less]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near), pa.array(np.sqrt(dist))], names=["id", "v", "region", "dist"])

    placed = data.mapInArrow(region, "id long, v array<long>, region int, dist double")
    placed = written(placed, "regions")
    facts = {r.region: (r.n, r.far) for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).collect()}  # a row per centre
    parts = {r: -(-n // block) for r, (n, _) in facts.items()}
    split = F.element_at(F.create_map(*(F.lit(x) for p in parts.items() for x in p)), F.col("region"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "v"), split).cast("int")).drop("dist")

    def enter(batches):
        import numpy as np
        import pyarrow as pa

        live = sorted(facts)
        c = centers[live]
        far = np.array([facts[r][1] for r in live])
        for b in batches:
            ids, lists = b.column("id").to_pylist(), b.column("v").to_pylist()
            q = _matrix(lists, width)
            s = np.asarray(_scores(q, seed_rows), "f8")
            s[np.array(ids)[:, None] == np.array(seed_ids)[None, :]] = -np.inf
            low = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] >= k else np.full(len(q), -np.inf)
            up = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * far[None, :]
            rows, cols = np.nonzero(up + 1e-9 * np.abs(up) + 1 >= low[:, None])
            got = [(r, live[j], p) for r, j in zip(rows.tolist(), cols.tolist(), strict=True) for p in range(parts[live[j]])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r, _, _ in got], pa.int64()), pa.array([lists[r] for r, _, _ in got], pa.list_(pa.int64())), pa.array([low[r] for r, _, _ in got], pa.float64()), pa.array([j for _, j, _ in got], pa.int32()), pa.array([p for _, _, p in got], pa.int32())],
                names=["id", "v", "low", "region", "part"],
            )

    asked = ready(queries).mapInArrow(enter, "id long, v array<long>, low double, region int, part int").withColumn("which", F.xxhash64("v"))

    def pair(key, a, b):
        import numpy as np
        import pandas as pd

        got = []
        if len(a) and len(b):
            q, x = _matrix(a.v.tolist(), width), _matrix(b.v.tolist(), width)
            got = dual(q, a.id.to_numpy(), x, b.id.to_numpy(), k, a.low.to_numpy())
        rows, cols = [r for r, _, _ in got], [c for _, c, _ in got]
        long = lambda x: np.array(x, dtype="i8")
        return pd.DataFrame({"query_id": long(a.id.to_numpy()[rows] if rows else []), "which": long(a.which.to_numpy()[rows] if rows else []), "vec_id": long(b.id.to_numpy()[cols] if cols else []), "score": long([int(s) for _, _, s in got])})

    # `which` tells queries apart that share an id but not their vector
    found = asked.groupBy("region", "part").cogroup(placed.groupBy("region", "part")).applyInPandas(pair, "query_id long, which long, vec_id long, score long")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id), "score")
