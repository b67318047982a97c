"""Exact top-k inner-product search with M-trees.

Vectors are dealt to trees of bounded size around sampled pivots. A tree is
made of paged metric nodes: each has a routing vector, a covering radius and
its distance to the parent's routing vector, each leaf entry its distance to
the leaf's routing vector. For a query q, a vector x within r of a routing
vector c has q.x <= q.c + |q| r, and by the triangle inequality a child c' of
c has q.c' <= q.c + |q| d(c, c'), so stored distances rule out nodes and
entries whose inner products are never computed. Nodes are visited best bound
first until the best bound left is below the k-th score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

PAGE = 512             # entries of a leaf
FAN_OUT = 24           # children of an inner node
TREE = 8192            # vectors of a tree, about
PIVOTS = 512           # most sampled pivots
QUERY_BLOCK = 1024     # queries searched together in one tree
_SLACK = 1e-6          # bounds are floats; scores are whole numbers


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             scale: int = 256) -> DataFrame:
    """(row, vec_id, dim, v array<bigint>): floor(scale * x) of every component;
    ``row`` tells rows of one id apart (written, so that it stays). No part take
    rows without id, vectors that are null or hold a null or non-finite
    component, and those whose squares sum to 2^63 or more: of all others every
    inner product is a long."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                       F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0 ** 62 / scale))
    whole = x.where(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("bigint")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return materialise(whole.where(squares < 2.0 ** 63 * (1 - 1e-9)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"), "vectors")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=-1))


def build_tree(v: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of an M-tree over the rows of ``v`` (at least one), parents
    before children: routing row, radius, parent, distance to the parent's
    routing vector, first and last entry of a leaf; and the entries leaf by
    leaf: their rows in ``v`` (``order``), to be stored in that order, and the
    distances to the leaf's routing vector. Routing rows count in that order."""
    route, radius, parent, to_parent, first, last, order, to_leaf = [], [], [], [], [], [], [], []

    def node(c: int, d: np.ndarray, up: int, up_distance: float) -> int:
        route.append(c)
        radius.append(float(d.max()))
        parent.append(up)
        to_parent.append(up_distance)
        first.append(-1)
        last.append(-1)
        return len(route) - 1

    rng = np.random.default_rng(len(v))
    rows = np.arange(len(v))
    centre = int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
    work = [(rows, centre, _distance(v, v[centre]), -1, 0.0)]
    while work:
        rows, c, d, up, up_distance = work.pop()
        me = node(c, d, up, up_distance)
        if len(rows) <= PAGE or d.max() == 0:
            first[me], last[me] = len(order), len(order) + len(rows)
            order.extend(rows.tolist())
            to_leaf.extend(d.tolist())
            continue
        # routing vectors: the rows nearest to and farthest from this one's, so that the rows do part, and a sample
        chosen = np.unique(np.append(rng.choice(len(rows), FAN_OUT, replace=False), [d.argmin(), d.argmax()]))
        near, own = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
        for i, r in enumerate(rows[chosen].tolist()):
            there = _distance(v[rows], v[r])
            own[there < near] = i
            near = np.minimum(near, there)
        chosen = rows[chosen].tolist()
        for i, r in enumerate(chosen):
            mine = own == i
            if mine.any():
                work.append((rows[mine], r, near[mine], me, float(_distance(v[c], v[r]))))
    place = np.empty(len(v), dtype=np.int64)
    place[order] = np.arange(len(v))
    return {"route": place[route], "radius": np.array(radius), "parent": np.array(parent),
            "to_parent": np.array(to_parent), "first": np.array(first), "last": np.array(last),
            "order": np.array(order), "to_leaf": np.array(to_leaf)}


class Tree:
    """A tree ready for search: ids, rows and vectors in leaf order, node arrays."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, nodes: dict[str, np.ndarray]):
        self.ids, self.rows, self.v, self.exact = ids, rows, v.astype(np.float64), v
        self.__dict__.update(nodes)
        self.largest = float(np.abs(self.v).sum(axis=1).max())
        by_parent: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent.tolist()):
            by_parent.setdefault(p, []).append(i)
        self.children = {p: np.array(c) for p, c in by_parent.items()}
        self.computed = 0  # inner products computed

    def search(self, q: np.ndarray, q_row: int, k: int, floor: float) -> list[tuple[int, int, int]]:
        """The k best (score, vec_id, row) among entries that score ``floor`` or more."""
        qf = q.astype(np.float64)
        # whole numbers below 2^53 are exact in floats, and their products are faster
        exact = self.v if self.largest * float(np.abs(qf).max(initial=0.0)) < 2.0 ** 53 else None
        size = float(np.sqrt(qf @ qf)) * (1 + 1e-12)
        best: list[tuple[int, int, int]] = []  # heap of (score, -vec_id, -row), worst first
        least = floor
        at = float(qf @ self.v[self.route[0]])
        heap = [(-(at + size * self.radius[0]), 0, at)]
        while heap:
            bound, node, at = heapq.heappop(heap)
            if -bound + _SLACK * (1 + abs(bound)) < least:
                break
            a, b = int(self.first[node]), int(self.last[node])
            if a >= 0:
                likely = at + size * self.to_leaf[a:b]
                rows = np.flatnonzero(likely + _SLACK * (1 + np.abs(likely)) >= least) + a
                if not len(rows):
                    continue
                self.computed += len(rows)
                score = self.exact[rows] @ q if exact is None else \
                    exact[a:b] @ qf if len(rows) == b - a else exact[rows] @ qf
                good = score >= least
                if len(best) < k and np.count_nonzero(good) > k + 1:  # one may be the query's own
                    good &= score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                for s, i, r in zip(score[good].tolist(), self.ids[rows[good]].tolist(), self.rows[rows[good]].tolist()):
                    if r != q_row:
                        if len(best) < k:
                            heapq.heappush(best, (int(s), -i, -r))
                        else:
                            heapq.heappushpop(best, (int(s), -i, -r))
                if len(best) == k:
                    least = max(least, best[0][0])
                continue
            children = self.children[node]
            likely = at + size * (self.to_parent[children] + self.radius[children])
            children = children[likely + _SLACK * (1 + np.abs(likely)) >= least]
            self.computed += len(children)
            there = self.v[self.route[children]] @ qf
            reach = there + size * self.radius[children]
            for i in np.flatnonzero(reach + _SLACK * (1 + np.abs(reach)) >= least).tolist():
                heapq.heappush(heap, (-float(reach[i]), int(children[i]), float(there[i])))
        return [(s, -i, -r) for s, i, r in best]


_TREE_SCHEMA = ("tree bigint, dim int, ids array<bigint>, rows array<bigint>, root array<bigint>, reach double, "
                "v binary, route array<bigint>, radius array<double>, "
                "parent array<bigint>, to_parent array<double>, first array<bigint>, last array<bigint>, "
                "to_leaf array<double>")
_NODE_ARRAYS = ["route", "radius", "parent", "to_parent", "first", "last", "to_leaf"]


def build_index(vectors: DataFrame) -> DataFrame:
    """One row a tree over (row, vec_id, dim, v): ids, vectors and node arrays,
    and apart from them the root's routing vector and radius (``reach``).

    Pivots are a bounded sample (the ``PIVOTS`` smallest id hashes at most);
    every vector goes to its nearest pivot's trees, and a pivot with more than
    ``TREE`` vectors is cut into several trees by a hash of the id, so no tree
    outgrows a task however the vectors cluster."""
    n = vectors.count()
    n_pivots = max(1, min(PIVOTS, n // TREE))
    sampled = vectors.orderBy(F.xxhash64("row"), "row").limit(n_pivots).select("dim", "v").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sampled}:
        pivots[dim] = np.array([r.v for r in sampled if r.dim == dim], dtype=np.float64).reshape(-1, dim)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            out = np.zeros(b.num_rows, dtype=np.int64)
            rows = b.column("v").to_pylist()
            for dim, p in pivots.items():
                at = np.flatnonzero(dims == dim)
                x = np.array([rows[i] for i in at], dtype=np.float64).reshape(len(at), dim)
                out[at] = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1) if len(at) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "pivot"])

    dealt = materialise(vectors.mapInArrow(nearest, "row bigint, vec_id bigint, dim int, v array<bigint>, pivot bigint"), "dealt")
    shares = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("cuts"))
    cut = dealt.join(shares, ["dim", "pivot"]) \
        .withColumn("cut", F.pmod(F.xxhash64("row", F.lit(1)), F.col("cuts")))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        v = np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), int(rows["dim"].iloc[0]))
        nodes = build_tree(v)
        order = nodes["order"]
        return pd.DataFrame([{"tree": 0, "dim": v.shape[1], "ids": rows["vec_id"].to_numpy()[order],
                              "rows": rows["row"].to_numpy()[order], "root": v[order][nodes["route"][0]],
                              "reach": nodes["radius"][0], "v": v[order].tobytes()}
                             | {c: nodes[c] for c in _NODE_ARRAYS}])

    trees = cut.groupBy("dim", "pivot", "cut").applyInPandas(build, _TREE_SCHEMA)
    return materialise(trees.withColumn("tree", F.monotonically_increasing_id()), "trees")


_ASKED = "array<struct<row: bigint, v: array<bigint>, floor: bigint>>"


def _query_blocks(queries: DataFrame, per: list[str]) -> DataFrame:
    """Queries gathered into rows of at most ``QUERY_BLOCK`` per ``per``."""
    packed = F.collect_list(F.struct("row", "v", "floor")).alias("queries")
    place = F.row_number().over(Window.partitionBy(*per, "bucket").orderBy("row")) - 1
    # the bucket keeps each window small; the block number within it keeps each row small
    return queries.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))) \
        .withColumn("part", F.floor(place / QUERY_BLOCK)).groupBy(*per, "bucket", "part").agg(packed)


def _search(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            v = np.frombuffer(r.v, dtype=np.int64).reshape(len(r.ids), r.dim)
            tree = Tree(np.asarray(r.ids), np.asarray(r.rows), v, {c: np.asarray(getattr(r, c)) for c in _NODE_ARRAYS})
            for q in r.queries:
                floor = -np.inf if q["floor"] is None else float(q["floor"])
                out += [(q["row"], i, x, s) for s, i, x in
                        tree.search(np.asarray(q["v"], dtype=np.int64), q["row"], k, floor)]
        return pd.DataFrame(out, columns=["query_row", "vec_id", "row", "score"], dtype=np.int64)

    return run


def _entering(blocks: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
    """For each tree the queries of one block whose bound at the tree's root
    reaches their k-th score so far."""
    out = []
    if len(blocks) and len(roots):
        block = blocks.iloc[0]
        asked = list(block["queries"])
        q = np.array([x["v"] for x in asked], dtype=np.float64).reshape(len(asked), int(block["dim"]))
        floor = np.array([-np.inf if x["floor"] is None else float(x["floor"]) for x in asked])
        centre = np.array(roots["root"].tolist(), dtype=np.float64).reshape(len(roots), int(block["dim"]))
        bound = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * (1 + 1e-12) * roots["reach"].to_numpy()[None, :]
        enter = bound + _SLACK * (1 + np.abs(bound)) >= floor[:, None]
        for j, tree in enumerate(roots["tree"].tolist()):
            some = np.flatnonzero(enter[:, j])
            if len(some):
                out.append((tree, block["bucket"], block["part"], [asked[i] for i in some]))
    return pd.DataFrame(out, columns=["tree", "bucket", "part", "queries"])


_HITS = "query_row bigint, vec_id bigint, row bigint, score bigint"


def search(trees: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each
    query (row, vec_id, dim, v) among the other indexed rows of its dimension,
    ties to the smaller vec_id.

    First each query searches the tree that holds its own vector (any tree, if
    it isn't indexed), which gives it a k-th score to beat. Then blocks of
    queries meet the trees' roots, a vector and a radius each, and a tree is
    sent and searched only for the queries whose bound there reaches that score."""
    n = queries.count()
    buckets = max(1, -(-n // QUERY_BLOCK))
    first_trees = trees.select("tree", "dim").groupBy("dim").agg(F.min("tree").alias("tree"))
    home = trees.select(F.col("tree").alias("home"), F.explode("rows").alias("row"))
    start = queries.join(F.broadcast(first_trees), "dim").join(home, "row", "left") \
        .select("row", "v", "dim", F.coalesce("home", "tree").alias("tree"), F.lit(None).cast("bigint").alias("floor"),
                F.lit(buckets).alias("buckets"))
    blocks = _query_blocks(start, ["dim", "tree"])
    hits = trees.join(blocks.drop("dim"), "tree").groupBy("tree", "bucket", "part").applyInPandas(_search(k), _HITS)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    kth = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") == k) \
        .select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    ready = queries.join(kth, "row", "left").withColumn("buckets", F.lit(buckets))
    blocks = materialise(_query_blocks(ready, ["dim"]), "query-blocks")
    roots = trees.select("tree", "dim", "root", "reach").join(blocks.select("dim", "bucket", "part"), "dim")
    roots = roots.select(*[F.col(c).alias(c) for c in roots.columns])  # fresh attributes: blocks are on both sides
    keys = ["dim", "bucket", "part"]
    asked = materialise(blocks.groupBy(*keys).cogroup(roots.groupBy(*keys)).applyInPandas(
        _entering, f"tree bigint, bucket bigint, part bigint, queries {_ASKED}"), "entering")
    found = trees.join(asked, "tree").groupBy("tree", "bucket", "part").applyInPandas(_search(k), _HITS)
    named = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .join(named, "query_row").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """:func:`search` for the rows whose id is divisible by ``every``, against
    all other rows. All rows are indexed; the result is exact.

    Edge cases: see :func:`quantise` for vectors that take no part; of rows
    with one id each is a query and a candidate of its own; vectors of different
    dimension do not meet, empty ones score 0; fewer than k others give fewer
    ranks; an empty table gives an empty result."""
    v = quantise(vectors, id_col, vector_col, scale)
    return search(build_index(v), v.where(F.col("vec_id") % every == 0), k)
