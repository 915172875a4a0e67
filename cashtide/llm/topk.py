"""Exact top-k search by inner product: cover trees over queries and data, searched together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, saved

#: Points of a leaf; rows that one search takes; rows of a cell's block; cells, tasks and rows of the seed sample at most.
LEAF, QUERY_BLOCK, CELL, MOST_CELLS, MOST_TASKS, SEED = 512, 2048, 4096, 1024, 4096, 2048
#: Scores that doubles and packed numbers hold are below LIMIT; a block's rows are below PLACES; no score; the largest long.
LIMIT, PLACES, NONE, MOST = 1 << 40, 1 << 21, -(1 << 62), (1 << 63) - 1


class CoverTree:
    """Nested covers: a node's points lie within `radius` of its centre; children cover them with smaller radii.

    Nodes are arrays: centre (row), radius, start and end (its rows are order[start:end]), children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        if len(x):
            self._build(0, len(x), 0, leaf)

    def _build(self, a: int, b: int, centre: int, leaf: int) -> int:
        rows = self.order[a:b]
        d = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1))
        me, r = len(self.centre), float(d.max())
        self.centre.append(centre)
        self.radius.append(r)
        self.span.append((a, b))
        self.children.append([])
        if b - a <= leaf or r == 0.0:
            return me
        # centres of the next cover: rows further than r / 1.3 from all before, sixteen at most; each row
        # goes to its nearest centre, so the children partition the node and their radii follow from the data
        picks, near = [centre], d.copy()
        owner = np.zeros(len(rows), np.int64)
        while len(picks) < 16 and near.max() > r / 1.3:
            k = int(near.argmax())
            e = np.sqrt(((self.x[rows] - self.x[rows[k]]) ** 2).sum(axis=1))
            closer = e < near
            owner[closer], near = len(picks), np.minimum(near, e)
            picks.append(int(rows[k]))
        if len(picks) == 1 or np.bincount(owner, minlength=len(picks)).max() == len(rows):
            half = np.argsort(d, kind="stable")
            owner = np.zeros(len(rows), np.int64)
            owner[half[len(half) // 2 :]] = 1
            picks = [centre, int(rows[half[-1]])]
        sort = np.argsort(owner, kind="stable")
        self.order[a:b] = rows[sort]
        at = a
        for k, n in enumerate(np.bincount(owner, minlength=len(picks)).tolist()):
            if n:
                self.children[me].append(self._build(at, at + n, picks[k], leaf))
                at += n
        return me


class Kth:
    """The k best (score, place) of each of n queries so far; a place is the rank of a row's id, so ties fall to
    smaller ids. Scores and places share one 64-bit number: scores stay below LIMIT, see `small`."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.best, self.floor, self.worst = np.full((n, k), NONE, np.int64), floor, floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray, mine: np.ndarray) -> None:
        packed = np.where(mine, NONE, scores * PLACES + (PLACES - 1 - places))
        k = self.best.shape[1]
        self.best[rows] = np.partition(np.concatenate((self.best[rows], packed), axis=1), -k, axis=1)[:, -k:]
        self.worst[rows] = np.maximum(self.floor[rows], self.best[rows].min(axis=1) // PLACES)


def small(queries: np.ndarray, data: np.ndarray) -> bool:
    """Whether every product of these rows is below LIMIT, so that doubles hold it exactly."""
    norm = lambda x: float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
    with np.errstate(over="ignore", invalid="ignore"):
        return norm(queries) * norm(data) < LIMIT


def dual_tree(queries: np.ndarray, own: np.ndarray, tree: CoverTree, ids: np.ndarray, k: int, floor: np.ndarray):
    """(query row, data row, score) of each query's k largest scores among the tree's rows, ties to smaller ids, rows
    of its own id excluded, and scores below its floor left out. `ids` may repeat.

    A pair of nodes can hold a product of at most q.c + |q| rc + |c| rq + rq rc. It is pruned when that is below
    the worst k-th score of the query group. Both sides' children are visited best bound first."""
    tq, tc, data = CoverTree(queries), tree, tree.x
    sort = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[sort] = np.arange(len(ids))
    kth = Kth(len(queries), k, floor)
    group = np.array([kth.worst[tq.order[a:b]].min() for a, b in tq.span])
    parent = np.full(len(tq.centre), -1)
    for p, cs in enumerate(tq.children):
        parent[cs] = p
    qc, cc = queries[tq.centre], data[tc.centre]
    qn, cn = np.sqrt((qc * qc).sum(axis=1)), np.sqrt((cc * cc).sum(axis=1))
    rq, rc = np.array(tq.radius), np.array(tc.radius)

    def bounds(q: list[int], c: list[int]) -> np.ndarray:
        return reach(qc[q], qn[q], rq[q], cc[c], cn[c], rc[c])

    def base(q: int, c: int) -> None:
        rows, cols = tq.order[slice(*tq.span[q])], tc.order[slice(*tc.span[c])]
        s = np.rint(queries[rows] @ data[cols].T).astype(np.int64)
        some = np.flatnonzero(s.max(axis=1) >= kth.worst[rows])
        if len(some):
            kth.add(rows[some], s[some], place[cols], own[rows[some]][:, None] == ids[cols][None, :])
        group[q] = kth.worst[rows].min()
        up = parent[q]
        while up >= 0:
            low = group[tq.children[up]].min()
            if low == group[up]:
                break
            group[up], up = low, parent[up]

    todo = [(np.inf, 0, 0)] if len(queries) and len(data) else []
    while todo:
        bound, q, c = todo.pop()
        if bound < group[q]:
            continue
        if not tq.children[q] and not tc.children[c]:
            base(q, c)
            continue
        qs = tq.children[q] if tq.children[q] and (not tc.children[c] or rq[q] >= rc[c]) else [q]
        cs = tc.children[c] if qs == [q] else [c]
        m = bounds(qs, cs)
        x, y = np.nonzero(m >= group[qs][:, None])
        todo += sorted((float(m[i, j]), qs[i], cs[j]) for i, j in zip(x, y, strict=True))
    q, _ = np.nonzero((kth.best > NONE) & (kth.best // PLACES >= floor[:, None]))
    found = kth.best[(kth.best > NONE) & (kth.best // PLACES >= floor[:, None])]
    return q, sort[PLACES - 1 - found % PLACES], found // PLACES


def reach(qc, qn, rq, cc, cn, rc) -> np.ndarray:
    """The largest product that balls around qc and cc may hold, one row per query ball, rounded up."""
    b = qc @ cc.T + qn[:, None] * rc[None, :] + cn[None, :] * rq[:, None] + rq[:, None] * rc[None, :]
    return b + 1e-6 + 1e-12 * (qn + rq)[:, None] * (cn + rc)[None, :]


def exact(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """What dual_tree returns, for components so large that doubles would round: in Python's integers, query by
    query. A score outside the range of a long becomes the nearest long."""
    whole = [[int(c) for c in row] for row in data]
    out = []
    for i, x in enumerate(queries):
        q = [int(c) for c in x]
        some = [(-min(max(sum(a * b for a, b in zip(q, row, strict=True)), -MOST), MOST), int(ids[j]), j) for j, row in enumerate(whole) if ids[j] != own[i]]
        out += [(i, j, -s) for s, _, j in heapq.nsmallest(k, some)]
    q, j, s = zip(*out, strict=True) if out else ((), (), ())
    return np.array(q, np.int64), np.array(j, np.int64), np.array(s, np.int64)


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, width and v: floor(scale * x) of every component, as little-endian 32-bit integers where all fit, else
    as doubles; vectors that are null or hold null or non-finite components take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, start, end, x = finite_vectors(b.column("embedding"))
            x = np.floor(scale * x)
            large = np.concatenate(([0], np.cumsum(~(np.abs(x) < 1 << 31))))
            out, short = [], np.where(np.abs(x) < 1 << 31, x, 0.0).astype("<i4")
            for i, j in zip(start.tolist(), end.tolist(), strict=True):
                out.append((x if large[j] > large[i] else short)[i:j].tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id").take(pa.array(keep)), "width": pa.array(end - start, pa.int32()), "v": pa.array(out, pa.binary())})

    return rows.where("embedding is not null and vec_id is not null").selectExpr("cast(vec_id as long) as vec_id", "embedding").mapInArrow(run, "vec_id long, width int, v binary")


def matrix(vs: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i4" if len(v) == 4 * width else "<f8").astype(np.float64) for v in vs])


def pivots(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of x, each the one furthest from those before: the top level of the cover."""
    picks, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picks) < n and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picks[-1]]) ** 2).sum(axis=1))
    return x[picks]


def search(rows: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best integer inner products of each query with every other row.

    1. A sample of SEED rows gives the pivots of the top level (one per CELL rows, MOST_CELLS at most) and, for
       each query, a score that its k-th best cannot fall below. It decides nothing else.
    2. Every row goes to its nearest pivot's cell. Per cell the driver gets one row: counts, radii, lowest floor.
       Cell pairs whose radii rule out the floor of the cell's queries are pruned before any vector moves.
    3. Each cell's rows go, in blocks of about CELL, to one task each; every query goes to the blocks left to it.
       A task builds its block's cover tree once and searches it with trees over the queries, QUERY_BLOCK at a time.
    4. The blocks' lists are merged per query.

    Ties go to smaller vec_id; queries with fewer than k other rows return those. Only vectors of equal length are
    compared. Rows without vec_id take no part. Rows with a repeated vec_id are each a candidate, and none is one of
    its own id; the list of such an id is the best of all its different vectors. Scores are exact; beyond the range
    of a long the nearest long. Empty table: empty result. Extra columns are ignored.
    """
    data = quantised(rows, scale)
    total = rows.where("embedding is not null and vec_id is not null").count()
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SEED).collect()
    seeds, tops, first = {}, {}, 0
    for width in sorted({r["width"] for r in sample}):
        some = [r for r in sample if r["width"] == width]
        x = matrix([r["v"] for r in some], width)
        seeds[width] = (np.array([r["vec_id"] for r in some]), x)
        share = len(some) / len(sample)
        tops[width] = (first, pivots(x, max(1, min(MOST_CELLS, int(share * total) // CELL))))
        first += len(tops[width][1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, widths, vs, asked = (b.column(c).to_pylist() for c in ("vec_id", "width", "v", "asked"))
            cell, far, floor = [0] * len(ids), [0.0] * len(ids), [None] * len(ids)
            for width in set(widths):
                at = [i for i, w in enumerate(widths) if w == width]
                x = matrix([vs[i] for i in at], width)
                start, tops_x = tops.get(width, (-1 - width, np.zeros((1, width))))
                d = (tops_x * tops_x).sum(axis=1)[None, :] - 2.0 * (x @ tops_x.T)
                near = d.argmin(axis=1)
                gap = np.sqrt(((x - tops_x[near]) ** 2).sum(axis=1))
                for i, c, g in zip(at, near.tolist(), gap.tolist(), strict=True):
                    cell[i], far[i] = start + c, g
                names, sx = seeds.get(width, (np.zeros(0), np.zeros((0, width))))
                q = [n for n, i in enumerate(at) if asked[i]]
                if q and len(sx) > k and small(x[q], sx):
                    s = np.rint(x[q] @ sx.T)
                    s[np.array([ids[at[n]] for n in q])[:, None] == names[None, :]] = -np.inf
                    for n, low in zip(q, np.partition(s, -k, axis=1)[:, -k].tolist(), strict=True):
                        floor[at[n]] = low if np.isfinite(low) else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64()), pa.array(floor, pa.float64())], names=[*b.schema.names, "cell", "far", "floor"])

    flagged = data.withColumn("asked", F.coalesce(is_query, F.lit(False)))
    placed = saved(flagged.mapInArrow(place, "vec_id long, width int, v binary, asked boolean, cell int, far double, floor double"))
    low = F.min(F.when(F.col("asked"), F.coalesce("floor", F.lit(float("-inf")))))
    stats = placed.groupBy("cell", "width").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max(F.when(F.col("asked"), F.col("far"))).alias("rq"), low.alias("low")).collect()
    targets = []
    for width in {s["width"] for s in stats}:
        start, x = tops.get(width, (-1 - width, np.zeros((1, width))))
        c = [s for s in stats if s["width"] == width]
        q = [s for s in c if s["rq"] is not None]
        if q:
            norm = np.sqrt((x * x).sum(axis=1))
            i, j = [s["cell"] - start for s in q], [s["cell"] - start for s in c]
            m = reach(x[i], norm[i], np.array([s["rq"] for s in q]), x[j], norm[j], np.array([s["r"] for s in c]))
            for s, bounds in zip(q, m, strict=True):
                for t, bound in zip(c, bounds.tolist(), strict=True):
                    if not bound < s["low"]:
                        targets.append((s["cell"], t["cell"], -(-t["n"] // CELL)))
    spark = rows.sparkSession
    pairs = spark.createDataFrame(targets, "own_cell int, cell int, parts int")  # MOST_CELLS^2 rows at most
    parts = spark.createDataFrame([(s["cell"], -(-s["n"] // CELL)) for s in stats], "cell int, parts int")
    dealt = placed.withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(parts), "cell")
    blocks = dealt.select("cell", F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "width", "vec_id", "v", "floor")
    asked = placed.where("asked").dropDuplicates(["vec_id", "v"]).withColumnRenamed("cell", "own_cell").join(F.broadcast(pairs), "own_cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "width", "vec_id", "v", "floor")
    n = max(1, min(MOST_TASKS, sum(-(-s["n"] // CELL) for s in stats)))
    tasks = blocks.unionByName(asked).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        block: list = []
        asked: list = []
        tree, ids = None, np.zeros(0, np.int64)

        def found() -> pa.RecordBatch:
            nonlocal tree, ids
            width = at[2]
            if tree is None:
                ids, tree = np.array([h[0] for h in block]), CoverTree(matrix([h[1] for h in block], width))
            own, x = np.array([h[0] for h in asked]), matrix([h[1] for h in asked], width)
            floor = np.array([-LIMIT if h[2] is None else int(h[2]) for h in asked], np.int64)
            i, j, s = dual_tree(x, own, tree, ids, k, floor) if small(x, tree.x) else exact(x, own, tree.x, ids, k)
            asked.clear()
            return pa.RecordBatch.from_pydict({"query_id": pa.array(own[i], pa.int64()), "vec_id": pa.array(ids[j], pa.int64()), "score": pa.array(s, pa.int64())})

        for b in batches:
            for cell, part, width, side, *row in zip(*[b.column(c).to_pylist() for c in ("cell", "part", "width", "side", "vec_id", "v", "floor")], strict=True):
                if (cell, part, width) != at:
                    if block and asked:
                        yield found()
                    at, block, asked, tree = (cell, part, width), [], [], None
                (asked if side else block).append(row)
                if block and len(asked) >= QUERY_BLOCK:
                    yield found()
        if block and asked:
            yield found()

    lists = tasks.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
