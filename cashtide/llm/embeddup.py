"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, finite_vectors, saved

#: Rows of a tile and of the slices in which tiles are compared; dimensions added per step; slack against rounding.
#: Boxes that meet in one task of the tile pairing, about.
TILE, SLICE, STEP, SLACK = 4096, 1024, 8, 1e-9
BOXES = 256


def rotation(vectors: DataFrame) -> np.ndarray:
    """Principal axes by falling variance of the unit vectors: sums of products over all rows, added up by Spark
    from one small matrix per task; only sums (dimensions squared) reach the driver. Vectors of another length than
    most have are left out."""
    most = vectors.groupBy(F.length("vec").alias("size")).count().orderBy(F.desc("count"), "size").head()
    if most is None:
        return np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _units(_matrix(b.column("vec").to_pylist()))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = total.size
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(n), pa.int64()), "v": pa.array(total.ravel(), pa.float64())})

    sums = vectors.where(F.length("vec") == most["size"]).select("vec").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    d = int(round(len(sums) ** 0.5))
    m = np.zeros(d * d)
    for r in sums:
        m[r["k"]] = r["v"]
    return np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] if d else np.zeros((0, 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _matrix(rows: list[bytes]) -> np.ndarray:
    return _scaled(np.stack([np.frombuffer(r, "<f8") for r in rows]))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and vec (little-endian doubles) of every row; vec is null where the row cannot be linked: label or
    vector null, a null or non-finite component, no component, or all of them zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = [None] * b.num_rows
            named = b.column("label").is_valid().to_numpy(zero_copy_only=False)
            at, start, end, x = finite_vectors(b.column("embedding"))
            x = x + 0.0  # no negative zeros: equal vectors have equal bytes
            some = np.concatenate(([0], np.cumsum(x != 0)))
            for k, i, j in zip(at.tolist(), start.tolist(), end.tolist(), strict=True):
                if named[k] and some[j] > some[i]:
                    out[k] = x[i:j].tobytes()
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "label": b.column("label"), "vec": pa.array(out, pa.binary())})

    d = rows.selectExpr("cast(vec_id as long) as vec_id", "cast(label as string) as label", "embedding")
    return d.mapInArrow(run, "vec_id long, label string, vec binary")


def _tiles(reps: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """One row per tile: neighbours along the first axis within a label, with the box of the leading coordinates."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            z, at = np.zeros(len(vecs)), [i for i, v in enumerate(vecs) if len(v) == 8 * len(axes)]
            if at:
                z[at] = _units(_matrix([vecs[i] for i in at])) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], names=[*b.schema.names, "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def full(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            x = _matrix([r[2] for r in rows])
            z = _units(x) @ axes[:, :STEP] if x.shape[1] == axes.shape[0] else np.zeros((len(x), STEP))
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([number], pa.int64()), "label": [f"{rows[0][0]}:{x.shape[1]}"], "low": [z.min(axis=0).tolist()], "high": [z.max(axis=0).tolist()],
                    "ids": [np.array([r[1] for r in rows], "<i8").tobytes()], "copies": [np.array([r[3] for r in rows], "<i8").tobytes()], "vecs": [b"".join(r[2] for r in rows)],
                }
            )

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("label", "cls", "vec", "copies")], strict=True):
                if held and (held[0][0] != r[0] or len(held[0][2]) != len(r[2]) or len(held) >= tile):
                    yield full(held)
                    held = []
                held.append(r)
        if held:
            yield full(held)

    ordered = (
        reps.mapInArrow(lead, "cls long, label string, vec binary, copies long, z double")
        .withColumn("size", F.length("vec"))
        .repartitionByRange("label", "size", "z")
        .sortWithinPartitions("label", "size", "z", "cls")
    )
    return ordered.mapInArrow(cut, "tile long, label string, low array<double>, high array<double>, ids binary, copies binary, vecs binary")


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= least between rows of a and of b (upper: i < j, a and b being the same tile)."""
    out = []
    for i in range(0, len(a), SLICE):
        for j in range(i if upper else 0, len(b), SLICE):
            x, y = _linked(a[i : i + SLICE], b[j : j + SLICE], axes, least, upper and i == j)
            out.append((x + i, y + j))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """linked() for one slice of each tile.

    Leading principal dimensions are summed first; what the rest can add is at most the product of the suffix
    norms, so pairs that cannot reach `least` stop. Survivors are decided on the vectors themselves."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    za, zb = a / na[:, None] @ axes, b / nb[:, None] @ axes
    d = za.shape[1]
    suffix = lambda z: np.sqrt(np.maximum(0.0, np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]))
    sa, sb = (np.hstack([suffix(z), np.zeros((len(z), 1))]) for z in (za, zb))
    k = min(STEP, d)
    sums = za[:, :k] @ zb[:, :k].T
    ok = sums + sa[:, k][:, None] * sb[:, k][None, :] >= least - SLACK
    if upper:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    part = sums[i, j]
    while k < d and len(i):
        n = min(d, k + STEP)
        for at in range(0, len(i), 1 << 17):
            s = slice(at, at + (1 << 17))
            part[s] += np.einsum("ij,ij->i", za[i[s], k:n], zb[j[s], k:n])
        k = n
        alive = part + sa[i, k] * sb[j, k] >= least - SLACK
        i, j, part = i[alive], j[alive], part[alive]
    close = np.abs(part - least) < 1e-6
    sure = part >= least
    if close.any():
        x, y = a[i[close]], b[j[close]]
        sure[close] = (x * y).sum(axis=1) / (na[i[close]] * nb[j[close]]) >= least
    return i[sure], j[sure]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the smallest node connected to it by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_boxes(tiles: DataFrame, least: float) -> DataFrame:
    """(tile, tile_2), tile <= tile_2, of the tiles of a label whose boxes are as near as the threshold asks.

    Boxes meet by label and by the cell of their first coordinate, cells being as wide as the threshold's distance:
    a box is in all cells it covers, the other in those and their neighbours, and a pair counts in its first
    common cell. Each cell is dealt again to as many tasks as there are BOXES boxes in the table."""
    reach = (2 - 2 * least + 1e-9) ** 0.5
    boxes = tiles.select("tile", "label", "low", "high")
    parts = max(1, -(-boxes.count() // BOXES))
    cell = lambda c, by: F.floor((F.element_at(c, 1) + by) / reach).cast("int")
    part = F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int")
    one = boxes.withColumns({"from": cell("low", 0), "part": part}).withColumn("cell", F.explode(F.sequence("from", cell("high", 0))))
    two = boxes.select(*[F.col(c).alias(f"{c}_2") for c in boxes.columns])
    two = two.withColumn("from_2", cell("low_2", -reach)).withColumn("cell_2", F.explode(F.sequence("from_2", cell("high_2", reach))))
    two = two.withColumn("part_2", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    apart = F.zip_with(F.zip_with("low", "high_2", lambda x, y: x - y), F.zip_with("low_2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    same = (F.col("label") == F.col("label_2")) & (F.col("cell") == F.col("cell_2")) & (F.col("part") == F.col("part_2"))
    met = one.join(two, same & (F.col("tile") <= F.col("tile_2")) & (F.col("cell") == F.greatest("from", "from_2")))
    return met.where(F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g) <= reach**2).select("tile", "tile_2")


def compare(tiles: DataFrame, axes: np.ndarray, least: float) -> DataFrame:
    """cls, links (weighted by copies) and root (some class linked to it, or itself) per tile pair and class
    with a link: at most one row for each class of the pair, however many links there are."""
    pairs = near_boxes(tiles, least)
    body = tiles.select("tile", "ids", "copies", "vecs")
    loaded = pairs.join(body, "tile").join(body.select(*[F.col(c).alias(f"{c}_2") for c in body.columns]), "tile_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                same = row["tile"] == row["tile_2"]
                ids, ids2 = (np.frombuffer(row[c], "<i8") for c in ("ids", "ids_2"))
                w, w2 = (np.frombuffer(row[c], "<i8") for c in ("copies", "copies_2"))
                a, b = (_scaled(np.frombuffer(row[c], "<f8").reshape(n, -1)) for c, n in (("vecs", len(ids)), ("vecs_2", len(ids2))))
                i, j = linked(a, b, axes if a.shape[1] == axes.shape[0] else np.eye(a.shape[1]), least, same)
                if not len(i):
                    continue
                shift = 0 if same else len(ids)
                every, weights = (ids, w) if same else (np.concatenate((ids, ids2)), np.concatenate((w, w2)))
                count = np.zeros(len(every), np.int64)
                np.add.at(count, i, weights[j + shift])
                np.add.at(count, j + shift, weights[i])
                root = _forest(i, j + shift, len(every))
                hit = count > 0
                yield pa.RecordBatch.from_pydict({"cls": pa.array(every[hit]), "links": pa.array(count[hit]), "root": pa.array(every[root][hit])})

    return loaded.mapInArrow(run, "cls long, links long, root long")


def near_duplicates(rows: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links join vectors of the same label with cosine >= least.

    Equal vectors of a label become one weighted class. Classes are sorted along the first principal axis into tiles;
    tile pairs whose boxes are further apart than the threshold allows are never compared. The pairs of a label are
    dealt by tile pair, so a large label spreads over many tasks. All links are counted, but only a forest of them
    leaves a task.

    Rows that cannot be linked (see `usable`) have no links and stay alone. Repeated vec_ids each have their row and
    link by their own vectors. Rows without vec_id link like others; component_id is the smallest vec_id of those
    linked that have one, else null, and such rows are kept if it is null. Extra columns are ignored. Empty table:
    empty result.
    """
    every = saved(usable(rows.select("vec_id", "label", "embedding")))
    good = every.where("vec is not null")
    grouped = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = saved(grouped.withColumn("cls", F.monotonically_increasing_id()))
    reps = classes.select("cls", "label", "vec", "copies")
    axes = rotation(reps)
    found = saved(compare(saved(_tiles(reps, axes, tile)), axes, least))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct())
    placed = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = (
        placed.join(links, "cls", "left").join(lowest, "component")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    per_vec = good.join(per_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = every.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per_vec.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
