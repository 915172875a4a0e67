"""Product codes of vectors: Lloyd's rounds for each part, sped up by Elkan's bounds that are kept between rounds.

A row of the saved state holds its vector, its entry in each part's codebook, one upper bound a part (distance to that
entry) and one lower bound an entry (distance to each). Bounds only ever rule out entries that are strictly farther;
what they leave is settled by exact integers, so the result is that of comparing everything."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, removed, saved, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of components travel in digits of so many bits, so that they are exact whatever their size.
DIGIT = 32
#: Labels up to which their sums are broadcast (a few MB); more are joined.
FEW_LABELS = 100_000
STATE = "vec_id long, label string, v binary, kind int, code binary, upper binary, lower binary"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exact: Python's integers where 64 bits would not hold them."""
    y = np.floor(SCALE * x)
    if y.size == 0 or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([math.floor(float(a)) if math.isfinite(a) else math.floor(float(b)) * SCALE for a, b in zip(y.ravel(), x.ravel(), strict=True)], object).reshape(x.shape)


def limit(width: int) -> int:
    """Components below it keep squared distances of a part within 64 bits."""
    return math.isqrt((1 << 61) // max(width // PARTS, 1)) // 2


#: Kinds of rows: bytes of a component, or 0 where components are decimal texts.
KINDS = (2, 4, 0)


def _packed(v: np.ndarray, kind: int) -> list[bytes]:
    return [r.tobytes() for r in v.astype(f"<i{kind}")] if kind else [",".join(map(str, r)).encode() for r in v]


def _unpacked(cells: list[bytes], kind: int, width: int) -> np.ndarray:
    if not kind:
        return np.array([[int(x) for x in c.split(b",")] for c in cells], object).reshape(-1, width)
    return np.frombuffer(b"".join(cells), f"<i{kind}").astype(np.int64).reshape(-1, width)


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        for kind in KINDS:
            part = b.filter(pc.equal(b.column("kind"), kind))
            if part.num_rows:
                yield kind, part


def quantised(vectors: DataFrame, width: int) -> DataFrame:
    """STATE rows of all usable vectors, without bounds; components beyond a vector's end are 0."""
    most, n = min(limit(width), (1 << 31) - 1), width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, start, end, x = finite_vectors(b.column("embedding"))
            if not len(rows):
                continue
            full = np.zeros((len(rows), n))
            for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                full[i, : e - s] = x[s:e]
            top = np.abs(full).max(axis=1, initial=0)
            kinds = np.select([top < min(most, 1 << 15) / SCALE, top < most / SCALE], KINDS[:2], KINDS[2])
            for kind in KINDS:
                at = np.flatnonzero(kinds == kind)
                if len(at):
                    part = b.take(pa.array(rows[at]))
                    none = pa.nulls(len(at), pa.binary())
                    yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "label": part.column("label"), "v": pa.array(_packed(integers(full[at]), kind), pa.binary()), "kind": pa.array([kind] * len(at), pa.int32()), "code": none, "upper": none, "lower": none})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, STATE)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-14)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-14)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def half(x: np.ndarray) -> np.ndarray:
    """Non-negative doubles as 16-bit floats, rounded down: a lower bound stays one."""
    y = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(y.astype(float) > x, np.nextafter(y, np.float16(0)), y)


def rounded_up(x: np.ndarray) -> np.ndarray:
    """Doubles as 32-bit floats, rounded up: an upper bound stays one."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y.astype(float) < x, np.nextafter(y, np.float32(np.inf)), y)


def nearest(x: np.ndarray, c: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Sets each row of x to its nearest entry of c, ties to the lower index, and mends the bounds in place. Returns
    how many distances it computed.

    Entry j is passed over if the row's upper bound is strictly below its lower bound for j, or strictly below half
    the distance from its own entry to j; equal bounds are no proof, so exact integers decide there."""
    k = len(c)
    between = _down(np.sqrt(_squares(c[:, None, :], c[None, :, :]).astype(float))) / 2
    np.fill_diagonal(between, np.inf)
    active = np.flatnonzero(~(upper < between.min(axis=1)[code]))
    if not len(active):
        return 0
    own = _squares(x[active], c[code[active]])
    best, done = own.copy(), len(active)
    lower[active, code[active]] = _down(np.sqrt(own.astype(float)))
    at, near = code[active].copy(), _up(np.sqrt(own.astype(float)))
    start = code[active]
    for j in range(k):
        ask = np.flatnonzero((start != j) & (at != j) & ~(near < lower[active, j]) & ~(near < between[at, j]))
        if not len(ask):
            continue
        d = _squares(x[active[ask]], c[j])
        done += len(ask)
        far = np.sqrt(d.astype(float))
        lower[active[ask], j] = _down(far)
        better = (d < best[ask]) | ((d == best[ask]) & (j < at[ask]))
        won = ask[better]
        best[won], at[won], near[won] = d[better], j, _up(far[better])
    code[active], upper[active] = at, near
    return done


def step(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None, width: int, last: bool) -> DataFrame:
    """The state after assigning every part anew; `moved` is how far each entry has moved since the bounds were set.
    At the last step the rows are (vec_id, label, code, error), the error in decimal."""
    w, most = width // PARTS, limit(width)
    big = any(len(c) and w and abs(c).max() >= most for c in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, b in _by_kind(batches):
            n, exact = b.num_rows, big or not kind
            x = _unpacked(b.column("v").to_pylist(), kind, width)
            if exact:
                x = x.astype(object)
            if moved is None:
                code, upper, lower = np.zeros((PARTS, n), np.int64), np.full((PARTS, n), np.inf), np.zeros((PARTS, n, len(books[0])))
            else:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, PARTS).T.astype(np.int64)
                upper = np.frombuffer(b"".join(b.column("upper").to_pylist()), "<f4").reshape(n, PARTS).T.astype(float)
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f2").reshape(n, PARTS, -1).transpose(1, 0, 2).astype(float)
            error = np.zeros(n, object)
            for p, c in enumerate(books):
                mine = x[:, p * w : (p + 1) * w]
                c = c.astype(object if exact else np.int64)
                if moved is not None:
                    upper[p] = _up(upper[p] + moved[p][code[p]])
                    lower[p] = _down(np.maximum(lower[p] - moved[p], 0))
                nearest(mine, c, code[p], upper[p], lower[p])
                if last:
                    error += _squares(mine, c[code[p]]).astype(object)
            if last:
                text = [r.tobytes().hex() for r in code.T.astype(np.uint8)]
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "label": b.column("label"), "code": pa.array(text, pa.string()), "error": pa.array([str(e) for e in error], pa.string())})
                continue
            yield pa.RecordBatch.from_pydict(
                {"vec_id": b.column("vec_id"), "label": b.column("label"), "v": b.column("v"), "kind": b.column("kind"),
                 "code": pa.array([r.tobytes() for r in code.T.astype(np.uint8)], pa.binary()),
                 "upper": pa.array([r.tobytes() for r in rounded_up(upper).T.astype("<f4")], pa.binary()),
                 "lower": pa.array([r.tobytes() for r in half(lower).transpose(1, 0, 2).astype("<f2")], pa.binary())}
            )

    return state.mapInArrow(run, "vec_id long, label string, code string, error string" if last else STATE)


def sums(state: DataFrame, width: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts by part and entry, exact sums by part, entry and place), summed within each task first. What reaches
    the driver is a number for each of them and digit, however many vectors there are."""
    w = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, w), object)
        for kind, b in _by_kind(batches):
            x = _unpacked(b.column("v").to_pylist(), kind, width)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                count[p] += np.bincount(code[:, p], minlength=entries)
                one = np.zeros((entries, w), x.dtype)
                np.add.at(one, code[:, p], x[:, p * w : (p + 1) * w])
                total[p] += one
        rows: dict[str, list] = {"part": [], "entry": [], "place": [], "digit": [], "value": []}
        for p, e in zip(*np.nonzero(count), strict=True):
            for place, value in [(-1, int(count[p, e])), *enumerate(map(int, total[p, e]))]:
                digit = 0
                while True:  # two's complement digits: the last one carries the sign
                    end = -(1 << DIGIT - 1) <= value < 1 << DIGIT - 1
                    low = value if end else value & (1 << DIGIT) - 1
                    for k, z in zip(rows, (int(p), int(e), place, digit, low), strict=True):
                        rows[k].append(z)
                    if end:
                        break
                    value, digit = value >> DIGIT, digit + 1
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "value" else pa.int32()) for k, v in rows.items()})

    count, total = np.zeros((PARTS, entries), object), np.zeros((PARTS, entries, w), object)
    found = state.select("v", "kind", "code").mapInArrow(run, "part int, entry int, place int, digit int, value long")
    for r in found.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():
        into = r["value"] << DIGIT * r["digit"]
        if r["place"] < 0:
            count[r["part"], r["entry"]] += into
        else:
            total[r["part"], r["entry"], r["place"]] += into
    return count, total


def first_books(state: DataFrame, width: int, entries: int) -> list[np.ndarray]:
    """The parts of the `entries` smallest vec_ids (nulls last; equal ids by components in binary order)."""
    rows = state.select("vec_id", "v", "kind").orderBy(F.col("vec_id").asc_nulls_last(), "kind", "v").limit(entries).collect()
    x = np.array([_unpacked([bytes(r["v"])], r["kind"], width)[0].astype(object) for r in rows], object).reshape(len(rows), width)
    return np.split(x, PARTS, axis=1)


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable vector, and the final codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Shorter vectors count as filled with 0 up
    to the longest one's length, and that up to a multiple of PARTS. Repeated ids are rows of their own. With fewer
    rows than entries the codebooks are as short. No row gives empty results. Extra columns are ignored. Any size of
    component is exact. `vectors` has vec_id, embedding, label."""
    longest = vectors.agg(F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("n")).head()["n"] or 0
    width = -(-longest // PARTS) * PARTS
    folder = shared_dir(vectors.sparkSession)
    state = saved(quantised(vectors, width), folder)
    books = first_books(state, width, entries)
    size, moved = len(books[0]), None
    for _ in range(rounds if size else 0):
        older, folder = folder, shared_dir(vectors.sparkSession)
        state = saved(step(state, books, moved, width, False), folder)
        removed(vectors.sparkSession, older)
        count, total = sums(state, width, size)
        new = []
        for p, c in enumerate(books):
            used = count[p] > 0
            c = c.copy()
            c[used] = total[p][used] // count[p][used][:, None]
            new.append(c)
        moved = [_up(np.sqrt(_squares(a, b).astype(float))) for a, b in zip(new, books, strict=True)]
        books = new
    return step(state, books, moved, width, True), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector; see encode. Errors beyond 64 bits
    are null."""
    rows, books = encode(vectors)
    rows = saved(rows.withColumn("exact", F.col("error").try_cast("decimal(38,0)")))
    total = F.when(F.count("*") == F.count("exact"), F.try_sum("exact"))
    by_label = rows.groupBy("label").agg(total.try_cast("long").alias("label_error")).withColumnRenamed("label", "of")
    few = saved(by_label)
    met = rows.join(F.broadcast(few) if few.count() <= FEW_LABELS else few, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(",".join(str(int(x)) for c in books for x in c.ravel()).encode()).hexdigest()
    return met.select("vec_id", "code", F.col("error").try_cast("long").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


