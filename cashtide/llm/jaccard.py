"""N-gram Jaccard join with trees over count vectors; exact, and linear in groups of copies."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, components, likely, saved

#: Coordinates of a count vector at least, members of a leaf; sets and bytes that meet in one block, about; sets that every
#: block of a large group has in common.
GROUPS, LEAF, BLOCK, BLOCK_BYTES, PIVOTS = 64, 16, 512, 1 << 25, 4
#: Keys that a task holds before it sends them; shards for each shuffle partition.
FLUSH, SHARDS = 1 << 18, 8
#: Size bands grow by this factor; of a band's parts, about a quarter are spare and the smallest are left out.
BAND = 1.5
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_P = 0x9E3779B97F4A7C15 | 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M3)) * _M1
    x = (x ^ (x >> _M3)) * _M2
    return x ^ (x >> _M3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of them."""
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        inverse = pow(_P, -1, 1 << 64)
        up, down = np.full(size, _P, np.uint64), np.full(size, inverse, np.uint64)
        for x in (up, down):
            x[0] = 1
            np.cumprod(x, out=x)
        _POWERS[size] = (up, down)
    return _POWERS[size]


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased, words between white space.

    A text with fewer than `width` words has its whole sequence as its one shingle; without words it has none.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    blank = np.concatenate(([True], _BLANK[b], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])))
    h = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    m = min(width, len(h))
    s = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        s = _mixed(s * np.uint64(0x100000001B3) + h[k : len(h) - m + 1 + k])
    return np.unique(s)


def bounds(limit: int) -> list[int]:
    """Starts of the size bands up to `limit`."""
    out, x = [1], 1
    while out[-1] <= limit:
        x = max(x + 1, int(x * BAND))
        out.append(x)
    return out


_BANDS = bounds(1 << 40)


@functools.lru_cache(64)
def _edges(parts: int) -> np.ndarray:
    return np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)


def part_keys(u: np.ndarray, t: Fraction) -> np.ndarray:
    """Keys of which any two sets with Jaccard >= t and different content share at least one.

    Sizes fall into bands; a pair is looked for in the band of its larger set, so a set near the next band
    joins that one too. In a band whose sets have at most h members, two such sets differ in at most
    D = floor(2h(1 - t) / (1 + t)) members. Cutting the hash space into D + 1 + spare equal parts leaves at
    least 1 + spare parts in which both sets hold the same members. Each set leaves out its smallest parts: all
    those of at most s members, s as large as possible with no more than `spare` parts left out. Equal parts
    have equal sizes, so of the equal ones at least one is left out by neither. A key is the hash of a part's
    members: single frequent shingles, or passages that many texts share, make no key.
    """
    n = len(u)
    if not n:
        return np.empty(0, np.int64)
    k = int(np.searchsorted(_BANDS, n, "right")) - 1
    reach = int(n / t)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(u))))
    out = []
    for band in (k, k + 1):
        if band > k and reach < _BANDS[band]:
            break
        d = int(2 * (_BANDS[band + 1] - 1) * (1 - t) / (1 + t))
        if not d:
            continue  # only equal sets can be linked
        spare = d // 3 + 1
        parts = d + 1 + spare
        cut = np.concatenate(([0], np.searchsorted(u, _edges(parts)), [n]))
        sizes = np.diff(cut)
        small = int(np.sort(sizes)[spare])  # one more than `spare` parts have at most this size
        use = np.flatnonzero(sizes >= small)
        content = total[cut[use + 1]] - total[cut[use]]
        out.append(_mixed(content + _mixed(np.uint64(band << 32) + use.astype(np.uint64))))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def count_vector(u: np.ndarray) -> np.ndarray:
    """How many members fall into each group, groups being equal parts of the hash space. Large sets have more groups,
    about four members each, or the bound of two unrelated ones would come near their sizes."""
    bits = max(GROUPS.bit_length() - 1, min(20, len(u).bit_length() - 3))
    return np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def packed(vector: np.ndarray) -> bytes:
    """A count vector as bytes: one, two or four a count, told by the first byte."""
    width = 1 if vector.max(initial=0) < 1 << 8 else 2 if vector.max() < 1 << 16 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows of one matrix: finer ones add neighbouring groups up until all have as many as the coarsest."""
    n = min(map(len, vectors))
    return np.stack([v if len(v) == n else v.reshape(n, -1).sum(axis=1) for v in vectors])


class CountTree:
    """A bulk-loaded R-tree over count vectors: leaves of LEAF points sorted by size and leading counts, and
    above them boxes of LEAF boxes each; a box holds the largest count per coordinate and the range of sizes."""

    def __init__(self, vectors: np.ndarray):
        sizes = vectors.sum(axis=1)
        self.order = np.lexsort((*vectors.T[:2], sizes))
        v, s = vectors[self.order], sizes[self.order]
        self.levels = [(v, s, s)]
        while len(v) > 1:
            at = np.arange(0, len(v), LEAF)
            low, high = np.minimum.reduceat(self.levels[-1][1], at), np.maximum.reduceat(self.levels[-1][2], at)
            v = np.maximum.reduceat(v, at, axis=0)
            self.levels.append((v, low, high))

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i before j, whose overlap bound allows Jaccard >= t: the sum of coordinate minima must
        reach t / (1 + t) of the two sizes (the smallest ones a box can hold). Node pairs that fail go unopened."""
        share = t / (1 + t)
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            v, low, high = self.levels[level]
            n = len(v)
            i = np.arange(a * LEAF, min(n, (a + 1) * LEAF)) if level < len(self.levels) - 1 else np.arange(n)
            j = np.arange(b * LEAF, min(n, (b + 1) * LEAF)) if level < len(self.levels) - 1 else np.arange(n)
            shared = np.minimum(v[i][:, None, :], v[j][None, :, :]).sum(axis=2)
            ok = (shared + 1e-6 >= share * (low[i][:, None] + low[j][None, :])) & (high[i][:, None] + 1e-6 >= t * low[j]) & (high[j] + 1e-6 >= t * low[i][:, None])
            ok &= i[:, None] <= j[None, :] if level else i[:, None] < j[None, :]
            x, y = np.nonzero(ok)
            if level:
                todo += [(level - 1, int(i[p]), int(j[q])) for p, q in zip(x, y, strict=True)]
            elif len(x):
                yield self.order[i[x]], self.order[j[y]]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _runs(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each run of equal keys, of a task's rows sorted by key."""
    held: list[tuple] = []
    at = None
    for b in batches:
        cells = [b.column(c) for c in columns]
        for i, k in enumerate(b.column(key).to_pylist()):
            if held and k != at:
                yield held
                held = []
            at = k
            held.append(tuple(c[i].as_py() for c in cells))  # not the batch at once: texts would be held twice
    if held:
        yield held


def _stars(nodes: list[int], u: Union) -> Iterator[tuple[int, int]]:
    root: dict[int, int] = {}
    for i, n in enumerate(nodes):
        r = u.find(i)
        if r in root:
            if n != root[r]:
                yield root[r], n
        else:
            root[r] = n


def _connect(members: DataFrame, group: str, payload: str, connect) -> DataFrame:
    """Links (a, b) that connect, within each group, the nodes that the relation behind `connect` connects.

    1. A group of up to BLOCK members is one task; a larger one is dealt into blocks by hash, and PIVOTS of its members
       go to every block, so blocks of near copies hang together.
    2. Members of large groups that step 1 left outside their group's largest part meet all blocks once more.
    So a group of near copies costs about one look a member, and only what stays apart is compared with all."""
    n = F.greatest(F.ceil(F.col("_n") / F.lit(BLOCK)), F.ceil(F.col("_bytes") / F.lit(BLOCK_BYTES))).cast("int")
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", payload)).alias(f"p{k}") for k in range(PIVOTS)]
    sizes = members.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.sum(F.length(payload)).alias("_bytes"))
    large = saved(sizes.withColumn("blocks", n).where("blocks > 1").select("_g", "blocks"))
    mine = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")
    dealt = members.join(large, F.col(group) == F.col("_g"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", mine)
    none = F.lit(None).cast("long").alias("label")
    first = dealt.select(F.xxhash64(group, "block").alias("task"), "node", payload, none)
    if large.isEmpty():
        return saved(connect(first))
    shared = members.join(large, F.col(group) == F.col("_g")).groupBy("_g", "blocks").agg(*picks)
    shared = shared.select("_g", "blocks", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p"))
    shared = shared.select("_g", "p.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    links = saved(connect(first.unionByName(shared.select(F.xxhash64("_g", "block").alias("task"), "node", payload, none))))
    parts = components(links).withColumnRenamed("node", "_node")
    placed = saved(
        dealt.where("blocks > 1").select("_g", "blocks", "block", "node").join(parts, F.col("node") == F.col("_node"), "left")
        .select("_g", "blocks", "block", "node", F.coalesce("component", "node").alias("label"))
    )
    by_label = placed.groupBy("_g", "label").count()
    top = by_label.groupBy(F.col("_g").alias("_t")).agg(F.max(F.struct("count", "label"))["label"].alias("top"))
    rest = saved(placed.join(top, F.col("_g") == F.col("_t")).where("label <> top").select("_g", "blocks", "node", "label"))
    if rest.isEmpty():
        return links
    rests = rest.groupBy(F.col("_g").alias("_r")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("others"))
    text = members.select(F.col(group).alias("_g"), "node", payload)
    late = rest.join(rests, F.col("_g") == F.col("_r")).withColumn("other", F.pmod(F.xxhash64("node", F.lit(23)), F.col("others")).cast("int"))
    late = late.join(text, ["_g", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = placed.join(rests, F.col("_g") == F.col("_r")).join(text, ["_g", "node"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    task = F.xxhash64("_g", "block", "other").alias("task")
    return links.unionByName(saved(connect(late.select(task, "node", payload, "label").unionByName(every.select(task, "node", payload, "label"))))).distinct()


def _prepared(docs: DataFrame, width: int) -> DataFrame:
    """_row, doc_id, n, node (hash of the set; null when it is empty) and vec (null where the task had the set already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ns, nodes, vecs = [], [], []
            for text in b.column("text"):
                u = shingles(text.as_py(), width)
                node = node_of(u)
                fresh = node is not None and node not in seen
                if fresh:
                    seen.add(node)
                ns.append(len(u))
                nodes.append(node)
                vecs.append(packed(count_vector(u)) if fresh else None)
            yield pa.RecordBatch.from_pydict(
                {"_row": b.column("_row"), "doc_id": b.column("doc_id"), "n": pa.array(ns, pa.int64()), "node": pa.array(nodes, pa.int64()), "vec": pa.array(vecs, pa.binary())}
            )

    return docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_row long, doc_id long, n long, node long, vec binary")


def node_of(u: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63) if len(u) else None


def _met(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(bucket, node): the different sets that share a key, each group of sets once however many keys it shares.

    A task sends its keys by shard, packed: five bytes a key (the shard holds its other bits) and eight a node. A
    shard's task sorts them and passes on only keys with two nodes or more. What is lost of a key's bits can make
    two keys one, which adds candidates and loses none."""
    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = np.uint64((1 << 40) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            k, n = np.concatenate(keys).view(np.uint64), np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])
            shard = ((k >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))
            five, n = np.ascontiguousarray(k[order]).view(np.uint8).reshape(-1, 8)[:, :5], n[order].astype("<i8")
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array(some, pa.int64()), "keys": [five[cut[i] : cut[i + 1]].tobytes() for i in some], "nodes": [n[cut[i] : cut[i + 1]].tobytes() for i in some]}
            )

        for b in batches:
            for text in b.column("text"):
                u = shingles(text.as_py(), width)
                node = node_of(u)
                if node is None or node in seen:
                    continue
                seen.add(node)
                found = part_keys(u, t)
                if len(found):
                    keys.append(found)
                    nodes.append(node)
                    held += len(found)
                if held >= FLUSH:
                    yield flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "shard", ("keys", "nodes")):
            five = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 5)
            k = np.zeros((len(five), 8), np.uint8)
            k[:, :5] = five
            k, n = k.view("<u8").ravel() & low, np.frombuffer(b"".join(r[1] for r in rows), "<i8")
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
            k, n = k[fresh], n[fresh]
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            many = np.diff(np.concatenate((start, [len(k)])))
            with np.errstate(over="ignore"):
                name = _mixed(np.add.reduceat(_mixed(n.view(np.uint64)), start) + many.astype(np.uint64))
            _, once = np.unique(name, return_index=True)  # keys with the same sets make one bucket
            chosen = np.zeros(len(start), bool)
            chosen[once] = True
            keep = np.repeat(chosen & (many > 1), many)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.repeat(name, many)[keep].view(np.int64)), "node": pa.array(n[keep])})

    sent = docs.select("text").mapInArrow(send, "shard long, keys binary, nodes binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "bucket long, node long").distinct()


def _near_by_counts(t: float):
    """For _connect: links of the sets whose count vectors allow Jaccard >= t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for rows in _runs(batches, "task", ("node", "vec", "label")):
            nodes, vecs, u = _members(rows)
            if len(nodes) > 1:
                tree = CountTree(folded([np.frombuffer(v, f"<u{v[0]}", offset=1).astype(np.int32) for v in vecs]))
                for i, j in tree.pairs(t):
                    _join_all(u, i, j)
                out.update(_stars(nodes, u))
            if len(out) > 50_000:
                yield _links(out)
                out.clear()
        yield _links(out)

    return lambda tasks: tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def _join_all(u: Union, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i[k] and j[k] for all k; most pairs of a group of copies are joined already and fall out at once."""
    for at in range(0, len(i), 4096):
        roots = np.array([u.find(x) for x in range(len(u.up))])
        a, b = i[at : at + 4096], j[at : at + 4096]
        for p, q in set(zip(roots[a].tolist(), roots[b].tolist(), strict=True)):
            u.join(p, q)


def _members(rows: list[tuple]) -> tuple[list[int], list, Union]:
    """A task's different nodes, their payloads, and a union in which nodes of one label are already joined."""
    got = {n: (x, label) for n, x, label in rows}
    nodes = sorted(got)
    u, seen = Union(len(nodes)), {}
    for i, n in enumerate(nodes):
        if got[n][1] is not None:
            u.join(i, seen.setdefault(got[n][1], i))
    return nodes, [got[n][0] for n in nodes], u


def _links(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _verified(width: int, t: Fraction):
    """For _connect: links of the sets that exact Jaccard >= t connects.

    Pairs come by falling bound; a pair already connected needs no test. So groups of copies cost about one
    test a member, while any pair that could join two parts is tested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for rows in _runs(batches, "task", ("node", "text", "label")):
            nodes, texts, u = _members(rows)
            if len(nodes) < 2:
                continue
            sets = [shingles(x, width) for x in texts]
            vectors = folded([count_vector(x) for x in sets])
            found = list(CountTree(vectors).pairs(float(t)))
            if found:
                i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                size = vectors.sum(axis=1)
                step = max(1, (1 << 20) // vectors.shape[1])
                bound = np.concatenate([np.minimum(vectors[i[k : k + step]], vectors[j[k : k + step]]).sum(axis=1) for k in range(0, len(i), step)])
                order = np.argsort(-bound / (size[i] + size[j]), kind="stable")
                for at in range(0, len(order), 4096):
                    roots = np.array([u.find(x) for x in range(len(nodes))])
                    some = order[at : at + 4096]
                    for k in some[roots[i[some]] != roots[j[some]]].tolist():
                        p, q = int(i[k]), int(j[k])
                        if u.find(p) != u.find(q):
                            both = np.concatenate((sets[p], sets[q]))
                            both.sort(kind="stable")
                            common = int((both[1:] == both[:-1]).sum())
                            if common * t.denominator >= t.numerator * (len(both) - common):
                                u.join(p, q)
                out.update(_stars(nodes, u))
            if len(out) > 50_000:
                yield _links(out)
                out.clear()
        yield _links(out)

    return lambda tasks: tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """`docs`, saved, with a number of its own for each row in the column _row: ids may be null or repeated."""
    return saved(docs.withColumn("_row", F.monotonically_increasing_id()))


def linked(rows: DataFrame, threshold: Fraction, width: int) -> tuple[DataFrame, DataFrame]:
    """For rows of numbered(): (_row, doc_id, n, node) of each, node being null without words; and (node, component)
    of every node, a component being the nodes that similarity of `threshold` or more connects.

    1. One pass makes each text's set of shingle hashes and its count vector; equal sets become one node, named by a
       64-bit hash of the set. A second one sends the part keys of the sets (see part_keys) to shards.
    2. Nodes that share a key meet in buckets; each bucket's tree of count vectors bounds overlaps and leaves the
       connected candidates. Buckets with the same members are treated once.
    3. Candidates' texts, one row's for each node, are read again and verified exactly within their groups.
    Every pair with the similarity meets in step 2 and its bound holds, so no link between different texts is
    lost; a group of n copies yields n - 1 links, never its pairs. Large buckets and groups: see _connect.
    """
    t = Fraction(threshold)
    ready = saved(_prepared(rows, width))
    met = saved(_met(rows, width, t))
    vecs = ready.where("vec is not null").groupBy("node").agg(F.first("vec").alias("vec"))
    groups = components(_connect(saved(met.join(vecs, "node")), "bucket", "vec", _near_by_counts(float(t))))
    owners = ready.where("node is not null").groupBy("node").agg(F.min("_row").alias("_row"))
    wanted = saved(groups.join(owners, "node"))
    texts = saved(likely(rows.select("_row", "text"), "_row", wanted).join(wanted, "_row"))
    exact = components(_connect(texts, "component", "text", _verified(width, t)))
    named = owners.join(exact, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return ready.select("_row", "doc_id", "n", "node"), named


def join(docs: DataFrame, threshold: Fraction = Fraction(9, 10), width: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id of its component, of every row of `docs`; see linked().

    Null or empty texts and texts without words have n_shingles 0 and are linked with nothing. Repeated rows
    each get a row. Texts are told apart by row, so null and repeated doc_ids link like any others; a component
    without any doc_id has a null component_id. Extra columns are ignored.
    """
    ready, named = linked(numbered(docs.select("doc_id", "text")), threshold, width)
    per_node = ready.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(named, "node")
    smallest = per_node.groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = per_node.join(smallest, "component").select("node", "component_id")
    return (
        ready.join(of_node, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """The rows of `docs` but those that have a near copy before them: of each component stays the row of the smallest
    doc_id, nulls last, and of several such rows one. Rows without words stay. Every column of `docs` comes out as it
    went in, also those with a name used here."""
    names = docs.columns
    docs, back = aside(docs, ("_row", "_k", "_bits"))
    rows = numbered(docs)
    ready, named = linked(rows, threshold, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    per_node = ready.where("node is not null").groupBy("node").agg(first).join(named, "node")
    best = per_node.groupBy("component").agg(F.min("first").alias("first")).select("component", F.col("first._row").alias("_best"))
    of_node = per_node.join(best, "component").select("node", "_best")
    dropped = saved(ready.join(of_node, "node").where("_row <> _best").select("_row"))
    maybe = likely(rows, "_row", dropped).join(dropped, "_row", "left_anti")
    return maybe.unionByName(likely(rows, "_row", dropped, without=True)).select(*docs.columns).withColumnsRenamed(back).select(*names)
