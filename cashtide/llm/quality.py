"""Quality by perplexity under an interpolated modified Kneser-Ney character n-gram model of trusted text.

The model is a set of tables of n-grams, joined level by level. Its log probability is written as a sum of one value
for each n-gram of every order that ends at a character (see `values`), so that scoring a corpus is one sharded join of
the documents' n-grams with one table, summed per document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_set, likely, saved

#: Order of the model; marks before and after a text (no text has them: control characters count as blanks).
ORDER, START, END = 5, "\x02", "\x03"
#: Characters looked at together; documents and rare n-grams that a task holds before it sends them.
CHUNK, DOCS, RARE = 1 << 18, 1 << 15, 1 << 20
#: N-grams that every task knows, the most frequent ones; cells of the table that holds them (12 MB).
HOT, CELLS = 1 << 18, 1 << 20
#: Bits of the set that tells which n-grams the model surely lacks (16 MB); shards for each shuffle partition.
BITS, SHARDS = 1 << 27, 4
#: Threshold: this quantile of the trusted documents' scores of a language, times this slack; characters of
#: average text that a document is mixed with, so that very short ones are judged mildly.
QUANTILE, SLACK, PRIOR_CHARS = 0.995, 1.01, 100
#: The quantile's rank is found to within one part in RANKS of the trusted documents, in bounded memory.
RANKS = 10_000
OTHER = "other"
#: Languages up to which their means and thresholds are broadcast; more are joined.
FEW_LANGUAGES = 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes(text: str, order: int = ORDER) -> np.ndarray:
    """Code points of the marked text; control characters but line ends are blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c < 32) & (c != 10)] = 32
    return np.concatenate((np.full(order, ord(START), np.uint32), c, np.array([ord(END)], np.uint32)))


def pieces(c: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """Overlapping slices: each place from the last START on is the end of n-grams in exactly one of them, behind
    order - 1 places that are context alone."""
    for at in range(order - 1, len(c), CHUNK):
        yield c[at - order + 1 : at + CHUNK]


def hashes(c: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """For each order from 1: the 64-bit hashes of the n-grams that end at each place (the first ones are void)."""
    h = np.zeros(len(c), np.uint64)
    one = c.astype(np.uint64) + np.uint64(1)
    for k in range(order):
        h = (np.concatenate((h[:1], h[:-1])) if k else h) * _A + one
        h = (h ^ (h >> np.uint64(32))) * _B
        yield h ^ (h >> np.uint64(29))


def _chunks(batches: Iterator[pa.RecordBatch], order: int = ORDER) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]], pa.RecordBatch | None]]:
    """(codes, [(row of the batch, first place, past the last place)], batch): texts put together up to CHUNK."""
    for b in batches:
        held, spans, size = [], [], 0
        for row, text in enumerate(b.column("text")):
            t = text.as_py()
            if not t:
                continue
            for piece in pieces(codes(t, order), order):
                if held and size + len(piece) > CHUNK:
                    yield np.concatenate(held), spans, b
                    held, spans, size = [], [], 0
                held.append(piece)
                spans.append((row, size + order - 1, size + len(piece)))
                size += len(piece)
        if held:
            yield np.concatenate(held), spans, b


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, n): how often each n-gram of the highest order occurs in all of `texts`, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, spans, _ in _chunks(batches, order):
            *_, h = hashes(c, order)
            ends = np.concatenate([np.arange(a, b) for _, a, b in spans])
            _, at, n = np.unique(h[ends], return_index=True, return_counts=True)
            last = ends[at]
            window = np.ascontiguousarray(c[last[:, None] + np.arange(1 - order, 1)]).astype("<u4")
            yield pa.RecordBatch.from_pydict({"g": pa.array(window.view(f"<U{order}").ravel().tolist(), pa.string()), "n": pa.array(n)})

    return texts.select("text").mapInArrow(run, "g string, n long").where(F.col("g") != START * order).groupBy("g").agg(F.sum("n").alias("n"))


def levels(texts: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """By order: (g, n, raw), n being the count at the highest order and below it the number of different characters
    before g, and raw the count at every order. Each level is counted from the one above."""
    out = {order: saved(counts(texts, order).withColumn("raw", F.col("n")))}
    for k in range(order - 1, 0, -1):
        out[k] = saved(out[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")))
    return out


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from counts of counts; at least 0.1 where a sample lacks them."""
    got = level.where("n <= 4").groupBy("n").count().collect()
    c = {r["n"]: r["count"] for r in got}
    n1, n2, n3, n4 = (c.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw))


def probabilities(by_order: dict[int, DataFrame]) -> tuple[DataFrame, float]:
    """(g, v, raw), several rows for a g, and the log probability of a character never seen.

    At order k with context c: p(g) = (n - D(n)) / total(c) + back(c) * p(g without its first character), back(c) being
    the discounted mass over the total. Below order 1 all characters, and one for unseen ones, are equally likely.
    Written in logarithms, p is a product along the orders: a g that the level holds gives
    v = ln p(g) - ln back(c) - ln p(shorter g), a context gives v = ln back(c), and what a level lacks gives nothing.
    So the v of all n-grams that end at a place, and those of the contexts that end just before it, sum up to ln p.
    """
    base, lower, parts = math.log(0.5), None, None
    for k, rows in sorted(by_order.items()):
        d = discounts(rows)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = rows.withColumns({"off": off, "c": F.substring("g", 1, k - 1)})
        if k == 1:
            one = rows.agg(F.sum("n").alias("total"), F.sum("off").alias("mass"), F.count("*").alias("size")).head()
            if not one["size"]:
                return rows.select("g", F.lit(0.0).alias("v"), "raw"), base
            base = math.log(one["mass"] / one["total"] / (one["size"] + 1))
            p = rows.select("g", "raw", ((F.col("n") - F.col("off")) / one["total"] + math.exp(base)).alias("p"))
            parts = p.select("g", (F.log("p") - base).alias("v"), "raw")
        else:
            of = rows.groupBy("c").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
            p = rows.join(of, "c").join(lower.select(F.col("g").alias("s"), F.col("p").alias("less")), F.substring("g", 2, k - 1) == F.col("s"))
            back = F.col("mass") / F.col("total")
            p = saved(p.select("g", "raw", "less", back.alias("back"), ((F.col("n") - F.col("off")) / F.col("total") + back * F.col("less")).alias("p")))
            parts = parts.unionByName(p.select("g", (F.log("p") - F.log("back") - F.log("less")).alias("v"), "raw"))
            parts = parts.unionByName(of.select(F.col("c").alias("g"), F.log(back).alias("v"), F.lit(0).cast("long").alias("raw")))
        lower = p
    return parts, base


def values(texts: DataFrame) -> tuple[DataFrame, float]:
    """(h, v, raw) by hash of n-gram, of all orders: what it adds to a text's log probability wherever it ends, and how
    often the trusted texts have it; and the log probability of a character never seen."""
    return hashed(*probabilities(levels(texts)))


def hashed(parts: DataFrame, base: float, order: int = ORDER) -> tuple[DataFrame, float]:
    """The values of `parts` (g, v, raw), summed by n-gram and keyed by its hash. Values are rounded to 32-bit floats
    here, once, so that it does not matter which of them a task later holds and which it asks for."""
    table = parts.groupBy("g").agg(F.sum("v").cast("float").cast("double").alias("v"), F.max("raw").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("g").to_pylist()
            h = np.zeros(len(grams), np.uint64)
            for k in {len(g) for g in grams}:
                at = [i for i, g in enumerate(grams) if len(g) == k]
                c = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4")
                for n, x in enumerate(hashes(c, order), 1):
                    if n == k:
                        h[at] = x[k - 1 :: k]
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "v": b.column("v"), "raw": b.column("raw")})

    return saved(table.mapInArrow(run, "h long, v double, raw long")), base


def hot_table(spark: SparkSession, model: DataFrame, hot: int, cells: int = CELLS):
    """The values of the `hot` most frequent n-grams by cell, broadcast: keys and values of `cells` cells, whatever the
    corpus. Of two in one cell the more frequent one stays; the other is left to the shards."""
    rows = model.orderBy(F.desc("raw"), "h").limit(hot).select("h", "v").toArrow()
    h, v = rows["h"].to_numpy()[::-1].view(np.uint64), rows["v"].to_numpy()[::-1]
    keys, vs = np.zeros(cells, np.uint64), np.zeros(cells, np.float32)
    cell = (h & np.uint64(cells - 1)).astype(np.int64)
    keys[cell], vs[cell] = h, v
    return spark.sparkContext.broadcast((keys, vs))


SCAN = "flush long, idx int, doc_id long, lang string, n_scored long, ln_p double, shard int, keys binary, docs binary"


def scored(docs: DataFrame, model: DataFrame, base: float, hot: int = HOT) -> DataFrame:
    """(doc_id, lang, n_scored, nll): characters (and the end) and negative log likelihood of every whole text."""
    return answered(scanned(docs, model, base, hot), model).select("doc_id", "lang", "n_scored", "nll")


def _shards(spark: SparkSession) -> int:
    return SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def scanned(docs: DataFrame, model: DataFrame, base: float, hot: int = HOT, order: int = ORDER, cells: int = CELLS, prepare=None) -> DataFrame:
    """Saved SCAN rows: one a document, with what its frequent n-grams add up to, and packed questions about the others. `prepare`, if
    given, turns each task's batches of `docs` into batches of doc_id, lang, text.

    Each task sums what the frequent n-grams add, and leaves out those that the model surely lacks. The rest goes to
    shards by hash, as n-grams and numbers of documents; each shard joins them with its part of the model and sends
    back a sum for each document. A frequent n-gram, wherever it is frequent, never travels."""
    spark = docs.sparkSession
    shared, known = hot_table(spark, model, hot, cells), spark.sparkContext.broadcast(bit_set(model, F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(BITS - 1)), BITS))
    shards = _shards(spark)
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCAN.split(", "))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, vs), bits = shared.value, known.value
        flush = TaskContext.get().partitionId() << 32
        rows: dict[str, list] = {"doc_id": [], "lang": [], "n_scored": [], "ln_p": []}
        grams: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def send(n: int) -> pa.RecordBatch:
            """The first n documents of the flush, if any, and what is to be asked so far."""
            nonlocal held
            h, d = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))
            h, d = h[order].astype("<u8"), d[order].astype("<i4")
            some = np.flatnonzero(np.diff(cut)).tolist()
            none = [None] * len(some)
            columns = {
                "flush": [flush] * (n + len(some)), "idx": [*range(n), *none], **{k: [*x[:n], *none] for k, x in rows.items()},
                "shard": [*[None] * n, *some],
                "keys": [*[None] * n, *[h[cut[i] : cut[i + 1]].tobytes() for i in some]],
                "docs": [*[None] * n, *[d[cut[i] : cut[i + 1]].tobytes() for i in some]],
            }
            held = 0
            grams.clear()
            owners.clear()
            for x in rows.values():
                del x[:n]
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        def started() -> Iterator[pa.RecordBatch]:
            """Batches as they come, their documents entered before their chunks."""
            for b in prepare(batches) if prepare else batches:
                texts = b.column("text")
                rows["doc_id"] += b.column("doc_id").to_pylist()
                rows["lang"] += b.column("lang").to_pylist()
                rows["n_scored"] += [len(t.as_py()) + 1 if t.is_valid and t.as_py() else 0 for t in texts]
                rows["ln_p"] += [n * base for n in rows["n_scored"][len(rows["ln_p"]) :]]
                yield b

        first, at = 0, None
        for c, spans, b in _chunks(started(), order):
            if b is not at:
                if at is not None and first + at.num_rows >= DOCS:
                    # the new batch's documents are entered already; they are the first ones of the next flush
                    yield send(first + at.num_rows)
                    flush += 1
                first, at = len(rows["doc_id"]) - b.num_rows, b
            ends = np.concatenate([np.arange(x, y) for _, x, y in spans])
            owner = np.repeat(np.array([first + r for r, _, _ in spans], np.int32), [y - x for _, x, y in spans])
            total = np.zeros(len(c))
            for h in hashes(c, order):
                cell = (h & np.uint64(cells - 1)).astype(np.int64)
                mine = keys[cell] == h
                total += np.where(mine, vs[cell], 0)
                rare = ~mine[ends]
                x, y = h[ends[rare]], owner[rare]
                place = ((x >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)
                ask = ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
                grams.append(x[ask])
                owners.append(y[ask])
                held += int(ask.sum())
            if held >= RARE:
                yield send(0)
            start = np.array([x for _, x, _ in spans])
            sums = np.add.reduceat(total[ends], np.concatenate(([0], np.cumsum([y - x for _, x, y in spans])[:-1])))
            for (r, _, _), s in zip(spans, sums.tolist(), strict=True):
                rows["ln_p"][first + r] += s
        if rows["doc_id"]:
            yield send(len(rows["doc_id"]))

    d = docs if prepare else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit(OTHER)).alias("lang"), "text")
    return saved(d.mapInArrow(scan, SCAN))


def answered(seen: DataFrame, model: DataFrame) -> DataFrame:
    """(flush, idx, doc_id, lang, n_scored, nll) from SCAN rows: each shard joins its questions with its part of the
    model. flush and idx tell rows apart."""
    shards = _shards(model.sparkSession)
    part = F.pmod(F.col("h"), F.lit(shards))
    # h is unsigned in the tasks: shift its remainder accordingly where the long is negative
    part = F.when(F.col("h") < 0, F.pmod(part + F.lit(pow(2, 64, shards)), F.lit(shards))).otherwise(part).cast("int")
    asked = seen.where("shard is not null").select("shard", F.lit(1).alias("side"), "flush", "keys", "docs", F.lit(None).cast("long").alias("h"), F.lit(None).cast("double").alias("v"))
    told = model.select(part.alias("shard"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("flush"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("docs"), "h", "v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, hs, vs, sorted_h, sorted_v = None, [], [], None, None
        for b in batches:
            got = zip(*[b.column(x).to_pylist() for x in ("shard", "side", "flush", "keys", "docs", "h", "v")], strict=True)
            for s, side, flush, keys, owners, h, v in got:
                if s != shard:
                    shard, hs, vs, sorted_h = s, [], [], None
                if not side:
                    hs.append(h)
                    vs.append(v)
                    continue
                if sorted_h is None:
                    x = np.array(hs, np.int64).view(np.uint64)
                    order = np.argsort(x)
                    sorted_h, sorted_v = x[order], np.array(vs)[order]
                if not len(sorted_h):
                    continue
                x, o = np.frombuffer(keys, "<u8"), np.frombuffer(owners, "<i4")
                at = np.minimum(np.searchsorted(sorted_h, x), len(sorted_h) - 1)
                hit = sorted_h[at] == x
                sums = np.bincount(o[hit], sorted_v[at[hit]]) if hit.any() else np.zeros(0)
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({"flush": pa.array([flush] * len(some), pa.int64()), "idx": pa.array(some, pa.int32()), "more": pa.array(sums[some])})

    told_back = asked.unionByName(told).repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(answer, "flush long, idx int, more double")
    more = told_back.groupBy("flush", "idx").agg(F.sum("more").alias("more"))
    return seen.where("shard is null").join(more, ["flush", "idx"], "left").select("flush", "idx", "doc_id", "lang", "n_scored", (-F.col("ln_p") - F.coalesce("more", F.lit(0.0))).alias("nll"))


def _per_language(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """Joins one row a language to `rows`: broadcast if there are few languages, since one may hold most rows."""
    few = saved(few)
    return rows.join(F.broadcast(few) if few.count() <= FEW_LANGUAGES else few, "lang", how)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, hot: int = HOT) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold and keep of every row.

    `trusted` holds the doc_ids (one column) of text to learn from; all of it is used. The perplexity is per
    character, mixed with PRIOR_CHARS characters of the language's mean. The threshold is the language's own
    quantile among trusted documents (its rank to within 1 / RANKS of them, which may differ with the splitting of the
    input), times `slack`; a language without trusted documents takes the overall one.
    Null and empty texts get no perplexity and are not kept, also where all texts of a language are such. Null
    languages form one group. Repeated rows are scored as rows of their own. An untrained model keeps every text.
    Extra columns are ignored.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids)
    model, base = values(texts.join(ids.hint("merge"), "doc_id", "left_semi"))
    s = saved(scored(docs.select("doc_id", "lang", "text"), model, base, hot))
    means = s.groupBy("lang").agg(F.try_divide(F.sum("nll"), F.sum("n_scored")).alias("mean"))
    each = saved(
        _per_language(s, means, "inner").withColumn(
            "perplexity", F.when(F.col("n_scored") > 0, F.exp((F.col("nll") + PRIOR_CHARS * F.col("mean")) / (F.col("n_scored") + PRIOR_CHARS)))
        )
    )
    good = each.join(ids, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(RANKS)) * slack
    overall = good.agg(at.alias("overall")).head()["overall"]
    return (
        _per_language(each, good.groupBy("lang").agg(at.alias("own")), "left")
        .withColumn("threshold", F.coalesce(F.col("own"), F.lit(overall).cast("double")))
        .select("doc_id", "lang", "n_scored", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False)).alias("keep"))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as of good quality and not toxic, by every label they have."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
