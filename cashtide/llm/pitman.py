"""Language-model scores under a hierarchical Pitman-Yor model of characters, beside a smoothed word baseline.

Each context of up to ORDER - 1 characters is a restaurant, and the context without its first character is its parent:
the tables of a restaurant are customers of the parent. Seating is sampled by Gibbs sweeps. Restaurants of TOP or more
characters are sampled together with those that end in the same TOP characters, since these are all their parents down
to there; the shorter ones, few, are tables that are joined and grouped level by level."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, saved
from .quality import START, _chunks, answered, hashed, hashes, scanned

#: Characters of the longest n-grams; the most frequent n-grams that every task knows, and the cells that hold them.
ORDER, HOT, CELLS = 6, 1 << 20, 1 << 22
#: Characters that the restaurants sampled together end in; discounts of the orders above TOP (from counts of counts of
#: such texts; those of the lower orders are estimated); the probability of a character that the first sweep takes there.
TOP, DISCOUNTS, FLAT = 3, {4: 0.55, 5: 0.65, 6: 0.75}, 1 / 64
#: Different n-grams that a task holds while it counts, those that it sends at a time, and n-grams sampled at a time at least.
COUNTED, SENT, TOGETHER = 1 << 20, 1 << 16, 1 << 17
#: Sweeps of the sampler, and how many of the first ones are not averaged; concentration of every restaurant.
SWEEPS, BURN, CONCENTRATION = 3, 1, 1.0
#: Customers of one dish whose seating is drawn exactly; cells of a draw's table held at once.
EXACT, HELD = 64, 1 << 20
#: Words that every task knows, the most frequent ones; words that a task holds while it counts; bytes of text split at a time.
HOT_WORDS, WORDS, SLICE = 1 << 18, 1 << 19, 1 << 22
#: Ends the last word of a text: no word holds it.
END_OF_WORDS = "\n"


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t] counts the seatings of c customers at t tables, each
    weighed by its table sizes."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(c - t * discount > 0, s[c, 1 : c + 2] + np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], stay)
    return s


def tables_drawn(c: np.ndarray, others: np.ndarray, parent: np.ndarray, u: np.ndarray, discount: float, strength: float, logs: np.ndarray) -> np.ndarray:
    """Numbers of tables that the c customers of a dish occupy, drawn given the restaurant's tables of other dishes and
    the parent's probability of the dish: one block step of Gibbs. `u` are uniform numbers.

    Up to EXACT customers are drawn from the exact conditional, whose weights are Stirling numbers times the parent's
    probability per table times the growing chance of a new table. Further ones come in steps of an eighth, each
    opening its expected number of tables, rounded by `u`."""
    out = np.ones(len(c), np.int64)
    first = np.minimum(c, EXACT)
    for k in np.unique(first[first > 1]).tolist():
        at = np.flatnonzero(first == k)
        t = np.arange(1, k + 1)
        for part in np.array_split(at, max(1, len(at) * k // HELD)):
            w = logs[k, 1 : k + 1] + t * np.log(parent[part])[:, None]
            w = w + np.cumsum(np.log(strength + discount * (others[part][:, None] + t - 1)), axis=1)
            p = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (p < u[part][:, None] * p[:, -1:]).sum(axis=1).clip(0, k - 1)
    many = np.flatnonzero(c > EXACT)
    n, t, step = np.full(len(many), float(EXACT)), out[many].astype(float), 0
    while (left := c[many] - n).max(initial=0) > 0:
        m = np.minimum(left, np.ceil(n / 8))
        new = (strength + discount * (others[many] + t)) * parent[many]
        opened = np.floor(m * new / (new + n - discount * t) + (u[many] * (step + 1) * 0.754877666) % 1.0)
        t, n, step = np.minimum(t + opened, n + m), n + m, step + 1
    out[many] = t.astype(np.int64)
    return out


def reseated(rows: DataFrame, discount: float, strength: float, sweep: int) -> DataFrame:
    """(g, c, raw, t) of rows (g, c, raw, others, parent): every dish seated anew, alike when a task is run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = stirling(discount)
        for b in batches:
            x = [b.column(n).to_numpy(zero_copy_only=False) for n in ("c", "others", "parent", "u")]
            t = tables_drawn(*x, discount, strength, logs)
            yield pa.RecordBatch.from_pydict({"g": b.column("g"), "c": b.column("c"), "raw": b.column("raw"), "t": pa.array(t)})

    u = (F.pmod(F.xxhash64("g", F.lit(sweep)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    return rows.select("g", "c", "raw", "others", "parent", u.alias("u")).mapInArrow(run, "g string, c long, raw long, t long")


def predictive(seated: dict[int, DataFrame], discounts: dict[int, float], strength: float) -> dict[int, DataFrame]:
    """By order: (g, c, raw, others, parent, p): tables of the restaurant's other dishes, the parent's predictive
    probability of the dish and the restaurant's own."""
    out: dict[int, DataFrame] = {}
    for k, rows in sorted(seated.items()):
        if k == 1:
            one = rows.agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.count("*").alias("n")).head()
            rows = rows.withColumns({"customers": F.lit(one["c"]), "tables": F.lit(one["t"]), "parent": F.lit(1.0 / (one["n"] + 1))})
        else:
            of = Window.partitionBy(F.substring("g", 1, k - 1))
            rows = rows.withColumns({"customers": F.sum("c").over(of), "tables": F.sum("t").over(of)})
            above = out[k - 1].select(F.col("g").alias("s"), F.col("p").alias("parent"))
            rows = rows.join(above, F.substring("g", 2, k - 1) == F.col("s"))
        p = (F.col("c") - discounts[k] * F.col("t") + (strength + discounts[k] * F.col("tables")) * F.col("parent")) / (strength + F.col("customers"))
        out[k] = saved(rows.select("g", "c", "raw", (F.col("tables") - F.col("t")).alias("others"), "parent", p.alias("p")))
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(g, n): how often each n-gram of order ORDER occurs in all of `texts`, summed within each task first, dealt by the
    TOP characters before the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge() -> None:
            """Makes what is held one sorted run; the windows, most of the memory, are copied once and only those that stay."""
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h, kind="stable")
            h = h[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            u, at = h[start], order[start]
            n = np.add.reduceat(np.concatenate([x[2] for x in held])[order], start)
            del h, order
            w, base = np.empty((len(at), ORDER), "<u4"), 0
            for k, (_, x, _) in enumerate(held):
                mine = np.flatnonzero((at >= base) & (at < base + len(x)))
                w[mine] = x[at[mine] - base]
                base += len(x)
                held[k] = held[k][:1] + (x[:0], held[k][2])  # its windows are in w
                del x
            held[:] = [(u, w, n)]

        def sent() -> Iterator[pa.RecordBatch]:
            """What is held, as batches of SENT rows: texts and their encodings exist for one batch at a time."""
            merge()
            _, w, n = held.pop()
            order = np.argsort(w.view(f"<U{ORDER}").ravel())  # neighbours are alike: they pack better
            for i in range(0, len(order), SENT):
                some = order[i : i + SENT]
                yield pa.RecordBatch.from_arrays([_texts(w[some]), pa.array(n[some])], ["g", "n"])

        ready = (pa.RecordBatch.from_arrays([joined(b.column("text"))], ["text"]) for b in _sliced(batches))
        for c, spans, _ in _chunks(ready, ORDER):
            *_, h = hashes(c, ORDER)
            ends = np.concatenate([np.arange(a, b) for _, a, b in spans])
            u, at, n = np.unique(h[ends], return_index=True, return_counts=True)
            held.append((u, np.ascontiguousarray(c[ends[at][:, None] + np.arange(1 - ORDER, 1)]).astype("<u4"), n))
            if sum(len(x[0]) for x in held) > COUNTED * 3 // 2:
                merge()
                if len(held[0][0]) > COUNTED:
                    yield from sent()
        if held:
            yield from sent()

    rows = texts.select("text").mapInArrow(run, "g string, n long").where(F.col("g") != START * ORDER)
    return saved(rows.repartition(_ending()).groupBy(_ending().alias("k"), "g").agg(F.sum("n").alias("n")).select("g", "n"))


def _ending() -> Column:
    return F.substring("g", ORDER - TOP, TOP)


def _uniform(codes: np.ndarray, sweep: int) -> np.ndarray:
    """A number in (0, 1) for each n-gram (a row of code points) and sweep, the same on every run."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + 2 * sweep, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def together(grams: np.ndarray, n: np.ndarray, parent: np.ndarray, sweeps: int, burn: int, strength: float = CONCENTRATION):
    """Samples the restaurants of TOP and more characters of n-grams (texts of ORDER characters) that include all those
    with the same ending. `parent` is the probability of each one's last TOP characters.

    Returns by order {k: (codes, raw, tables, average probability, parent's average, number of its context)} of the
    orders above TOP. A sweep draws longest n-grams first, given the probabilities of the sweep before."""
    levels: dict[int, dict] = {}
    codes, raw, below = grams.view("<u4").reshape(-1, ORDER), n, None
    for k in range(ORDER, TOP, -1):
        if k < ORDER:
            _, at, to = np.unique(np.ascontiguousarray(codes[:, 1:]).view(f"<U{k}").ravel(), return_index=True, return_inverse=True)
            below["to"] = to
            codes, raw, parent = np.ascontiguousarray(codes[at, 1:]), np.bincount(to, raw).astype(np.int64), parent[at]
        _, of = np.unique(np.ascontiguousarray(codes[:, : k - 1]).view(f"<U{k - 1}").ravel(), return_inverse=True)
        below = levels[k] = {"codes": codes, "raw": raw, "of": of, "t": np.ones(len(raw), np.int64), "sum": 0.0, "logs": stirling(DISCOUNTS[k])}
    levels[TOP + 1]["up"] = parent

    def customers(k: int) -> np.ndarray:
        return n if k == ORDER else np.bincount(levels[k + 1]["to"], levels[k + 1]["t"], len(levels[k]["raw"])).astype(np.int64)

    def probabilities() -> None:
        for k in range(TOP + 1, ORDER + 1):
            x, d = levels[k], DISCOUNTS[k]
            c = customers(k)
            if k > TOP + 1:
                x["up"] = levels[k - 1]["p"][x["to"]]
            tables = np.bincount(x["of"], x["t"])[x["of"]]
            x["others"] = tables - x["t"]
            x["p"] = (c - d * x["t"] + (strength + d * tables) * x["up"]) / (strength + np.bincount(x["of"], c)[x["of"]])

    probabilities()
    for sweep in range(sweeps):
        for k in range(ORDER, TOP, -1):
            x = levels[k]
            x["t"] = tables_drawn(customers(k), x["others"], x["up"], _uniform(x["codes"], sweep), DISCOUNTS[k], strength, x["logs"])
        probabilities()
        for x in levels.values():
            x["sum"] = x["sum"] + x["p"] * (sweep >= burn) / (sweeps - burn)
    less = {k: levels[k]["up"] if k == TOP + 1 else levels[k - 1]["sum"][levels[k]["to"]] for k in levels}
    return {k: (x["codes"], x["raw"], x["t"], x["sum"], less[k], x["of"]) for k, x in levels.items()}


def _texts(codes: np.ndarray) -> pa.Array:
    """Rows of code points as texts, without a Python object for each."""
    raw = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le").encode()
    size = (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).sum(axis=1)
    ends = np.concatenate(([0], np.cumsum(size))).astype("<i4")
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(raw))


def _codes(texts: pa.Array) -> np.ndarray:
    """The other way, for texts of ORDER characters each."""
    return np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py().encode("utf-32-le"), "<u4").reshape(-1, ORDER)


def deep(rows: DataFrame, sweeps: int, burn: int, last: bool) -> DataFrame:
    """From rows (g, n, p), p being the probability of the last TOP characters: (g, n, raw) of the customers sent to
    restaurants of TOP - 1 characters, or, at the last pass, (g, v, raw) as in `parts` for the orders above TOP."""

    def given(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = together(x, n, p, sweeps, burn)
        if not last:
            codes, raw, t, *_ = found[TOP + 1]
            yield pa.RecordBatch.from_pydict({"g": _texts(codes[:, 1:]), "n": pa.array(t), "raw": pa.array(raw)})
            return
        for k, (codes, raw, _, mean, less, of) in found.items():
            back = np.log(np.maximum(1 - np.bincount(of, mean), 1e-12) / np.maximum(1 - np.bincount(of, less), 1e-12))
            _, at = np.unique(of, return_index=True)
            yield pa.RecordBatch.from_pydict({"g": _texts(codes), "v": pa.array(np.log(mean) - back[of] - np.log(less)), "raw": pa.array(raw)})
            yield pa.RecordBatch.from_pydict({"g": _texts(codes[at, : k - 1]), "v": pa.array(back), "raw": pa.array(np.zeros(len(at), np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((_codes(b.column("g")).view(f"<U{ORDER}").ravel(), b.column("n").to_numpy(), b.column("p").to_numpy()))
            if sum(len(x[0]) for x in held) >= TOGETHER:
                g, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
                ends = g.view("<u4").reshape(-1, ORDER)[:, ORDER - TOP - 1 : ORDER - 1]
                cut = int(np.flatnonzero((ends != ends[-1]).any(axis=1))[-1]) + 1 if (ends != ends[-1]).any() else 0
                if cut:
                    yield from given(g[:cut].copy(), n[:cut], p[:cut])
                held = [(g[cut:].copy(), n[cut:], p[cut:])]
        if held:
            yield from given(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("g", "n", "p").repartition(_ending()).sortWithinPartitions(_ending(), "g").mapInArrow(run, "g string, v double, raw long" if last else "g string, n long, raw long")


def sampled(by_order: dict[int, DataFrame], sweeps: int = SWEEPS, burn: int = BURN, strength: float = CONCENTRATION) -> tuple[dict[int, DataFrame], float]:
    """By order (g, raw, p), the predictive probabilities of all n-grams averaged over the sweeps after `burn`; and the
    averaged probability of a character never seen. `by_order` has (g, n, raw) with n customers. A sweep seats every
    dish anew, longest contexts first, given the other dishes and the parents' probabilities of the sweep before; then
    the probabilities follow, shortest first."""
    d, top = {}, max(by_order)
    for k, rows in by_order.items():
        got = {r["n"]: r["count"] for r in rows.where("n <= 2").groupBy("n").count().collect()}
        d[k] = min(max(got.get(1, 0) / max(got.get(1, 0) + 2 * got.get(2, 0), 1), 0.1), 0.9)
    state = predictive({k: rows.select("g", F.col("n").alias("c"), "raw", F.lit(1).cast("long").alias("t")) for k, rows in by_order.items()}, d, strength)
    kept: list[dict[int, DataFrame]] = []
    for sweep in range(sweeps):
        seated: dict[int, DataFrame] = {}
        for k in range(top, 0, -1):
            rows = state[k]
            if k < top:
                sent = seated[k + 1].groupBy(F.substring("g", 2, k).alias("s")).agg(F.sum("t").alias("c"))
                rows = rows.drop("c").join(sent, F.col("g") == F.col("s"))
            seated[k] = saved(reseated(rows, d[k], strength, sweep))
        state = predictive(seated, d, strength)
        if sweep >= burn:
            kept.append(state)
    out = {}
    for k in by_order:
        rows = kept[0][k].select("g", "raw", "p")
        for x in kept[1:]:
            rows = rows.unionAll(x[k].select("g", "raw", "p"))
        out[k] = saved(rows.groupBy("g").agg(F.max("raw").alias("raw"), F.avg("p").alias("p")))
    one = out[1].agg(F.sum("p").alias("p")).head()["p"]
    return out, max(1.0 - (one or 0.0), 1e-12)


def parts(averaged: dict[int, DataFrame], unseen: float) -> tuple[DataFrame, float]:
    """(g, v, raw), and the log probability of a character never seen, as quality.probabilities gives them.

    What a context has not seen takes the parent's probability, scaled so that all characters sum to one: the share
    that seen characters leave, over what the parent leaves beside the same characters."""
    base = math.log(unseen)
    all_parts = averaged[1].select("g", (F.log("p") - base).alias("v"), "raw")
    for k in range(2, max(averaged) + 1):
        above = averaged[k - 1].select(F.col("g").alias("s"), F.col("p").alias("less"))
        rows = averaged[k].join(above, F.substring("g", 2, k - 1) == F.col("s")).withColumn("c", F.substring("g", 1, k - 1))
        of = rows.groupBy("c").agg(F.sum("p").alias("p"), F.sum("less").alias("less"))
        back = F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)) / F.greatest(1 - F.col("less"), F.lit(1e-12)))
        of = saved(of.select("c", back.alias("back")))
        seen = rows.join(of, "c").select("g", (F.log("p") - F.col("back") - F.log("less")).alias("v"), "raw")
        all_parts = all_parts.unionByName(seen).unionByName(of.select(F.col("c").alias("g"), F.col("back").alias("v"), F.lit(0).cast("long").alias("raw")))
    return all_parts, base


def trained(texts: DataFrame, sweeps: int = SWEEPS, burn: int = BURN) -> tuple[DataFrame, float]:
    """(g, v, raw) of all orders and the log probability of a character never seen, from all of `texts` (their column text)."""
    rows = counted(texts)
    sent = deep(rows.withColumn("p", F.lit(FLAT)), 1, 0, False).groupBy("g").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"))
    by_order = {TOP: saved(sent)}
    for k in range(TOP - 1, 0, -1):
        by_order[k] = saved(by_order[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")))
    averaged, unseen = sampled(by_order, sweeps, burn)
    above = averaged[TOP].select(F.col("g").alias("s"), "p")
    rows = rows.join(above, F.substring("g", ORDER - TOP + 1, TOP) == F.col("s"))
    low, base = parts(averaged, unseen)
    return deep(rows, sweeps, burn, True).unionByName(low), base


def joined(texts: pa.Array) -> pa.Array:
    """Texts in lower case (A-Z alone), their words between single blanks, and the end of words; null is empty."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    return pc.binary_join_element_wise(pc.ascii_trim(pc.replace_substring_regex(low, f"[{BLANKS}]+", " "), " "), "", END_OF_WORDS)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of text, or one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of texts in joined form."""
    lists = pc.split_pattern(pc.utf8_rtrim(texts, END_OF_WORDS), " ")
    rows, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    real = pc.not_equal(words, "")
    return rows[real.to_numpy(zero_copy_only=False)], words.filter(real)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of the words in `train`'s texts, summed within each task first; the end of texts is not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _sliced(batches):
            found = pc.value_counts(_words(joined(b.column("text")))[1])
            held.append(pa.table([found.field("values"), found.field("counts")], ["word", "n"]))
            size += len(found)
            if size > WORDS:
                held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]
                size = held[0].num_rows
                if size > WORDS // 2:
                    yield from held.pop().to_batches(SENT)
                    size = 0
        if held:
            yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(SENT)

    return saved(train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def with_words(spark: SparkSession, counts: DataFrame, hot: int):
    """A function from batches of doc_id, held_out (both texts) and text to batches of doc_id (null), lang, text: the
    text in joined form and, in `lang`, the row's id, split, number of words, words found among the `hot` most
    frequent ones, the sum of their log10(c + 1), and the other words, between blanks."""
    top = counts.orderBy(F.desc("n"), "word").limit(hot).toArrow()
    shared = spark.sparkContext.broadcast((top["word"].combine_chunks(), np.log10(top["n"].to_numpy() + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for part in _sliced(batches):
            text = joined(part.column("text"))
            rows, words = _words(text)
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            n, found = np.bincount(rows, minlength=part.num_rows), np.bincount(rows[at >= 0], minlength=part.num_rows)
            total = np.bincount(rows[at >= 0], logs[at[at >= 0]], part.num_rows)
            rare, other = rows[at < 0], words.filter(pa.array(at < 0))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.arange(part.num_rows + 1)), pa.int32()), other)
            said = [pc.cast(pa.array(x), pa.string()) for x in (n, found, total)]
            told = pc.binary_join_element_wise(part.column("doc_id"), part.column("held_out"), *said, pc.binary_join(lists, " "), " ")
            yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), told, text], ["doc_id", "lang", "text"])

    return run


def score(docs: DataFrame, held_out: Column, hot_words: int = HOT_WORDS, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; it learns from the rows for
    which `held_out` (over doc_id) is false.

    `score` is the log10 probability of the text in lower case, its words between single blanks and ended, under the
    character model, so it needs no unknown word; other control characters count as blanks. Null and empty texts are
    their end alone. Repeated rows and null ids are rows of their own. Without training rows every character has
    probability 1/2 and all counts are 0. Words and n-grams beyond the most frequent ones meet their counts in joins.
    Extra columns are ignored. Texts of any length are read in slices."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out)
    train = d.where(~F.col("held_out"))
    counts = word_counts(train)
    ends = train.count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    n, v = size["n"] + ends, size["v"] + (ends > 0)
    if ends:
        model, base = hashed(*trained(train, sweeps, burn), ORDER)
    else:
        model, base = docs.sparkSession.createDataFrame([], "h long, v double, raw long"), math.log(0.5)
    named = d.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("doc_id"), F.col("held_out").cast("string").alias("held_out"), "text")
    seen = scanned(named, model, base, HOT, ORDER, CELLS, with_words(docs.sparkSession, counts, hot_words))
    said = F.split("lang", " ")
    rare = seen.where("shard is null").select("flush", "idx", F.explode(F.slice(said, 6, F.greatest(F.size(said) - 5, F.lit(0)))).alias("word")).where("word <> ''")
    met = rare.groupBy("flush", "idx", "word").agg(F.count("*").alias("k")).join(counts, "word")
    met = met.groupBy("flush", "idx").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("extra"))
    told = answered(seen, model).withColumn("said", F.slice(said, 1, 5))
    tokens = F.col("said")[2].cast("long") + 1
    return told.join(met, ["flush", "idx"], "left").select(
        F.when(F.col("said")[0] != "-", F.col("said")[0].cast("long")).alias("doc_id"),
        F.col("said")[1].cast("boolean").alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("said")[3].cast("long") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("said")[4].cast("double") + F.coalesce("extra", F.lit(0.0)) + math.log10(ends + 1) - tokens * math.log10(n + v + 1)).alias("base_score"),
        (-F.col("nll") / math.log(10)).alias("score"),
    )


def every_seventh(doc_id: Column) -> Column:
    """Whether a row is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
