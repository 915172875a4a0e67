"""Brute-force comparisons of conversation repair, vector codes and language-model scores."""

import contextlib
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashtide.llm import pitman, quality, repair, vectorcodes

BLANKS = "\t\n\x0b\f\r "


def plain_repair(rows):
    """One conversation (id, turn, role, text) by a table of whole audit texts, without macros."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        after += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort()
    counts, seen, best = Counter(), set(), {"n": (0, "", ())}
    turns = [t for known, t, _, _ in after if known]
    nxt = {"n": "su", "s": "u", "u": "a", "a": "u"}

    def widen(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                for x in set(nxt[s]) - {"s"}:
                    new = (cost + 3, audit + "I", (*out, {"u": "user:", "a": "assistant:"}[x]))
                    best[x] = min(best.get(x, new), new)
        return best

    for _, _, role, text in after:
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        new, extra = {}, 3 * (fault == "truncated")
        for s, (cost, audit, out) in widen(best).items():
            ways = [(s, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[0] in nxt[s]:
                    ways.append((role[0], (cost + extra, audit + "K", (*out, f"{role}:{text}"))))
                ways += [(x, (cost + 3 + extra, audit + "R", (*out, {"u": "user:", "a": "assistant:"}[x] + text))) for x in nxt[s] if x != "s"]
            for x, way in ways:
                new[x] = min(new.get(x, way), way)
        best = new
    cost, audit, out = min(v for s, v in widen(best).items() if s in "na")
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    r = random.Random(5)
    texts = ["Yes.", "No!", "cut off", " \t", "", None, "Why?", "Long " * 9000 + "end."]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = [(c, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for c in range(60) for _ in range(r.randrange(1, 9))]
    rows += [(None, t % 50, r.choice(roles), f"{t % 7} said.") for t in range(300)] + [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(2500)]
    rows += [(500 + i, 0, "user", "again.") for i in range(40)] + [(7, 3, "user", "twice.")] * 30
    return rows


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repair(spark, partitions):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "seq": F.lit("x"), "audit": F.lit(2)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert got == {c: plain_repair(x) for c, x in by.items()}
    assert repair.repair(df.limit(0)).count() == 0


def test_codes_order_like_their_texts():
    assert repair.CODES == sorted(repair.CODES)
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


def plain_codes(vectors, rounds=6):
    width = -(-max(len(v) for _, _, v in vectors) // 8) * 8
    rows = sorted((i, [math.floor(4096 * x) for x in v] + [0] * (width - len(v)), lab) for i, lab, v in vectors)
    w = width // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in rows[:16]] for p in range(8)]
    near = lambda x, c: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(c))
    for _ in range(rounds):
        for p in range(8):
            held = {}
            for _, v, _ in rows:
                held.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(z) // len(held[e]) for z in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])]
    found = [(i, lab, [near(part(v, p), books[p]) for p in range(8)]) for i, v, lab in rows]
    sums = Counter()
    for _, lab, best in found:
        sums[lab] += sum(d for d, _ in best)
    digest = hashlib.sha256(",".join(str(x) for c in books for y in c for x in y).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), sums[lab], digest) for i, lab, best in found)


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_codes(spark, scale):
    rng = np.random.default_rng(3)
    x = (rng.integers(-3, 4, (240, 16)) / 8 * scale).astype(np.float32)
    x[100:130] = x[100]
    vectors = [(i, None if i % 7 == 0 else i % 3, v.tolist()) for i, v in enumerate(x)] + [(900, 1, [1.0] * 5), (901, 1, [])]
    odd = [(1000, 1, None), (1001, 1, [None] + [0.0] * 15), (1002, 1, [math.inf] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in vectors + odd], "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "error": F.lit("e"), "v": F.lit(2)})
    got = sorted(tuple(r) for r in vectorcodes.report(df.repartition(5)).collect())
    assert got == plain_codes(vectors)


def test_codes_huge_components(spark):
    vectors = [(i, 1, [float(np.float32(s * 10.0**e))] * 8) for i, (s, e) in enumerate(itertools.product((1, -1, 0.5), (-3, 0, 9, 30, 38)))]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in vectors], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.code for r in vectorcodes.report(df).collect()}
    assert got == {r[0]: r[1] for r in plain_codes(vectors)}
    assert vectorcodes.report(df.limit(0)).count() == 0


def test_bounds_stay_bounds():
    x = np.random.default_rng(1).random(1000) * 1e5
    assert (vectorcodes.half(x).astype(float) <= x).all() and (vectorcodes.rounded_up(x).astype(float) >= x).all()


def test_stirling_numbers():
    logs, d = pitman.stirling(0.4), 0.4
    assert np.allclose(np.exp(logs[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1])


def test_tables_follow_their_distribution():
    c, a, p, d, s = 6, 3, 0.2, 0.5, 1.0
    logs = pitman.stirling(d)
    w = np.array([math.exp(logs[c, t]) * p**t * math.prod(s + d * (a + i) for i in range(t)) for t in range(1, c + 1)])
    u = (np.arange(20000) + 0.5) / 20000
    t = pitman.tables_drawn(np.full(20000, c), np.full(20000, a), np.full(20000, p), u, d, s, logs)
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / 20000, w / w.sum(), atol=2e-4)
    many = pitman.tables_drawn(np.array([1, 10**6]), np.array([0, 5]), np.array([0.1, 0.1]), np.array([0.3, 0.3]), d, s, logs)
    assert many[0] == 1 and 1 <= many[1] <= 10**6


@pytest.fixture(scope="module")
def documents():
    r = random.Random(2)
    words = ["the", "river", "stone", "märz", "über", "AND", "a"] + ["".join(r.choices("abcdef", k=5)) for _ in range(60)]
    docs = [(i, " \n".join(r.choices(words, k=r.randrange(1, 40)))) for i in range(150)]
    return docs + [(1000, None), (1001, ""), (1002, " \t "), (None, "the stone"), (5, "the stone"), (5, "the stone"), (1003, "word " * 120000 + "rareword")]


@pytest.mark.parametrize("hot", [4, 1 << 18])
def test_scores(spark, documents, hot):
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"lang": F.lit("x"), "n": F.lit(1), "held_out": F.lit("y")})
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").translate(dict.fromkeys(map(ord, BLANKS), " ")).split(" ") if w] + [None]
    train = Counter(w for i, t in documents if not out(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted(((i is None, i or 0, out(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in documents))
    rows = pitman.score(df, pitman.every_seventh(F.col("doc_id")), hot_words=hot).collect()
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert all(r.score < 0 for r in rows)
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


def test_model_sums_to_one_and_scores_add_up(spark, documents):
    df = spark.createDataFrame([d for d in documents if d[0] != 1003], "doc_id long, text string")
    train = df.where(~pitman.every_seventh(F.col("doc_id")))
    rows, base = pitman.trained(train)
    v, back = Counter(), Counter()
    for r in rows.collect():
        (v if r.raw else back)[r.g] += r.v

    def log_p(context, c):
        p = base
        for k in range(pitman.ORDER):
            u = context[len(context) - k :]
            p += v[u + c] + back[u]
        return p

    seen = {g for g in v if len(g) == 1}
    ends = [g[-1] for g in v if len(g) > 1]
    symbols = sorted(seen & set(ends))
    for context in ("\x02" * 5, "e riv", "stone", "zzzzz", "er st"):
        assert abs(sum(math.exp(log_p(context, c)) for c in symbols) + math.exp(log_p(context, "一")) - 1) < 1e-3
    got = {r.doc_id: r.score for r in pitman.score(df, pitman.every_seventh(F.col("doc_id"))).collect()}
    for i, text in documents[:5]:
        t = "\x02" * 5 + " ".join(text.lower().split()) + "\n" + quality.END
        assert abs(sum(log_p(t[k - 5 : k], t[k]) for k in range(5, len(t))) / math.log(10) - got[i]) < 1e-2


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, "some words") for i in range(3)], "doc_id long, text string")
    rows = pitman.score(df, F.lit(True)).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)
    assert pitman.score(df.limit(0), F.lit(True)).count() == 0


def _counting(batches):
    """What a task of pitman.counted sends for its batches."""

    class Task:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.sent = run(batches)
            raise StopIteration

    task = Task()
    with contextlib.suppress(StopIteration):
        pitman.counted(task)
    return task.sent


def test_scores_count_ngrams_in_bounded_memory(monkeypatch):
    """A task holds the n-grams that it counts, in a few bytes each: a Python text for every one took most of an executor."""
    monkeypatch.setattr(pitman, "COUNTED", 1 << 18)
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, x)) for x in rng.integers(97, 123, (40, 20_000))]  # nearly all n-grams differ
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 4])}) for i in range(0, 40, 4)]
    tracemalloc.start()
    try:
        n = sum(sum(b.column("n").to_pylist()) for b in _counting(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(t) + 3 for t in texts)  # the start alone, an end of words and an end each
    assert peak < 280 * pitman.COUNTED, peak / pitman.COUNTED


@pytest.mark.parametrize("counted", [300, 1 << 20])
def test_scores_count_every_ngram(monkeypatch, counted):
    monkeypatch.setattr(pitman, "COUNTED", counted)
    monkeypatch.setattr(pitman, "SENT", 64, raising=False)
    monkeypatch.setattr(quality, "CHUNK", 200)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab é€😀") for _ in range(rnd.randrange(90))) for _ in range(60)] + [None, ""]
    want = Counter()
    for t in pitman.joined(pa.array(texts)).to_pylist():
        s = quality.START * pitman.ORDER + t + quality.END
        want.update(s[i - pitman.ORDER + 1 : i + 1] for i in range(pitman.ORDER - 1, len(s)))
    got = Counter()
    for b in _counting([pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 9], pa.string())}) for i in range(0, 62, 9)]):
        for g, n in zip(b.column("g").to_pylist(), b.column("n").to_pylist(), strict=True):
            got[g] += n
    assert got == want


@pytest.mark.parametrize("held", [40, 1 << 19])
def test_scores_count_words_once_a_task(monkeypatch, held):
    """A task sends a word once, not once a batch, unless it holds too many."""
    monkeypatch.setattr(pitman, "WORDS", held, raising=False)
    texts = [f"the Quick {i % 50} the {i % 7}" for i in range(400)] + [None, " "]
    sent = []

    class Task:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 20], pa.string())}) for i in range(0, 402, 20)]
            sent.extend(r for b in run(iter(batches)) for r in b.to_pylist())
            raise StopIteration

    with contextlib.suppress(StopIteration):
        pitman.word_counts(Task())
    got = Counter()
    for r in sent:
        got[r["word"]] += r["n"]
    assert got == Counter(" ".join(t for t in texts if t).lower().split())
    assert held == 40 or len(sent) == len(got)
