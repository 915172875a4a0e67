"""Language identification: family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside

#: Families of closely related languages; a language not named here is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "is", "nb", "nl", "nn", "no", "sv"),
    "anglic": ("en", "sco"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNDETERMINED = "und"
#: Hashed byte n-grams: features, and how many labelled documents of a language are learned from at most.
DIMENSIONS, SAMPLE = 4096, 600
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def features(text: str) -> np.ndarray:
    """Square roots of relative frequencies of hashed byte bigrams and trigrams; letters alone, case folded."""
    b = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    b = np.concatenate(([32], b, [32]))
    half = DIMENSIONS // 2
    two = (b[:-1] * 31 + b[1:] * 7919) % half
    three = (b[:-2] * 961 + b[1:-1] * 15731 + b[2:] * 789221) % half + half
    spaces = int((b[:-1] * 256 + b[1:] == 32 * 257).sum())
    x = np.bincount(two, minlength=DIMENSIONS) + np.bincount(three, minlength=DIMENSIONS)
    x[(32 * 31 + 32 * 7919) % half] -= spaces  # runs of spaces say nothing
    x = np.sqrt(np.maximum(x, 0))
    return (x / (np.sqrt((x * x).sum()) or 1.0)).astype(np.float32)


def linear_svm(x: np.ndarray, sign: np.ndarray, epochs: int = 40, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) by averaged stochastic subgradients of the hinge loss, classes balanced."""
    rng = np.random.default_rng(seed)
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(sign > 0, len(sign) / (2.0 * max(1, (sign > 0).sum())), len(sign) / (2.0 * max(1, (sign < 0).sum())))
    w, mean, batch = np.zeros(xb.shape[1]), np.zeros(xb.shape[1]), 64
    step, total = 0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(xb))
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            off = (xb[k] @ w) * sign[k] < 1
            rate = 2.0 / (1 + step * 0.02)
            w = w * (1 - rate * reg) + rate * ((sign[k] * weight[k] * off) @ xb[k]) / len(k)
            step += 1
            if epoch >= epochs // 2:
                mean, total = mean + w, total + 1
    return mean / max(1, total)


def learned(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Trains on at most about `sample` documents of each language: those whose seeded hash is smallest.

    `docs` has doc_id, text and lang and holds training rows only. The sample is bounded by `sample` times the
    number of languages, whatever the size of the table; its features are computed on the executors.
    """
    rows = docs.where("lang is not null and text is not null").withColumn("_h", F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, sample / n) * (1 << 30)))) for k, n in counts.items()], F.lit(0)) if counts else F.lit(0)
    picked = rows.where(F.col("_h") < part).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id").take(pa.array(some, pa.int64())),
                    "lang": b.column("lang").take(pa.array(some, pa.int64())),
                    "x": pa.array([features(texts[i]).tobytes() for i in some], pa.binary()),
                }
            )

    got = sorted(picked.mapInArrow(run, "doc_id long, lang string, x binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["x"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return {"langs": [], "families": {}, "between": {}, "within": {}}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    y = np.array([langs.index(r["lang"]) for r in got])
    family = {lang: next((f for f, names in FAMILIES.items() if lang in names), lang) for lang in langs}
    names = sorted(set(family.values()))
    of = np.array([names.index(family[lang]) for lang in langs])[y]

    def one_versus_one(labels: np.ndarray, keys: list) -> dict:
        out = {}
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                rows = (labels == a) | (labels == b)
                out[a, b] = linear_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
        return out

    within = {k: [i for i, lang in enumerate(langs) if family[lang] == f] for k, f in enumerate(names)}
    return {
        "langs": langs,
        "families": within,
        "between": one_versus_one(of, list(range(len(names)))),
        "within": {k: one_versus_one(y, ids) for k, ids in within.items()},
    }


def _decide(x: np.ndarray, keys: list, machines: dict) -> tuple[int, float]:
    """The key with most votes (ties: larger summed margin) and the weakest of its margins as a probability."""
    if len(keys) == 1:
        return keys[0], 1.0
    votes, sums, low = dict.fromkeys(keys, 0), dict.fromkeys(keys, 0.0), dict.fromkeys(keys, np.inf)
    for (a, b), w in machines.items():
        m = float(x @ w[:-1] + w[-1])
        votes[a if m >= 0 else b] += 1
        for k, v in ((a, m), (b, -m)):
            sums[k] += v
            low[k] = min(low[k], v)
    best = max(keys, key=lambda k: (votes[k], sums[k], -k))
    return best, 1.0 / (1.0 + float(np.exp(-np.clip(2.0 * low[best], -30, 30))))


def decider(model: dict):
    """The function text -> (language, score). Its weights travel inside it: bounded by the number of languages."""
    langs, families = model["langs"], model["families"]

    def one(text: str | None) -> tuple[str, float]:
        if text is None or not langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        x = features(text)
        f, p = _decide(x, list(families), model["between"])
        k, q = _decide(x, families[f], model["within"][f])
        return langs[k], p * q

    return one


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs`, from its whole text alone, one row per input row.

    Null texts, texts without a letter and an untrained model give `und` with score 0. One task holds one
    Arrow batch of texts at a time.
    """
    one = decider(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def is_held_out(c=None):
    return F.crc32((F.col("doc_id") if c is None else c).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row: doc_id, held_out, lang_pred, score."""
    d = docs.select("doc_id", "text", "lang")
    model = learned(d.where(~F.coalesce(is_held_out(), F.lit(False))))
    return predicted(d, model).select(
        "doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def labelled(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, which has no column _pred, with _pred, the predicted language; see relabelled()."""
    decide, names = decider(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([decide(t.as_py())[0] for t in b.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*names, "_pred"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_pred", T.StringType())]))


def relabelled(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` whose language is determined, with `lang` set to the predicted one. All other columns come out
    as they went in, also one named _pred."""
    names = docs.columns
    free, back = aside(docs, ("_pred",))
    return labelled(free, model).where(F.col("_pred") != UNDETERMINED).withColumn("lang", F.col("_pred")).drop("_pred").withColumnsRenamed(back).select(*names)
