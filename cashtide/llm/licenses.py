"""License scans with a positional index of rare words, in DataFrame operations alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, split_words

SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"


@dataclass(frozen=True)
class Template:
    """Words of a licence text; `key` gives the mandatory phrase as (first word's place, words)."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        k, w = self.key.split(), self.words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: Phrases of the contract, then sentences that name well-known licences.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of `words` (column words) each licence word occurs: over all rows, one number per word."""
    found = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    return {r["w"]: r["n"] for r in words.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def positional_index(templates, df: dict[str, int], rows: int) -> tuple[dict[str, list[tuple[int, int]]], dict[str, float]]:
    """Postings of each template's rarest word: word -> [(template, place)]; and the words' IDF."""
    idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) for t in templates for w in t.words}
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        # the place must lie in the key phrase: a match always holds it, so no match is missed
        span = range(t.key_at, t.key_at + len(t.key.split()))
        at = max(span, key=lambda i: (idf[t.words[i]], -i))
        postings.setdefault(t.words[at], []).append((k, at))
    return postings, idf


def scan(docs: DataFrame, templates=TEMPLATES, min_share: float = 0.6) -> DataFrame:
    """The rows of `docs` (without their text) with words and matches.

    matches: array of (template, start, share) - the start may lie before the text when a template's head is
    cut off. Each row's rare licence words are looked up in the index, every posting gives a relative position,
    the template's other words are intersected there, and the key phrase must stand in full. share is the
    IDF-free fraction of the template's words that stand in place; templates below `min_share` are dropped.

    All is done within the row, so hot sources, repeated ids and repeated rows need no shuffle. Null or empty
    text: no words, no matches. Empty table: empty result. Columns of `docs` named words, hits, found or matches are
    replaced or dropped; report() does not read them.
    """
    rows = docs.withColumn("words", split_words(ascii_lower(F.col("text")), SEPARATORS)).drop("text")
    vocabulary = sorted({w for t in templates for w in t.words})
    counted = docs.select(split_words(ascii_lower(F.col("text")), SEPARATORS).alias("words"))
    n_rows = docs.count()
    postings, _ = positional_index(templates, document_frequency(counted, vocabulary), n_rows)
    words = F.col("words")
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*postings), F.struct(w.alias("w"), i.alias("at")))))
    index = F.create_map(
        *[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("template"), F.lit(at).alias("at")) for k, at in ps]))]
    )
    found = F.flatten(
        F.transform("hits", lambda h: F.transform(index[h["w"]], lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["at"]).alias("start"))))
    )
    texts = F.array(*[F.array(*[F.lit(w) for w in t.words]) for t in templates])
    key_at = F.array(*[F.lit(t.key_at) for t in templates])
    keys = F.array(*[F.array(*[F.lit(w) for w in t.key.split()]) for t in templates])

    def in_place(want: Column, start: Column) -> Column:
        return F.size(F.filter(F.transform(want, lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False))), lambda x: x))

    def checked(c: Column) -> Column:
        want, key = F.get(texts, c["template"]), F.get(keys, c["template"])
        return F.struct(
            c["template"].alias("template"),
            c["start"].alias("start"),
            (in_place(want, c["start"]) / F.size(want)).alias("share"),
            (in_place(key, c["start"] + F.get(key_at, c["template"])) == F.size(key)).alias("key"),
        )

    matches = F.filter(F.transform(F.array_distinct("found"), checked), lambda m: m["key"] & (m["share"] >= min_share))
    return (
        rows.withColumn("hits", hits).withColumn("found", found).withColumn("matches", matches).drop("hits", "found")
    )


def report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = [k for k, t in enumerate(templates) if t.base]
    names = F.array(*[F.lit(t.label) for t in templates])
    s = scan(docs, templates).withColumn("_base", F.transform(F.filter("matches", lambda m: m["template"].isin(*base) & (m["share"] == 1.0)), lambda m: m["start"]))
    label = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: F.get(names, m["template"])))), ",")
    return s.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        label(F.filter("matches", lambda m: m["template"].isin(*base))).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).cast("double").alias("score"),
    )
