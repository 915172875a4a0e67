"""The corpus pipeline on a small table: each stage's decisions, and whole texts in the packed windows."""

import numpy as np

import corpus_pipeline
from cashtide.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = {"en": "the and of to in that is was", "de": "der und die nicht ist ein das mit"}
    rows = [(i, " ".join(rng.choice(words[k].split(), 60)), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, None, "en", "s1", None), (102, "123 456", "en", "s1", 7), (103, rows[3][1] + " a.b@c.org", "de", "s0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = corpus_pipeline.known_language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in one.collect()} == {101, 102}
    two = corpus_pipeline.one_of_each(spark, one, str(tmp_path))
    assert sorted(r.doc_id for r in two.collect()) == list(range(60))
    three = corpus_pipeline.without_personal_data(spark, one, str(tmp_path))
    assert "<EMAIL>" in three.where("doc_id = 103").head().text and three.columns == docs.columns
    assert corpus_pipeline.mixed(spark, three, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = packing.Tokenizer(packing.vocabulary_path())
    text = {r.doc_id: r.text for r in two.collect()}
    assert got and all(np.frombuffer(r.ids, "<u4").tolist() == (t.ids(text[r.doc_id]) + [1])[r.start : r.start + r.length] for r in got)


def test_near_copies_are_those_of_five_words_at_four_fifths(spark, tmp_path):
    """Appended, scattered, inserted and turned copies around the limit, against all pairs."""
    texts = []
    for n in (12, 45, 100, 500):
        base = [f"{n}w{k}" for k in range(n)]
        texts.append(base)
        texts += [base + [f"{n}x{share}y{k}" for k in range(n * share // 100)] for share in (12, 18, 24, 30)]
        texts += [[f"{n}e{edits}" if k % (n // edits) == n // edits // 2 else w for k, w in enumerate(base)] for edits in (1, 2, 9, 11, 14) if edits < n // 5]
        texts += [base[: n // 2] + [f"{n}i"] + base[n // 2 :], base[n // 2 :] + base[: n // 2]]
    up, between = list(range(len(texts))), 0
    sets = {w: [{tuple(t[k : k + w]) for k in range(len(t) - w + 1)} for t in texts] for w in (3, 5)}
    for i in range(len(texts)):
        for j in range(i):
            (a, b), (c, d) = (sets[5][i], sets[5][j]), (sets[3][i], sets[3][j])
            if 5 * len(a & b) >= 4 * len(a | b):
                between += 10 * len(c & d) < 9 * len(c | d)
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert between > 20
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect())
    assert kept == sorted(set(up))


def test_near_copies_with_null_and_repeated_ids(spark, tmp_path):
    """Rows, not ids, are told apart: one row of each group stays, null ids last."""
    base = {k: [f"{k}{i}" for i in range(60)] for k in "abcdef"}
    near = {k: " ".join([*w, f"{k}near"]) for k, w in base.items()}
    base = {k: " ".join(w) for k, w in base.items()}
    rows = [(None, base["a"]), (4, near["a"]), (None, base["b"]), (None, near["b"]), (7, base["c"]), (7, base["c"]), (7, near["c"])]
    rows += [(9, base["d"]), (9, base["e"]), (3, near["d"]), (2, near["e"]), (None, base["f"]), (None, None), (None, ""), (12, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()]
    text = {t[0]: 0 for t in base.values()}
    for _, t in kept:
        if t and t.strip():
            text[t[0]] += 1
    assert set(text.values()) == {1}
    assert {(4, near["a"]), (3, near["d"]), (2, near["e"]), (None, base["f"]), (None, None), (None, ""), (12, " ")} <= set(kept)
    assert {i for i, t in kept if t and t[0] in "bc"} == {None, 7} and len(kept) == 9


def test_columns_with_the_stages_own_names_pass_through(spark, tmp_path):
    own = ["size", "Target", "taken", "source_size", "_h", "_b", "_s", "_sb", "_before", "_within", "_whole", "_times", "_copy", "_row", "_pred", "_k", "_bits", "size_", "words", "node"]
    rows = [(i, f"the and of to {i // 2} in that is was it for on with as by at from", "en", f"s{i % 2}", 0, *[f"{c}{i}" for c in own]) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in own))
    for stage in (corpus_pipeline.known_language, corpus_pipeline.one_of_each, corpus_pipeline.without_personal_data, corpus_pipeline.mixed):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in own)
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() >= 40
