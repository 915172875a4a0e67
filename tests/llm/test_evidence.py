"""Chat edges, Viterbi against enumeration, recall and precision of spans, and votes against a plain implementation."""

import itertools
import random

import numpy as np
import pytest

from cashtide.llm import chat, langid, packing, pii


def test_chat_nested_extra_fields_and_null_arrays(spark):
    kind = "conv_id long, messages array<struct<role:string,content:string,name:string>>, n long"
    rows = [(1, [("user", "hi", "x"), ("assistant", "yo", None)], 5), (2, None, 5), (3, [], 5), (4, [("user", None, None)], 5), (None, [("user", "a", "b")], 5), (5, [("user", "word " * 50_000, "b")], 1)]
    got = chat.canonical_turns(spark.createDataFrame(rows, kind))
    assert sorted(map(str, map(tuple, got.where("length(text) < 99").collect()))) == sorted(
        map(str, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "", ""), (3, 0, "", ""), (4, 0, "user", ""), (None, 0, "user", "a")])
    )
    back = chat.read_back(chat.formatted(got)).collect()
    assert {r.conv_id: len(r.turns) for r in back} == {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1}


def test_chat_instruction_layout_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "be kind", "hi", "yo"), (2, None, "hi", "yo"), (2, None, "hi", "yo")], "conv_id long, instruction string, input string, output string")
    got = sorted(tuple(r) for r in chat.canonical_turns(d).collect())
    assert got == sorted([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), *[(2, 1, "user", "hi"), (2, 2, "assistant", "yo")] * 2])
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (row,) = chat.read_back(chat.formatted(turns)).collect()
    assert [(t.role, t.text, t.loss) for t in row.turns] == [("user", "a", False), ("user", "a", False), ("assistant", "b", True)]


def test_viterbi_equals_enumeration():
    """Every segmentation and labelling of short islands is scored; the field's is among the best."""
    field = pii.trained()
    kinds = len(pii.KINDS) + 1

    def best(tokens, text):
        lattice = pii._lattice(text, tokens)
        scores = field.scores(lattice)

        def ways(i):
            if i == len(tokens):
                yield []
                return
            for rest in ways(i + 1):
                yield [(i, i + 1, 0), *rest]
            for (a, j), s in scores.items():
                if a == i:
                    for rest in ways(j):
                        for k in range(1, kinds):
                            yield [(i, j, k), *rest]

        def total(way):
            before, out = 0, 0.0
            for i, j, k in way:
                out += field.t[before, k] + (scores[i, j][k - 1] if k else 0.0)
                before = k
            return out

        return max(total(w) for w in ways(0)), total

    for text in ("212-555-0132", "10.1.2.3", "a@b.co", "1.2.3", "12/3 x9"):
        for tokens in pii.islands(text):
            top, total = best(tokens, text)
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            spans = [(starts[a], ends[b], pii.KINDS.index(k) + 1) for k, a, b in field.best(text, tokens)]
            way, at = [], 0
            for i, j, k in [*spans, (len(tokens), len(tokens), -1)]:
                way += [(x, x + 1, 0) for x in range(at, i)]
                if k >= 0:
                    way.append((i, j, k))
                at = j
            assert total(way) == pytest.approx(top)


def test_pii_recall_and_precision_by_kind():
    """On lines of another seed than the training's."""
    field, hit, said, true = pii.trained(), {}, {}, {}
    for text, spans in pii._examples(random.Random(99), 1500):
        got = set(pii.find(text, field)[1])
        for s in spans:
            true[s[0]] = true.get(s[0], 0) + 1
            hit[s[0]] = hit.get(s[0], 0) + (s in got)
        for s in got:
            said[s[0]] = said.get(s[0], 0) + 1
    for k in pii.KINDS:
        print(k, "recall", round(hit[k] / true[k], 3), "precision", round(hit[k] / said[k], 3))
        assert hit[k] / true[k] >= 0.95 and hit[k] / said[k] >= 0.9


def test_language_votes_equal_plain_ones(spark):
    """Families and one-versus-one votes against a plain loop, and accuracy on documents that were held out."""
    rng = np.random.default_rng(2)
    parts = {"en": "the and ing ed wh", "sco": "the an in wis frae", "fr": "eau le ou ai é", "es": "el cion os ña de", "de": "der ung sch ein ß"}
    rows = [(i, " ".join("".join(rng.choice(p.split(), int(rng.integers(1, 4)))) for _ in range(40)), k) for i, (k, p) in enumerate(itertools.islice(itertools.cycle(parts.items()), 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs.where("doc_id % 4 <> 2"))
    assert len(model["families"]) == 3  # anglic, germanic, romance
    one = langid.decider(model)

    def vote(x, keys, machines):
        won = {k: 0 for k in keys}
        margin = {k: 0.0 for k in keys}
        for (a, b), w in machines.items():
            m = float(np.dot(w[:-1], x) + w[-1])
            won[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        return sorted(keys, key=lambda k: (-won[k], -margin[k], k))[0]

    right = []
    for i, text, lang in rows:
        x = langid.features(text)
        family = vote(x, list(model["families"]), model["between"])
        want = model["langs"][vote(x, model["families"][family], model["within"][family])]
        assert one(text)[0] == want
        if i % 4 == 2:
            right.append(want == lang)
    assert np.mean(right) >= 0.95


def test_ids_equal_those_of_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    exact, ours = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.Tokenizer(packing.vocabulary_path())
    rng = random.Random(5)
    odd = ["a", " ", "  ", "\n", "\t", "'s", "é", "ß", "名", "😀", "1", "-", "<|endoftext|>", "A", " ", " ", "Z9"]
    for _ in range(1500):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        assert ours.ids(text) == exact.encode(text, add_special_tokens=False).ids, repr(text)
