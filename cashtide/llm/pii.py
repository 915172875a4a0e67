"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans they miss."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans are listed; the last one is found by the field alone.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Longest segment in tokens.
SEGMENT = 44

_TRIGGER = re.compile(r"[0-9@+]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, back to the last match, and the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            low = at
            while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
                low -= 1
            if low < at and (m := _DOMAIN.match(text, at)):
                yield low, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping spans of each kind; a match that fails its test is dropped, not retried."""
    out: list[tuple[str, int, int]] = []
    if not _TRIGGER.search(text):
        return out
    out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


#: What every shape but an obfuscated email has in it: a digit, an @ or a run of 16 letters.
_HINT = re.compile(r"[0-9@]|[A-Za-z]{16}")
_AT_MARK = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_SPACE = re.compile(r"\s")
#: What may stand between two chunks of one shape.
_JOINT = re.compile(r"[ ().-]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"),
    "plus": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "national": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "zero": re.compile(r"00[1-9][0-9]{0,2}[ -][0-9 -]{7,14}[0-9]"),
    "digits": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "groups": re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}"),
    "hex": re.compile(r"[0-9a-f]{20,}"),
    "key": re.compile(r"[A-Za-z]{0,6}[_-]?[A-Za-z0-9]{16,}"),
    "date": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    "number": re.compile(r"[0-9]+(?:[.,][0-9]+)*"),
}
_SAID = re.compile(r"(token|secret|passw(?:or)?d|api[_ -]?key|key)\W{0,4}\Z", re.I)
_STOP = re.compile(r"[^\s]\. ")
FEATURES = (
    *(f"is {k}" for k in _SHAPES), "bias", "one token", "luhn", "13-19 digits", "9-15 digits", "7 digits or more", "parts over 255",
    "letters and digits", "letters alone", "capitals", "sentence end", "mention", "edge before", "edge after", "said", "blank at an end", "long",
)
_AT = {k: i for i, k in enumerate(FEATURES)}


def span_features(text: str, a: int, b: int) -> list[int]:
    """Indexes of the features that hold for the whole span text[a:b]."""
    s = text[a:b]
    out = [_AT["bias"]] + [_AT[f"is {k}"] for k, p in _SHAPES.items() if p.fullmatch(s)]
    digits = [c for c in s if "0" <= c <= "9"]
    n = len(digits)
    alpha = any(c.isalpha() for c in s)
    tests = {
        "luhn": 13 <= n <= 19 and luhn("".join(digits)),
        "13-19 digits": 13 <= n <= 19,
        "9-15 digits": 9 <= n <= 15,
        "7 digits or more": n >= 7,
        "parts over 255": any(len(p) < 9 and p.isdigit() and p.isascii() and int(p) > 255 for p in s.split(".")),
        "letters and digits": alpha and n > 3,
        "letters alone": n == 0,
        "capitals": b - a >= 16 and s.isalnum() and s.isupper(),
        "sentence end": _STOP.search(s) is not None,
        "mention": " @" in s and "@ " not in s,
        "edge before": a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-./@_"),
        "edge after": b < len(text) and (text[b].isalnum() or (text[b] in "-/@_." and b + 1 < len(text) and text[b + 1].isalnum())),
        "said": _SAID.search(text, max(0, a - 16), a) is not None,
        "blank at an end": s[0] in " " or s[-1] in " .,;",
        "long": b - a >= 24,
    }
    return out + [_AT[k] for k, v in tests.items() if v]


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Chunks between white space that have a hint, and emails with blanks in them with the chunks they touch."""

    def chunk(a: int, b: int) -> tuple[int, int]:
        while a and not text[a - 1].isspace():
            a -= 1
        m = _SPACE.search(text, b)
        return a, m.start() if m else len(text)

    at = 0
    while m := _HINT.search(text, at):
        low, at = chunk(m.start(), m.end())
        yield low, at
    done = 0
    for m in _AT_MARK.finditer(text):
        if m.start() >= done and (host := _HOST.match(text, m.end())):
            blank = m.start() > 1 and text[m.start() - 1] == " "
            low, done = chunk(m.start() - blank, host.end())
            yield low, done


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token bounds of each stretch worth decoding: all that a shape of a kind may match lies within one."""
    merged: list[list[int]] = []
    for a, b in sorted(_stretches(text)):
        last = merged[-1][1] if merged else -1
        if merged and (a <= last or a - last <= SEGMENT and _JOINT.fullmatch(text, last, a)):
            merged[-1][1] = max(last, b)
        else:
            merged.append([a, b])
    for a, b in merged:
        yield [t.span() for t in _TOKEN.finditer(text, a, b)]


def _segments(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[tuple[int, list[int]]]:
    """Features of every segment from token i on that may be an entity: (past the last token, indexes)."""
    a = tokens[i][0]
    if not (text[a].isalnum() or text[a] in "+("):
        return
    for j in range(i + 1, min(len(tokens), i + SEGMENT) + 1):
        b = tokens[j - 1][1]
        f = span_features(text, a, b) if text[b - 1].isalnum() else None
        if f and len(f) > 1 and f[1] < len(_SHAPES):  # a segment of no known shape stays outside
            yield j, f


def _lattice(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """All segments of an island: (first token, past the last) -> indexes."""
    return {(i, j): f for i in range(len(tokens)) for j, f in _segments(text, tokens, i)}


class Field:
    """A semi-Markov CRF: label 0 is outside (one token each), labels 1.. are KINDS; weights per label and
    feature, and a transition weight per pair of labels."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def scores(self, lattice):
        return {k: self.w[:, f].sum(axis=1) for k, f in lattice.items()}

    def best(self, text: str, tokens) -> list[tuple[str, int, int]]:
        """Viterbi over segments of a whole island: boundaries and kinds jointly.

        Segments and scores are held for a window of SEGMENT tokens; of the rest only the way back stays."""
        n, m = len(tokens), len(KINDS) + 1
        back, was = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int8)
        top = np.full(m, -np.inf)
        top[0] = 0.0
        reach: dict[int, np.ndarray] = {}
        ends: dict[int, list[tuple[int, np.ndarray]]] = {}
        for j in range(1, n + 1):
            i = j - 1
            ways = top[:, None] + self.t
            was[i] = ways.argmax(axis=0)  # the best label before each label of a segment that starts at i
            reach[i] = ways.max(axis=0)
            reach.pop(i - SEGMENT, None)
            for k, f in _segments(text, tokens, i):
                ends.setdefault(k, []).append((i, self.w[:, f].sum(axis=1)))
            top = np.full(m, -np.inf)
            top[0], back[j, 0] = reach[i][0], i
            for k, s in ends.pop(j, ()):
                v = reach[k][1:] + s
                better = np.flatnonzero(v > top[1:]) + 1
                top[better], back[j, better] = v[better - 1], k
        j, y, out = n, int(top.argmax()), []
        while j:
            i = int(back[j, y])
            if y:
                out.append((KINDS[y - 1], tokens[i][0], tokens[j - 1][1]))
            j, y = i, int(was[i, y])
        return out

    def learn(self, tokens, lattice, truth: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log-likelihood, by forward and backward sums over segments."""
        score = self.scores(lattice)
        n, m = len(tokens), len(KINDS) + 1
        segs = [(i, i + 1, None) for i in range(n)] + [(i, j, s) for (i, j), s in score.items()]
        f, b = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        f[0, 0], b[n, :] = 0.0, 0.0
        gain = {}
        for i, j, s in segs:
            g = np.full(m, -np.inf)
            if s is None:
                g[0] = 0.0
            else:
                g[1:] = s
            gain[i, j, s is None] = g
        for i, j, s in sorted(segs, key=lambda x: x[1]):
            f[j] = np.logaddexp(f[j], np.logaddexp.reduce(f[i][:, None] + self.t, axis=0) + gain[i, j, s is None])
        for i, j, s in sorted(segs, key=lambda x: -x[0]):
            b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.t + (gain[i, j, s is None] + b[j])[None, :], axis=1))
        z = np.logaddexp.reduce(f[n])
        dw, dt = np.zeros_like(self.w), np.zeros_like(self.t)
        for i, j, s in segs:
            with np.errstate(invalid="ignore"):
                p = np.exp(f[i][:, None] + self.t + (gain[i, j, s is None] + b[j])[None, :] - z)
            p = np.nan_to_num(p)
            dt -= p
            if s is not None:
                dw[:, lattice[i, j]] -= p.sum(axis=0)[1:, None]
        at, y = 0, 0
        while at < n:
            (i, j), k = next((x for x in truth.items() if x[0][0] == at), ((at, at + 1), 0))
            dt[y, k] += 1
            if k and (i, j) in lattice:
                dw[k - 1, lattice[i, j]] += 1
            at, y = j, k
        self.w += rate * (dw - 1e-3 * self.w)
        self.t += rate * (dt - 1e-3 * self.t)


def _examples(rng: random.Random, count: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Seeded lines with known spans, and look-alikes that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = rng.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    makers = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}.example.{word()[:3]}", lambda: f"{word()}@{word()}.com", lambda: f"{word()} (at) {word()}{digits(2)} (dot) org"],
        "ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))],
        "card": [card],
        "phone": [lambda: f"+1 ({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", lambda: f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", lambda: f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}", lambda: f"+{rng.randint(20, 99)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"0044 {digits(4)} {digits(6)}"],
        "secret": [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: "AK" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(18))],
    }
    others = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{digits(3)},{digits(3)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{digits(8)}", lambda: f"{digits(12)}", lambda: f"{digits(20)}",
        lambda: f"{digits(3)}.{rng.randint(256, 999)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"@{word()}{digits(1)}",
        lambda: f"{word()}{digits(7)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(4)} {digits(4)} {digits(4)}", lambda: f"{word()}-{digits(10)}-{word()}",
        lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}x", lambda: digits(rng.randint(1, 4)), lambda: f"{word()}{digits(2)}",
        lambda: (word() + word() + word() + word()).ljust(18, "e"), lambda: "".join(word().title() for _ in range(5)).ljust(18, "s"),
    ]
    for _ in range(count):
        text, spans = word() + " ", []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice([*KINDS, None, None, None])
            piece = rng.choice(makers[kind] if kind else others)()
            if kind == "secret" and rng.random() < 0.7:
                text += rng.choice(['token = "', "secret: ", "api_key="])
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", ". ", ", ", '" ']) + word() + rng.choice([" ", ". "])
        yield text, spans


@functools.cache
def trained(count: int = 450, epochs: int = 5, seed: int = 11) -> Field:
    """The field, trained on `count` seeded lines: the same wherever it is trained, and small (a few hundred numbers)."""
    field = Field(np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1,) * 2))
    lines = []
    for text, spans in _examples(random.Random(seed), count):
        for tokens in islands(text):
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            truth = {(starts[a], ends[b]): KINDS.index(k) + 1 for k, a, b in spans if a in starts and b in ends}
            lines.append((tokens, _lattice(text, tokens), truth))
    for epoch in range(epochs):
        for line in lines:
            field.learn(*line, 0.3 / (1 + epoch))
    return field


def find(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each in the order of KINDS and starts; added spans never overlap base ones."""
    text = text or ""
    base = base_spans(text)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    more = []
    for tokens in islands(text):
        for k, a, b in field.best(text, tokens):
            if all(b <= x or a >= y for _, x, y in base):
                more.append((k, a, b))
    return sorted(base, key=order), sorted(base + more, key=order)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans of every row, from its whole text.

    One row per input row, nothing shuffled. Null and empty texts have no spans (the digest of an empty
    string). Positions are code points, ends exclusive. Extra columns are ignored. Segments have at most
    SEGMENT tokens and islands are decoded whole, in a rolling window, so very long texts stay linear.
    """
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = {k: [] for k in KINDS[:4]}, [], []
            for t in b.column("text"):
                base, every = find(t.as_py(), field)
                kinds = [s[0] for s in base]
                for k, n in counts.items():
                    n.append(kinds.count(k))
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id"), **{f"n_{k}": pa.array(n, pa.int64()) for k, n in counts.items()}, "base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string())}
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def redacted_text(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for k, a, b in sorted(find(text, field)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with personal data in `text` masked and, where there is one, n_chars made to fit.

    Null and empty texts stay as they are; very long texts are treated whole. Repeated rows, null ids and extra
    columns pass through; no row goes or comes. Empty table: empty result.
    """
    field = trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted_text(t.as_py(), field) for t in b.column("text")]
            columns = dict(zip(names, b.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
