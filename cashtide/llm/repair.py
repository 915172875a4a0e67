"""Repairs the structure of conversations with the fewest edits, and damages them on purpose for tests.

The edits of a row are one macro: up to two inserts and then what happens to the row. Macros have codes that are free
of prefixes and numbered in the order of their texts, so audits of equally many rows compare as their lists of numbers,
and a path needs no text: each layer keeps, for each state, a cost, the rank of its audit among the layer's, and a
pointer to the state before. The audit is spelled out at the end, backwards.

Rows are sorted over all partitions. Conversations that lie within one partition are repaired there; those at the
edges of partitions, long ones among them, leave one byte a row for the search, and their texts meet only to be hashed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, saved

#: States of the pattern (s?(ua)+)?: nothing yet, behind s, behind u, behind a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: What becomes of a row: it must go, it is unfinished, or it is whole. A row's kind is one letter for its initial (s,
#: u, a or any other) and one of these.
GONE, CUT, WHOLE = range(3)
INITIALS, KINDS = "sua?", "ABCDEFGHIJKL"
#: Characters of a text that choose its partition.
PREFIX = 64
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


def _inserted() -> list[tuple[int, int, str]]:
    """(state, state after, inserts) of runs of up to two inserts; longer runs come back to a state at more cost."""
    runs = [(s, s, "") for s in range(4)]
    for _ in range(2):
        runs += [(a, NEXT[b, x], run + "I") for a, b, run in runs for x in "ua" if (b, x) in NEXT]
    return sorted(set(runs))


def _macros(kind: str) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, code) of all macros for a row of this kind."""
    initial, fate = INITIALS[KINDS.index(kind) // 3], KINDS.index(kind) % 3
    extra, out = UNFINISHED * (fate == CUT), []
    for a, b, run in _inserted():
        cost = INSERT * len(run)
        out.append((a, b, cost + DELETE, run + "D"))
        if fate != GONE:
            if (b, initial) in NEXT:
                out.append((a, NEXT[b, initial], cost + KEEP + extra, run + "K"))
            out += [(a, NEXT[b, x], cost + REROLE + extra, run + "R") for x in "ua" if (b, x) in NEXT]
    return out


#: All codes in the order of their texts; the last row is followed by a run of inserts and the end.
CODES = sorted(x + y for x in ("", "I", "II") for y in "DKR")
ENDS = ["", "I", "II"]


@lru_cache(maxsize=None)
def _layer(kind: str) -> list[list[tuple[int, int, int]]]:
    """By state after: (state, cost, number of the code), the cheapest and then first code for each pair of states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b, cost, code in _macros(kind):
        best[a, b] = min(best.get((a, b), (1 << 30, 0)), (cost, CODES.index(code)))
    return [[(a, *best[a, b]) for a in range(4) if (a, b) in best] for b in range(4)]


def cheapest(kinds: str) -> tuple[int, list[str], list[int]]:
    """(cost, code of each row and of the end, state before each of them) of the cheapest repair; of several, that of
    the smallest audit. Linear in the rows, four states a layer; codes and pointers are one byte each."""
    costs, ranks = [0, None, None, None], [0, 0, 0, 0]
    pointers, taken = bytearray(), bytearray()
    for kind in kinds:
        found = [min(((costs[a] + c, ranks[a], code, a) for a, c, code in ways if costs[a] is not None), default=None) for ways in _layer(kind)]
        order = {key: i for i, key in enumerate(sorted({x[1:3] for x in found if x}))}
        costs = [x and x[0] for x in found]
        ranks = [order[x[1:3]] if x else 0 for x in found]
        pointers += bytes(x[3] if x else 0 for x in found)
        taken += bytes(x[2] if x else 0 for x in found)
    ends = [(costs[a] + INSERT * len(run), ranks[a], ENDS.index(run), a) for a, b, run in _inserted() if costs[a] is not None and b in (NOTHING, ASSISTANT)]
    cost, _, end, state = min(ends)
    codes, states = [ENDS[end]], [state]
    for i in range(len(kinds) - 1, -1, -1):
        codes.append(CODES[taken[4 * i + state]])
        state = pointers[4 * i + state]
        states.append(state)
    return cost, codes[::-1], states[::-1]


#: Short conversations are alike in kinds: most of them are looked up.
_cheapest_short = lru_cache(maxsize=1 << 14)(cheapest)


def solved(kinds: str) -> tuple[int, list[str], list[int]]:
    return _cheapest_short(kinds) if len(kinds) <= 16 else cheapest(kinds)


def repaired(code: str, state: int, role: str, text: str) -> Iterator[str]:
    """`role:text` of what a macro leaves, from the state before it."""
    for x in code:
        turn = "assistant" if state == USER else "user"
        if x != "D":
            yield f"{turn}:" if x == "I" else f"{turn}:{text}" if x == "R" else f"{role}:{text}"
            state = state_after(x, state, role)


def state_after(code: str, state: int, role: str) -> int:
    for x in code.replace("D", ""):
        state = NEXT[state, "s" if x == "K" and role[:1] == "s" else "a" if state == USER else "u"]
    return state


def kind_of(role: str, text: str, again: bool) -> tuple[str, str]:
    """(kind, fault) of a row; `again`: its role and text were there before. An empty role is as any other one."""
    said = text.strip(BLANKS)
    fault = "blank" if not said else "duplicate" if again else "truncated" if said[-1] not in ".!?" else ""
    fate = GONE if fault in ("blank", "duplicate") else CUT if fault else WHOLE
    return KINDS[3 * (INITIALS.index(role[0]) if role and role[0] in "sua" else 3) + fate], fault


def illegal(kinds: str) -> int:
    """Adjacent rows whose initials do not follow each other."""
    initials = [INITIALS[KINDS.index(k) // 3] for k in kinds]
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "conv_id long, turn long, role string, text string, n long"


def damage(conversations: DataFrame) -> DataFrame:
    """ROW rows (equal ones once, n times) after damage by crc32 of `conv_id:turn`, and one row of n = 0 for each
    conversation. Nulls are one blank, also in that text. Extra columns are ignored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    harmed = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )
    there = F.col("n") > 0
    return (
        harmed.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("n").cast("long").alias("n"))
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted over all partitions by conversation, turn (nulls first), role and text; the row of n = 0 comes first."""
    keys = ["conv_id", F.coalesce(F.col("n"), F.lit(0)) > 0, "turn", "role"]
    return rows.repartitionByRange(*keys, F.substring("text", 1, PREFIX)).sortWithinPartitions(*keys, "text")


EDGE = "piece long, seq long, conv_id long, turn long, role string, text string, n long"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT rows of the conversations that lie within the partition, and the rows (EDGE) of its first and last one,
    which may go on in other partitions."""
    piece = TaskContext.get().partitionId()
    names = [c.split()[0] for c in f"{RESULT}, {EDGE}".split(", ")]
    names = list(dict.fromkeys(names))
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256", "role", "text") else pa.int64()) for n in names])

    def sent(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)

    first, of, rows, seq = True, None, [], 0

    def edge(held: list[tuple]) -> list[dict]:
        return [{"piece": piece, "seq": seq + i, "conv_id": of[0], "turn": t, "role": r, "text": x, "n": n} for i, (t, r, x, n) in enumerate(held)]

    for b in batches:
        out = []
        for conv, *row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n")], strict=True):
            if of is not None and conv != of[0]:
                if first:
                    out += edge(rows)
                    first, seq = False, seq + len(rows)
                else:
                    out.append({"conv_id": of[0], **_whole(rows)})
                rows = []
            of = (conv,)
            rows.append(tuple(row))
        if first and rows:  # the first conversation of a partition goes on to the second pass as it comes
            out += edge(rows)
            seq, rows = seq + len(rows), []
        if out:
            yield sent(out)
    if rows:
        yield sent(edge(rows))


def _whole(rows: list[tuple]) -> dict:
    """RESULT of one conversation's rows (turn, role, text, n) in order, but its id."""
    out, seen, kinds, spread, turns = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), "", [], []
    for turn, role, text, n in rows:
        if not n:
            continue
        kind, fault = kind_of(role, text, (role, text) in seen)
        more, copy = kind_of(role, text, True)
        seen.add((role, text))
        for what, k in ((fault, 1), (copy, n - 1)):
            if what:
                out[what] += k
        kinds += kind + more * (n - 1)
        spread += [(role, text)] * n
        turns += [turn] * (turn is not None)
    cost, codes, states = solved(kinds)
    lines = [x for code, s, (role, text) in zip(codes, states, [*spread, ("", "")], strict=True) for x in repaired(code, s, role, text)]
    gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, **out, "illegal": illegal(kinds), "cost": cost, "audit": "".join(codes), "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()}


def _at_edges(edge: DataFrame) -> DataFrame:
    """RESULT of conversations given as EDGE rows, however long."""
    rows = edge.where("n > 0")
    first = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("piece", "seq")).alias("first"), F.count("*").alias("k")).where("k > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("r"), F.col("text").alias("x"), "first")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("x")), "left")
    said = F.btrim("text", F.lit(BLANKS))
    again = F.coalesce(F.struct("piece", "seq") > F.col("first"), F.lit(False))
    fault = F.when(said == "", "blank").when(again, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    copy = F.when(said == "", "blank").otherwise("duplicate")
    letter = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 3).when(F.col("role").startswith("a"), 6).otherwise(9)
    fate = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(WHOLE)
    kind = lambda f: F.substring(F.lit(KINDS), letter + f + 1, F.lit(1))
    rows = met.withColumns({"fault": fault, "copy": copy})
    rows = saved(rows.select(*edge.columns, "fault", "copy", F.concat(kind(fate), F.repeat(kind(F.lit(GONE)), (F.col("n") - 1).cast("int"))).alias("kinds")))
    count = lambda what: (F.sum(F.when(F.col("fault") == what, 1).otherwise(0)) + F.sum(F.when(F.col("copy") == what, F.col("n") - 1).otherwise(0))).alias(what)
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *[count(x) for x in ("blank", "duplicate", "truncated")]
    )
    runs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kinds"))), lambda x: x["kinds"]), ",")
    pieces = rows.groupBy("conv_id", "piece").agg(F.min("seq").alias("seq"), runs.alias("runs"))
    each = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "seq", "runs"))).alias("pieces"))
    fields = "conv_id long, piece long, seq long, code string, state int, cost long, illegal long, audit string"

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, held in ((r["conv_id"], r["pieces"]) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            runs = [(p["piece"], p["seq"] + i, len(run)) for p in held for i, run in enumerate(p["runs"].split(","))]
            kinds = "".join(p["runs"].replace(",", "") for p in held)
            cost, codes, states = solved(kinds)
            at, rows = 0, []
            for piece, seq, n in runs:
                rows.append({"conv_id": conv, "piece": piece, "seq": seq, "code": ",".join(codes[at : at + n]), "state": states[at]})
                at += n
            last = {"conv_id": conv, "piece": runs[-1][0], "seq": runs[-1][1] + 1, "code": codes[-1], "state": states[-1]}
            rows.append(last | {"cost": cost, "illegal": illegal(kinds), "audit": "".join(codes)})
            kinds_of = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            schema = pa.schema([(n, kinds_of[k]) for n, k in (f.split() for f in fields.split(", "))])
            for i in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in rows[i : i + (1 << 14)]], schema)

    texts = rows.select(F.col("piece").alias("p"), F.col("seq").alias("s"), "role", "text")
    plan = each.mapInArrow(edits, fields)
    laid = plan.join(texts, (F.col("piece") == F.col("p")) & (F.col("seq") == F.col("s")), "left").drop("p", "s")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, empty = hashlib.sha256(), True
        for b in batches:
            out = []
            for r in b.to_pylist():
                state = r["state"]
                for code in r["code"].split(","):
                    for line in repaired(code, state, r["role"] or "", r["text"] or ""):
                        digest.update(b"" if empty else b"\n")
                        digest.update(line.encode("utf-8", "surrogatepass"))
                        empty = False
                    state = state_after(code, state, r["role"] or "")
                if r["audit"] is not None:
                    out.append({"conv_id": r["conv_id"], "cost": r["cost"], "illegal": r["illegal"], "audit": r["audit"], "repaired_sha256": digest.hexdigest()})
                    digest, empty = hashlib.sha256(), True
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    told = laid.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "seq").mapInArrow(hashes, "conv_id long, cost long, illegal long, audit string, repaired_sha256 string")
    told = told.withColumnRenamed("conv_id", "of")
    some = counts.join(told, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    names = [c.split()[0] for c in RESULT.split(", ")]
    none = edge.groupBy("conv_id").agg(F.max("n").alias("n")).where("n = 0")
    zeros = {n: F.lit(0).cast("long") for n in names[1:7]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return some.select(*names).unionByName(none.withColumns(zeros).select(*names))


def repair(conversations: DataFrame) -> DataFrame:
    """Damages and repairs every conversation: RESULT, one row for each original conv_id, the null one included.

    Rows of a conversation are taken by turn (nulls first), then role, then text; null roles and texts are one blank,
    and so are null ids and turns in the text that chooses the damage. A role is judged by its first character; an
    empty role is none of s, u, a. Repeated rows are rows; equal ones of a turn travel once with their number. Texts
    are whole. An empty table gives no rows; extra columns are ignored. A conversation without rows after damage has
    zeros, an empty audit and the hash of nothing."""
    out = saved(in_order(damage(conversations)).mapInArrow(_passed, ", ".join(dict.fromkeys(f"{RESULT}, {EDGE}".split(", ")))))
    names = [c.split()[0] for c in RESULT.split(", ")]
    edge = out.where("piece is not null").select(*[c.split()[0] for c in EDGE.split(", ")])
    return out.where("piece is null").select(*names).unionByName(_at_edges(edge))
