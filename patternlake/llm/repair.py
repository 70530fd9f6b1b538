"""Repair of the structure of conversations, at least cost.

A conversation is a system turn or none, then pairs of a user's and an assistant's turns. A
Viterbi pass over its rows carries, for each of the grammar's four states, the least (cost,
audit string), where the audit has an initial for each edit: Keep (0), Rerole to user or
assistant (2), Delete (3, the only edit of blank and repeated rows), Insert of an empty
turn (2). Each row's layer is closed by two rounds of inserts, which is all that can help:
from any state two inserts reach every state that inserts reach. A kept or reroled row that
is cut off costs 1 more. Two audits of equal cost at one layer are never a prefix of one
another, so what is less stays less, and the audit alone fixes the repair.

How it is dealt: rows are sorted by conversation in ranges, so that a conversation of any
size may go over many tasks. One that lies inside a range is repaired there. Those at a
range's edges, whose other rows may be elsewhere, are taken in stretches of STRETCH rows: a
stretch is solved for every state it may be entered in, the solutions are chained, and each
stretch is written anew by the edits chosen for it. Only (cost, audit) of stretches are
chained in one task, as the audit of a conversation is one value.

Defined results: null roles and texts are one blank; rows go by turn, null turns first, then
role, the text's first 64 characters and its hash; a null conversation id is one conversation;
repeated rows of one turn are repeats, of which the first is kept; roles count by their first
character, so that others than s, u and a can't be kept; an empty table has no conversations;
texts are told apart by 128 bits and never read in part; columns of other names are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written
from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a user's or an assistant's turn leads to.
TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
STRETCH = 512
FINE, CUT, GONE = range(3)  # no fault; cut off; blank or repeated
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Best = tuple[int, str]


# The pass over rows -------------------------------------------------------------------


class Viterbi:
    """The best (cost, audit) of each state after the rows so far; what all of them share is put aside."""

    def __init__(self, state: int = START, closed: bool = False):
        self.aside: list[str] = []
        self.layer: list[Best | None] = [None] * 4
        self.layer[state] = (0, "")
        if not closed:
            self._close()

    def _close(self) -> None:
        for _ in range(2):
            for state, best in enumerate(self.layer[:]):
                if best is not None:
                    self._offer(self.layer, TURN[state], (best[0] + 2, best[1] + "I"))

    @staticmethod
    def _offer(layer: list[Best | None], state: int, made: Best) -> None:
        if layer[state] is None or made < layer[state]:
            layer[state] = made

    def row(self, initial: str, fault: int) -> None:
        new: list[Best | None] = [None] * 4
        kept, more = KEEP.get(initial, {}), int(fault == CUT)
        for state, best in enumerate(self.layer):
            if best is None:
                continue
            cost, audit = best
            self._offer(new, state, (cost + 3, audit + "D"))
            if fault != GONE:
                if state in kept:
                    self._offer(new, kept[state], (cost + more, audit + "K"))
                self._offer(new, TURN[state], (cost + 2 + more, audit + "R"))
        self.layer = new
        self._close()
        self._drop()

    def _drop(self) -> None:
        """States that can't win go: after an assistant all is open that is after the start or a system turn, but for
        keeping a system turn, instead of which it can be deleted."""
        end = self.layer[ASSISTANT]
        if end is not None:
            for state, most in ((START, end[0] + 3), (SYSTEM, end[0])):
                if self.layer[state] is not None and self.layer[state][0] > most:
                    self.layer[state] = None
        alive = [b[1] for b in self.layer if b is not None]
        if min(map(len, alive)) > 64:
            shared = commonprefix(alive)
            if len(shared) > 32:
                self.aside.append(shared)
                self.layer = [b and (b[0], b[1][len(shared) :]) for b in self.layer]

    def exits(self) -> list[tuple[int, int, str]]:
        """(state, cost, whole audit) of the states left."""
        before = "".join(self.aside)
        return [(state, b[0], before + b[1]) for state, b in enumerate(self.layer) if b is not None]


def best_audit(exits: Iterable[tuple[int, int, str]]) -> Best:
    return min((cost, audit) for state, cost, audit in exits if state in (START, ASSISTANT))


def edited(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits make of rows, entered in `state`."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            state = KEEP[role[:1]][state]
        else:
            state = TURN[state]
            role = "user" if state == USER else "assistant"
        yield role, text


def fault_of(text: str, seen: bool) -> str:
    """blank, duplicate, truncated or empty: the first that holds."""
    end = text.rstrip(BLANK)[-1:]
    return "blank" if not end else "duplicate" if seen else "truncated" if end not in ".!?" else ""


class Tally:
    """Counts over rows in order, which add up over stretches."""

    def __init__(self) -> None:
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first: tuple | None = None  # initial and turn of the first row
        self.last: tuple | None = None
        self.low: int | None = None

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.n[fault] += 1
        self.add_edge(turn, initial)
        self.turns += turn is not None and (self.last is None or self.last[1] != turn)
        self.low = turn if self.low is None else self.low
        self.last = (initial, turn)

    def add_edge(self, turn: int | None, initial: str) -> None:
        if self.last is None:
            self.first = (initial, turn)
        else:
            self.illegal += self.last[0] + initial not in ("su", "ua", "au")

    def then(self, other: Tally) -> None:
        """Add the tally of the rows that follow."""
        for k, v in other.n.items():
            self.n[k] += v
        self.add_edge(other.first[1], other.first[0])
        self.illegal += other.illegal
        self.turns += other.turns - (self.last is not None and self.last[1] is not None and self.last[1] == other.first[1])
        self.low = other.low if self.low is None else self.low
        self.last = other.last

    def counts(self, cost: int) -> dict[str, int]:
        gaps = 0 if self.low is None else self.last[1] - self.low + 1 - self.turns
        return {"gaps": gaps, **self.n, "illegal": self.illegal, "cost": cost}


def solved(rows: list[tuple[int | None, str, str]]) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """Counts, audit and repaired turns of one whole conversation (turn, role, text) in order."""
    tally, path, seen = Tally(), Viterbi(), set()
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        tally.row(turn, role[:1], fault)
        path.row(role[:1], _weight(fault))
    cost, audit = best_audit(path.exits())
    return tally.counts(cost), audit, list(edited([r[1:] for r in rows], audit))


def _weight(fault: str) -> int:
    return GONE if fault in ("blank", "duplicate") else CUT if fault else FINE


# Dealt over tasks ---------------------------------------------------------------------

_TURNS = "array<struct<role:string,text:string>>"
_SUMMARY = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",audit:string>"
_ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ARROW_SUMMARY = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])


def _batch(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], [n for n, _ in fields])


def _told(turns: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in turns]


def _by_edges(kind: pa.DataType):
    """Sorted rows (c, n, r, t): conversations inside the partition solved, rows of its first and last one with a spot."""
    fields = [("c", kind), ("spot", pa.int64()), ("n", pa.int64()), ("r", pa.string()), ("t", pa.string()), ("summary", _ARROW_SUMMARY), ("turns", _ARROW_TURNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, current, number, held = TaskContext.get().partitionId() << 33, None, 0, []
        for batch in batches:
            out = []
            for c, n, r, t in zip(*[batch[k].to_pylist() for k in "cnrt"]):
                if number == 0 or c != current:
                    if number > 1:
                        counts, audit, turns = solved([h[1:] for h in held])
                        out.append({"c": current, "summary": counts | {"audit": audit}, "turns": _told(turns)})
                    current, number, held = c, number + 1, []
                if number == 1:
                    out.append({"c": c, "spot": spot, "n": n, "r": r, "t": t})
                else:
                    held.append((spot, n, r, t))
                spot += 1
            yield _batch(out, fields)
        for a in range(0, len(held), 1000):  # the last conversation, unless it is the first
            yield _batch([{"c": current, "spot": s, "n": n, "r": r, "t": t} for s, n, r, t in held[a : a + 1000]], fields)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with one key; a run is held as a whole."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


_EXITS = "array<struct<entry:int,state:int,cost:bigint,audit:string>>"
_ARROW_EXITS = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_TALLY = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "first_turn", "last_turn")


def _stretches(kind: pa.DataType):
    """Rows of a stretch (c, stretch, spot, n, a, f): its tally, and the best edits for each state it may be entered in."""
    fields = [("c", kind), ("stretch", pa.int64()), *[(x, pa.int64()) for x in _TALLY], ("a", pa.string()), ("z", pa.string()), ("exits", _ARROW_EXITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, stretch), rows in _grouped(batches, ("c", "stretch")):
            tally = Tally()
            paths = [Viterbi(state, closed=True) for state in range(4)]
            for r in rows:
                tally.row(r["n"], r["a"], r["f"])
                for path in paths:
                    path.row(r["a"], _weight(r["f"]))
            exits = [{"entry": e, "state": s, "cost": cost, "audit": audit} for e, p in enumerate(paths) for s, cost, audit in p.exits()]
            edge = {"a": tally.first[0], "z": tally.last[0], "first_turn": tally.first[1], "last_turn": tally.last[1]}
            yield _batch([{"c": c, "stretch": stretch, **tally.n, "illegal": tally.illegal, "turns": tally.turns, "low": tally.low, **edge, "exits": exits}], fields)

    return run


def _tally_of(row: dict) -> Tally:
    tally = Tally()
    tally.n = {k: row[k] for k in tally.n}
    tally.illegal, tally.turns, tally.low = row["illegal"], row["turns"], row["low"]
    tally.first, tally.last = (row["a"], row["first_turn"]), (row["z"], row["last_turn"])
    return tally


def _chained(kind: pa.DataType):
    """Stretches of a conversation in order: the edits of each (stretch, entry, audit), and the whole's summary."""
    fields = [("c", kind), ("stretch", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()), ("summary", _ARROW_SUMMARY)]

    def finish(c, tally: Tally, layer: dict) -> pa.RecordBatch:
        cost, audit, path = min((layer[s] for s in (START, ASSISTANT) if s in layer), key=lambda b: b[:2])
        out = []
        while path is not None:
            path, stretch, entry, part = path
            out.append({"c": c, "stretch": stretch, "entry": entry, "audit": part})
        return _batch([*out, {"c": c, "summary": tally.counts(cost) | {"audit": audit}}], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally, layer, begun = None, Tally(), {}, False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["c"] != current:
                    if begun:
                        yield finish(current, tally, layer)
                    # inserts before the first row belong to the first stretch
                    current, tally, begun = row["c"], Tally(), True
                    layer = {s: (cost, audit, None) for s, cost, audit in Viterbi().exits()}
                    lead = {s: audit for s, (_, audit, _) in layer.items()}
                tally.then(_tally_of(row))
                new: dict[int, tuple] = {}
                for x in row["exits"]:
                    if x["entry"] in layer:
                        cost, audit, path = layer[x["entry"]]
                        made = (cost + x["cost"], audit + x["audit"])
                        if x["state"] not in new or made < new[x["state"]][:2]:
                            step = (path, row["stretch"], x["entry"], x["audit"]) if path is not None else (None, row["stretch"], START, lead[x["entry"]] + x["audit"])
                            new[x["state"]] = (*made, step)
                layer = new
        if begun:
            yield finish(current, tally, layer)

    return run


def _rewritten(kind: pa.DataType):
    """Rows of a stretch after its edits (the row that has an audit): its repaired turns."""
    fields = [("c", kind), ("stretch", pa.int64()), ("turns", _ARROW_TURNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, stretch), (edits, *rows) in _grouped(batches, ("c", "stretch")):
            turns = list(edited([(r["r"], r["t"]) for r in rows], edits["audit"], edits["entry"]))
            yield _batch([{"c": c, "stretch": stretch, "turns": _told(turns)}], fields)

    return run


def _arrow_kind(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kind = df.schema[column].dataType.simpleString()
    return kind, kinds[kind]


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: for each conversation `conv`, the counts and the audit; and its repaired turns, (conv, part, whole, turns).

    Parts are in the order of part; a conversation has one, which is whole, or one for each stretch of its rows.
    `conv` is a whole number or a string.
    """
    text_of, role_of = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    rows = df.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("n"), role_of.alias("r"), text_of.alias("t"))
    kind, arrow = _arrow_kind(rows, "c")
    order = ["c", "n", "r", "p", "h"]
    keyed = rows.withColumn("p", F.substring("t", 1, 64)).withColumn("h", F.xxhash64("t"))
    # rows alike in all are dealt by the last key
    ranged = keyed.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    first = written(ranged.select("c", "n", "r", "t").mapInArrow(_by_edges(arrow), f"c {kind}, spot long, n long, r string, t string, summary {_SUMMARY}, turns {_TURNS}"), "conversations")
    inside, edge = first.where("summary IS NOT NULL"), first.where("spot IS NOT NULL").select("c", F.shiftright("spot", 9).alias("stretch"), "spot", "n", "r", "t")

    # a text's first row is found by partial sums and met by its spot
    seen = edge.groupBy("c", "r", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")).agg(F.min("spot").alias("spot")).select("spot", F.lit(True).alias("new"))
    end = F.substring(F.rtrim(F.col("t"), F.lit(BLANK)), -1, 1)
    narrow = edge.select("c", "stretch", "spot", "n", F.substring("r", 1, 1).alias("a"), end.alias("end"))
    fault = F.when(F.col("end") == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    flagged = narrow.join(seen, "spot", "left").select("c", "stretch", "spot", "n", "a", fault.alias("f"))
    dealt = flagged.repartition("c", "stretch").sortWithinPartitions("c", "stretch", "spot")
    tallies = ", ".join(f"{x} long" for x in _TALLY)
    parts = dealt.mapInArrow(_stretches(arrow), f"c {kind}, stretch long, {tallies}, a string, z string, exits {_EXITS}")
    chain = parts.repartition("c").sortWithinPartitions("c", "stretch")
    chosen = written(chain.mapInArrow(_chained(arrow), f"c {kind}, stretch long, entry int, audit string, summary {_SUMMARY}"), "edits")

    edits = chosen.where("stretch IS NOT NULL").select("c", "stretch", F.lit(-1).cast("long").alias("spot"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("t"), "entry", "audit")
    texts = edge.select("c", "stretch", "spot", "r", "t", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit"))
    both = texts.unionByName(edits).repartition("c", "stretch").sortWithinPartitions("c", "stretch", "spot")
    anew = both.mapInArrow(_rewritten(arrow), f"c {kind}, stretch long, turns {_TURNS}")

    summary = inside.select("c", "summary").unionByName(chosen.where("summary IS NOT NULL").select("c", "summary"))
    turns = inside.select("c", F.lit(0).cast("long").alias("part"), F.lit(True).alias("whole"), "turns")
    turns = turns.unionByName(anew.select("c", F.col("stretch").alias("part"), F.lit(False).alias("whole"), "turns"))
    return summary.select(F.col("c").alias(conv), "summary.*"), turns.withColumnRenamed("c", conv)


def digests(turns: DataFrame, conv: str) -> DataFrame:
    """`conv`, repaired_sha256: of `role:text` lines of all its parts. Where there are several, they go one by one through one digest."""
    kind, arrow = _arrow_kind(turns, conv)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    told = turns.where(F.size("turns") > 0).select(F.col(conv).alias("c"), "part", "whole", lines.alias("lines"))
    fields = [("c", arrow), ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            out = []
            for c, text in zip(batch["c"].to_pylist(), batch["lines"].to_pylist()):
                if digest is None or c != current:
                    if digest is not None:
                        out.append({"c": current, "repaired_sha256": digest.hexdigest()})
                    current, digest = c, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            yield _batch(out, fields)
        if digest is not None:
            yield _batch([{"c": current, "repaired_sha256": digest.hexdigest()}], fields)

    parts = told.where("NOT whole").repartition("c").sortWithinPartitions("c", "part").select("c", "lines")
    at_once = told.where("whole").select("c", F.sha2("lines", 256).alias("repaired_sha256"))
    return at_once.unionByName(parts.mapInArrow(run, f"c {kind}, repaired_sha256 string")).withColumnRenamed("c", conv)


# The query ----------------------------------------------------------------------------


def damage(df: DataFrame) -> DataFrame:
    """conversations, damaged by the hash of id and turn: dropped, emptied, cut off, repeated, or made the user's."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k")).where("k != 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, turns = repair(damage(talk))
    every = talk.select("conv_id").distinct()
    return with_all(every, summary, digests(turns, "conv_id"))


def with_all(every: DataFrame, summary: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row for each id of `every`; ids without rows have zeros, no edits and the digest of nothing."""
    out = every
    for other in (summary, hashes):
        named = other.withColumnRenamed("conv_id", "id_")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("id_")), "left").drop("id_")
    counts: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
