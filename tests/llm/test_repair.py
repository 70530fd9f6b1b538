"""Repairs against all edits of short conversations, and against a pass from the end on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

from patternlake.llm import repair as R

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, c int, n string, spot int, part int, summary string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_edit(rows):
    """The least (cost, audit) of all ways to edit a short conversation, and what they make of it."""
    gap = [p for k in range(3) for p in itertools.product("ua", repeat=k)]
    found, bad = [], faults(rows)

    def go(k, cost, audit, made):
        for extra in gap:
            c, a, m = cost + 2 * len(extra), audit + "I" * len(extra), made + [({"u": "user", "a": "assistant"}[e], "") for e in extra]
            if k == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in m)):
                    found.append((c, a, m))
                continue
            _, role, text = rows[k]
            go(k + 1, c + 3, a + "D", m)
            if bad[k] in ("blank", "duplicate"):
                continue
            more = bad[k] == "truncated"
            if role[:1] in ("s", "u", "a"):
                go(k + 1, c + more, a + "K", m + [(role, text)])
            for new in ("user", "assistant"):
                go(k + 1, c + 2 + more, a + "R", m + [(new, text)])

    go(0, 0, "", [])
    return min(found, key=lambda x: x[:2])


def from_the_end(rows):
    """The same from the last row back to the first: least (cost, rest of the audit) of each state before a row."""
    go = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    step = {"": "u", "s": "u", "a": "u", "u": "a"}
    bad = faults(rows)

    def inserts(best):
        for _ in range(2):
            best = {s: min([best[s]] if s in best else [], default=None) for s in step} | {}
            new = dict(best)
            for s, to in step.items():
                if best.get(to) is not None:
                    made = (best[to][0] + 2, "I" + best[to][1])
                    new[s] = made if best[s] is None else min(best[s], made)
            best = {s: b for s, b in new.items() if b is not None}
        return best

    best = inserts({"": (0, ""), "a": (0, "")})
    for (_, role, _), fault in zip(reversed(rows), reversed(bad)):
        new = {}
        for s in step:
            made = []
            if s in best:
                made.append((best[s][0] + 3, "D" + best[s][1]))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                to = go.get(role[:1], {}).get(s)
                if to in best:
                    made.append((best[to][0] + more, "K" + best[to][1]))
                if step[s] in best:
                    made.append((best[step[s]][0] + 2 + more, "R" + best[step[s]][1]))
            if made:
                new[s] = min(made)
        best = inserts(new)
    return best[""]


def made_of(rows, audit):
    out, rest = [], iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(rest)[1:]
        if e in "IR":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e != "D":
            out.append((role, text))
    return out


def row_of(rows):
    cost, audit = from_the_end(rows)
    bad, turns = faults(rows), [n for n, _, _ in rows if n is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in made_of(rows, audit))
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(table):
    out = {}
    for c, n, role, text in table:
        out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out[c] += [(n, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return {c: sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2])) for c, rows in out.items()}


def test_every_short_conversation():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(k, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "admin", ""]), rng.choice(["a.", "b!", "c", "", " \t", "a."])) for k in range(rng.randint(0, 3))]
        counts, audit, turns = R.solved(rows) if rows else ({"cost": 0}, "", [])
        cost, want, made = every_edit(rows)
        assert (counts["cost"], audit, turns) == (cost, want, made), rows
        assert from_the_end(rows) == (cost, want)


def test_long_conversations_are_solved_in_steps():
    rng = random.Random(5)
    for n in (100, 700, 3000):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool"]) if rng.random() < 0.5 else ("user", "assistant")[k % 2], f"{k}{rng.choice('..x')}") for k in range(n)]
        counts, audit, turns = R.solved(rows)
        assert (counts["cost"], audit) == from_the_end(rows) and turns == made_of(rows, audit)
    rows = [(k, "system", f"{k}.") for k in range(20_000)]
    # every second one becomes the assistant's, in time that doesn't grow with the square
    assert R.solved(rows)[0]["cost"] == 2 * 20_000 - 1 and from_the_end(rows[:3000])[0] == 2 * 3000 - 1


def query(spark, rows, parts=4):
    talk = spark.createDataFrame([(*r, 1, "n", 2, 3, "s") for r in rows], SCHEMA).repartition(parts)
    summary, turns = R.repair(R.damage(talk) if parts else talk)
    every = talk.select("conv_id").distinct()
    return {r[0]: tuple(r)[1:] for r in R.with_all(every, summary, R.digests(turns, "conv_id")).collect()}


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in R.op12_turn_repair(spark, FOLDER).collect()}
    assert got == {c: row_of(rows) for c, rows in damaged(table).items()}


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    big = [(7, k // 2, rng.choice(roles), rng.choice([f"text {k}.", "again.", "", f"cut {k}", f"{k % 50} is long. " * 30])) for k in range(6000)]
    same = [(8, 3, "user", "alike.")] * 3000
    few = [(c, k, ("user", "assistant")[k % 2], f"{c} {k}.") for c in range(40) for k in range(4) if c not in (7, 8)]
    nulls = [(9000, None, "assistant", f"{k}.") for k in range(50)]
    rows = big + same + few + nulls
    assert query(spark, rows) == {c: row_of(r) for c, r in damaged(rows).items()}


def test_defined_results(spark):
    rows = [
        (None, 0, "user", "a."), (None, 1, None, "b."), (1, None, "user", None), (1, None, "system", "s."), (2, 0, "user", ""), (3, 0, "user", "same."),
        (3, 0, "user", "same."), (3, 0, "user", "same."), (4, 5, "", "é."), (5, 0, "user", "word " * 600_000), (5, 1, "assistant", "x?"), (6, -3, "assistant", "y"),
    ]
    dropped = next(c for c in range(100, 999) if all(zlib.crc32(f"{c}:{k}".encode()) % 20 == 0 for k in (0,)))
    rows.append((dropped, 0, "user", "gone."))
    got = query(spark, rows)
    assert got == {c: row_of(r) for c, r in damaged(rows).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert query(spark, []) == {}


def test_repaired_turns_are_real_rows(spark):
    rows = [("x", 0, "assistant", "a."), ("x", 1, "assistant", "b."), ("y", 0, "user", "c.")]
    summary, turns = R.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r.conv_id: r.audit for r in summary.collect()} == {"x": "RK", "y": "KI"}
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in turns.collect()} == {
        "x": [("user", "a."), ("assistant", "b.")],
        "y": [("user", "c."), ("assistant", "")],
    }
