import hashlib
import re
from collections import Counter

import duckdb
import pytest

from patternlake.llm import chat, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again)


CASES = [None, "", " \n\t", "a b a b a b", "x\nx\nx y\n\n", "a b c d a b c e a b c", "é ü 👍 # $", "w " * 400, "   ", "a  b\x0bc"]


def test_measures(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(CASES)] + [(3, CASES[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = quality.op1_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == len(CASES) + 1
    for r in rows:
        n, chars, symbols, dup, again = measured(CASES[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["kept"] and r["base_failed"])


def test_cascade(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = spark.createDataFrame([(1, good, "a"), (2, "few", None), (3, "9 " * 80, "b"), (4, None, "c"), (1, good, "a")], "doc_id long, text string, rejected_by string")
    assert [r["doc_id"] for r in quality.keep(rows).collect()] == [1, 1] and quality.keep(rows).columns == rows.columns
    assert quality.keep(rows.limit(0)).count() == 0
    told = {r["doc_id"]: r["why"] for r in quality.cascade(rows, verdict_col="why").collect()}
    assert told[1] is None and told[2] == "few_words" and told[3] in ("repeats", "no_letters", "short_words")


def test_long_text(spark, tmp_path):
    text = " ".join(f"w{k % 70_000}" for k in range(150_000)) + "\n" + "x" * 1_000_000
    spark.createDataFrame([(1, text), (2, "a b c " * 60_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in quality.op1_quality_rules(spark, str(tmp_path)).collect()}
    assert rows[1]["n_words"] == 150_001 and rows[1]["n_repeat_words"] == measured(text)[4]
    assert rows[2]["n_repeat_words"] == 180_000 and rows[2]["base_failed"]


def test_estimates(spark):
    """Shares of the sample, and costs without that of a job: what the rules have at hand costs least."""
    good = " ".join(f"word{k}" for k in range(400))
    docs = spark.createDataFrame([(good,)] * 150 + [("few",)] * 50 + [("y" * 60_000,)], "text string")
    rules = quality.default_rules()
    plain = {e.name: e for e in quality.estimate(docs, rules)}
    assert 0.1 < plain["few_words"].rejected < 0.4 and plain["symbols"].rejected == 0 and set(plain) == {r.name for r in rules}
    assert plain["repeats"].seconds > plain["symbols"].seconds
    known = {e.name: e for e in quality.estimate(docs, rules, known=quality.RETURNED)}
    assert known["repeats"].rejected == plain["repeats"].rejected and known["repeats"].seconds < plain["repeats"].seconds


def test_order():
    rules = quality.default_rules()[:3]
    found = [quality.Estimate(r.name, x, s) for r, x, s in zip(rules, (0.1, 0.4, 0.4), (1.0, 1.0, 4.0), strict=True)]
    assert [r.name for r in quality.ordered(rules, found)] == [rules[1].name, rules[0].name, rules[2].name]


TALK = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a \\ b [\\INST] <s> <\\s>"), (1, 2, "tool]\n", "x [/ROLE]"), (2, 0, None, None),
    (2, 1, "assistant", "<<SYS>> é\\"), (2, 2, "system", " <</SYS>"), (None, 5, "assistant", ""), (None, None, "user", "\n"), (3, 0, "user", "same"), (3, 0, "user", "same"),
    (4, 0, "assistant", "[INS"), (4, 1, "user", "T] [/INST"), (5, 0, "assistant", "<</s>\\\n"), (5, 1, "assistant", "x" * 50_000 + " </s>"),
]


@pytest.fixture(scope="module")
def formatted(spark):
    rows = spark.createDataFrame([(*t, "z") for t in TALK], "conv_id long, turn long, role string, text string, formatted string")
    return {r["conv_id"]: r for r in chat.chat_format(rows).collect()}


def test_round_trip(formatted):
    assert set(formatted) == {1, 2, 3, 4, 5, None}
    for conv, r in formatted.items():
        turns = sorted(((n is not None, n, role or "", text or "") for c, n, role, text in TALK if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, _, role, text in turns]


def test_mask(formatted):
    for r in formatted.values():
        at, parts = 0, []
        for x in r["loss_mask"]:
            if x["loss"]:
                parts.append(re.sub(r"(?s)\\(.)", r"\1", r["formatted"][at : at + x["chars"]]))
            at += x["chars"]
        assert at == len(r["formatted"])
        assert parts == [t["text"] for t in r["turns"] if t["role"] == "assistant"]


def test_empty(spark):
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_op3(spark):
    got = {r["conv_id"]: r for r in chat.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("SELECT conv_id, role, text FROM '/root/testdata/sf0.001/conversations.parquet' ORDER BY conv_id, turn").fetchall() + [(-1, "user", chat.PROBE), (-1, "assistant", chat.PROBE)]
    for conv in {r[0] for r in rows}:
        told = "".join(f"{role}\n{text}\n" for c, role, text in rows if c == conv)
        loss = "".join(text for c, role, text in rows if c == conv and role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
