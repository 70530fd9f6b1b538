"""The network against slow arithmetic and finite differences; predictions against held-out documents."""

import math
import time
import zlib

import numpy as np
import pytest

from patternlake.llm import language as L

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    return L.Network(("a", "b", "c"), rng.normal(0, 1, (2, 9, 256)).astype(np.float32), rng.normal(0, 1, (2, 9, 3)).astype(np.float32), rng.normal(0, 1, (3, 6)).astype(np.float32), np.zeros(3, np.float32))


def slow_states(embed, turn, data):
    """One state after another, one unit after another."""
    h, out, u = [0.0] * turn.shape[1], [], turn.shape[1]
    for x in data:
        s = [sum(turn[g][j] * h[j] for j in range(u)) for g in range(3 * u)]
        z = [1 / (1 + math.exp(-(embed[k][x] + s[k]))) for k in range(u)]
        r = [1 / (1 + math.exp(-(embed[u + k][x] + s[u + k]))) for k in range(u)]
        n = [math.tanh(embed[2 * u + k][x] + r[k] * s[2 * u + k]) for k in range(u)]
        h = [n[k] + z[k] * (h[k] - n[k]) for k in range(u)]
        out.append(h)
    return out


def slow_log_p(net, data):
    ahead, behind = slow_states(net.embed[0], net.turn[0], data), slow_states(net.embed[1], net.turn[1], data[::-1])[::-1]
    out = []
    for a, b in zip(ahead, behind):
        v = [sum(w * x for w, x in zip(row, [*a, *b])) for row in net.out]
        out.append([x - math.log(sum(map(math.exp, v))) for x in v])
    return np.array(out)


def test_pooling_covers_every_byte_once(net):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (1, 0, 5, L.STRETCH, L.STRETCH + 1, 3 * L.STRETCH, 301)]
    ends = np.cumsum([len(t) for t in texts])
    mean, votes = L.pooled(net, np.concatenate(texts), ends)
    assert votes.sum(axis=1).tolist() == [len(t) for t in texts]
    for k, t in enumerate(texts):
        if not len(t):
            continue
        want = []
        for a in range(0, len(t), L.STRETCH):
            start = min(a, max(0, len(t) - L.STRETCH))
            piece = [*t[start : start + L.STRETCH]]
            want.extend(slow_log_p(net, piece + [0] * (L.STRETCH - len(piece)))[a - start : len(piece)])
        assert np.allclose(mean[k], np.mean(want, axis=0), atol=1e-4)
        assert votes[k].tolist() == np.bincount(np.argmax(want, axis=1), minlength=3).tolist()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    w = {"embed": rng.normal(0, 1, (2, 9, 256)), "turn": rng.normal(0, 1, (2, 9, 3)), "out": rng.normal(0, 1, (3, 6)), "bias": rng.normal(0, 1, 3)}
    w = {n: v.astype(np.float32) for n, v in w.items()}
    x, y = rng.integers(0, 5, (7, 4)), np.array([0, 1, 2, 1])
    _, slope = L.gradients(w, x, y)
    for name, where in [("embed", (0, 1, 2)), ("embed", (1, 8, 3)), ("embed", (0, 4, 0)), ("turn", (0, 0, 1)), ("turn", (1, 4, 2)), ("turn", (0, 7, 0)), ("out", (2, 4)), ("bias", (1,))]:
        step, losses = 1e-2, []
        for sign in (1, -1):
            moved = {n: v.copy() for n, v in w.items()}
            moved[name][where] += sign * step
            losses.append(L.gradients(moved, x, y)[0])
        assert slope[name][where] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=2e-3)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op11_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and 0 <= r.agreement <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_learning_reads_no_held_out_document(spark):
    rows = [(k, f"word {'x' * k}", "en") for k in range(40)] + [(40, "null", None), (41, "", "en"), (42, "12 3", "en")]
    got = {r.t for r in L.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert got == {t for i, t, lang in rows if lang and any(c.isalpha() for c in t) and zlib.crc32(str(i).encode()) % 5}
    few = L.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 3, 5).collect()
    assert len(few) == 3 and all(len(r.t) <= 5 for r in few)


def test_defined_results(spark, net):
    schema = "doc_id long, text string, lang string, lang_pred int, i int, t int, score string"
    texts = [None, "", "12 3 \n", "a", "é" * 700, "a", "b" * 3_000_000, "\x00 z"]
    rows = [(k if k else None, t, "en", 1, 2, 3, "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schema)
    began = time.perf_counter()
    got = {r.doc_id: r for r in L.identify(df, net).collect()}
    assert time.perf_counter() - began < 60
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {None, 1, 2} and got[1].score == 0
    assert got[3][1:] == got[5][1:] and got[6].lang_pred in net.languages
    nothing = L.identify(df, L.learn(df.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    assert L.identify(df.where("false"), net).collect() == []
    one = L.identify(df, L.learn(df)).where("doc_id = 3").first()
    assert (one.lang_pred, one.score) == ("en", 1.0)


def test_position_labels(spark):
    texts = ["the thing of the other " * 9, "le la les une éàè " * 9]
    net = L.fit([t.encode() for t in texts], ["en", "fr"], steps=60)
    runs = L.position_labels(net, texts[0] + texts[1])
    size = len((texts[0] + texts[1]).encode())
    assert [a for a, _, _ in runs] + [size] == [0] + [b for _, b, _ in runs]
    share = sum(b - a for a, b, n in runs if (n == "fr") == (a >= len(texts[0])))
    assert share > 0.8 * size and L.position_labels(net, "") == []
