import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from patternlake.llm import near, repeats


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        spans = []
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        at = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(at[::2], at[1::2], strict=True))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def cut_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randrange(900))) for _ in range(12)]
    texts = []
    for _ in range(50):
        x, y = rng.choice(base), rng.choice(base)
        texts.append(x[: rng.randrange(len(x) + 1)] + y[rng.randrange(len(y) + 1) :])
    return [*texts, "ab" * 400, "a" * 1000, None, "", "x" * 199, "y" * 200, base[0], base[0]]


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2)])
def test_repeats(spark, seed, hot):
    texts = cut_texts(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, h string")
    rows = repeats.remove_repeats(docs, hot=hot).collect()
    want = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert r["h"] == "x" and len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"]


def test_repeats_across_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    data = np.frombuffer(("".join(cut_texts(3)[k] or "" for k in range(20))).encode(), np.uint8)
    covered = np.zeros(len(data), bool)
    for _, lo, hi, _, _, _ in repeats.runs(data, np.array([len(data)]), 200, 32):
        for a, b in zip(lo, hi, strict=True):
            assert not covered[a : b + 1].any()
            covered[a : b + 1] = True
    assert covered[: len(data) - 199].all() and not covered[len(data) - 199 :].any()


@pytest.mark.parametrize("length", [5, 8, 13, 200])
def test_bucket_pointers(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + bytes(range(250)) * 2
    windows = np.arange(len(data) - length + 1)
    seen = Counter(data[p : p + length] for p in windows)
    got = repeats.repeated(np.frombuffer(data, np.uint8), windows, length)
    assert got.tolist() == [seen[data[p : p + length]] > 1 for p in windows]


def test_repeats_in_long_texts(spark):
    """Texts of several stretches; the repeated passages are planted, so the spans are known."""
    rng = np.random.default_rng(5)
    fresh = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, edge = fresh(700), repeats.SEGMENT
    long = b"0" + fresh(edge - 301) + b"1" + passage + b"2" + fresh(2_000_000) + b"3" + passage[:199] + b"4" + fresh(900_000) + b"5" + passage[100:400] + b"6"
    short = b"7" + passage[50:650] + b"8" + fresh(300) + b"9"
    docs = spark.createDataFrame([(1, long.decode()), (2, short.decode())], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    cut = lambda b, a, n: b[:a] + b[a + n :]
    at = long.index(b"1" + passage) + 51
    kept = cut(cut(long, len(long) - 301, 300), at, 600)
    assert (rows[1]["n_removed"], rows[1]["n_spans"]) == (900, 2) and rows[1]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert (rows[2]["n_removed"], rows[2]["n_spans"]) == (600, 1) and rows[2]["kept_sha256"] == hashlib.sha256(cut(short, 1, 600)).hexdigest()


@pytest.mark.parametrize("length", [3, 40, 1500])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abcdefgh") for _ in range(6000))
    texts = [base[: 4000 + rng.randrange(2000)], base[rng.randrange(2000) :], "x" * 5000, "yz" * 20, None]
    rows = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length).collect()
    want = brute(texts, length)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows) and len(rows) == 5


def test_length_has_a_bound(spark):
    with pytest.raises(ValueError, match="length"):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=6000)


def test_repeats_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0)))


def classes(texts):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            least, most = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if (most and 5 * least >= 4 * most) or (texts[a] or "") == (texts[b] or ""):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [None, "", "  ", "one two", "one  two", "one two three", "a " * 40, "a " * 44, "a " * 80]
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.randrange(20, 200))
        texts += [" ".join(words), edited(rng, words, 1), edited(rng, words, 3), "\n".join(words)]
    words = rng.choices(vocabulary, k=250)  # a group around a text that isn't there, some links in it just below the limit
    texts += [edited(rng, words, rng.randrange(1, 9)) for _ in range(120)]
    chain = rng.choices(vocabulary, k=150)
    for _ in range(12):
        chain = edited(rng, chain, 1).split()
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize("block", [256, 8])
def test_near(spark, near_texts, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(near_texts)], "doc_id long, text string, label int")
    found = near.near_classes(docs)
    assert found.columns[:2] == ["doc_id", "label"]
    got = defaultdict(set)
    for r in found.collect():
        got[tuple(r["label_"])].add(r["doc_id"])
    want = defaultdict(set)
    for k, c in enumerate(classes(near_texts)):
        want[c].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if block == 256:
        kept = near.keep_one(docs.drop("label"))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(c) for c in want.values())


def test_one_row_of_each_class_is_kept(spark):
    text = "the same text in every one of these rows of the table"
    rows = [(1, text), (1, text), (None, "only a null id has this one"), (None, "only a null id has this one"), (None, text), (3, "c"), (2, "c"), (2, "d"), (5, None), (4, "")]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    told = Counter((r["doc_id"], r["class_id"], r["class_rows"], r["kept"]) for r in found)
    assert told == Counter(
        [(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (None, None, 2, True), (None, None, 2, False), (2, 2, 2, True), (3, 2, 2, False), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False)]
    )
    kept = near.keep_one(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, h int")).collect()
    assert len(kept) == 5 and {r["doc_id"] for r in kept} == {1, None, 2, 4}


def test_equal_ids_of_texts_merge_nothing(spark, monkeypatch):
    real = near._ids
    monkeypatch.setattr(near, "_ids", lambda text: [near.F.lit(1).cast("long").alias("h"), real(text)[1]])
    rows = [(1, "a b c d e f g"), (2, "something else altogether is said here"), (3, "a b c d e f g")]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == [(1, 1), (2, 2), (3, 1)]


def test_signatures(near_texts):
    texts = pa.array([t or "" for t in near_texts])
    sig = np.concatenate([s for *_, s in near._signed(texts)])
    bags = [bag(t) for t in near_texts]
    errors = []
    for a in range(len(bags)):
        for b in range(a):
            if most := sum((bags[a] | bags[b]).values()):
                similarity = sum((bags[a] & bags[b]).values()) / most
                if similarity > 0.1:
                    errors.append(((sig[a] == sig[b]).mean() - similarity) / np.sqrt(similarity * (1 - similarity) / 256 + 1e-6))
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.3 and 0.7 < errors.std() < 1.3


def test_near_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_classes(empty).count() == 0 and near.keep_one(empty).count() == 0


def test_a_task_has_one_python_worker(spark):
    """Of two steps in a row each would have a worker of its own, whose memory an executor has twice."""
    docs = spark.createDataFrame([("a b c " * 100,), ("b c d " * 100,)], "text string")
    plan = repeats.remove_repeats(docs, hot=1)._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.strip(" :+-|") for line in plan.splitlines()]
    over = [(x, y) for x, y in zip(steps, steps[1:]) if x.startswith("MapInArrow") and y.startswith("MapInArrow")]
    assert sum(x.startswith("MapInArrow") for x in steps) > 3 and not over
