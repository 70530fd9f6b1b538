import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patternlake.llm import common, forest, pii, quality, secrets
from tests.llm.test_repeats_near import brute, classes


def exact(ids, vectors, k=5):
    lengths = np.sqrt((vectors**2).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        scores = vectors @ vectors[q] / (lengths * lengths[q])
        order = [x for x in np.lexsort((ids, -scores)) if ids[x] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[x]), scores[x]) for x in order]
    return out


@pytest.mark.parametrize("shards", [None, 4])
def test_recall(spark, shards):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    want = exact(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float))
    got = {}
    for r in forest.nearest(table, F.col("vec_id") % 50 == 0, shards=shards).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9
    for q in want:
        truth = dict(want[q])
        assert [s for _, s in sorted(got[q].items())] == sorted(got[q].values(), key=lambda x: (-x[1], x[0]))
        assert all(abs(truth[v] - s) < 1e-12 for v, s in got[q].values() if v in truth)


def test_forest_prunes():
    """Neighbours among random vectors, the hardest case: recall with under a tenth of the rows scored."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((50_000, 64))
    f = forest.Forest(np.arange(50_000), vectors)
    asked = vectors[:: 50_000 // 100]
    ids = np.arange(0, 50_000, 50_000 // 100)
    scored = [len(x) for x in f.candidates(forest.strings(asked))]
    assert max(scored) < 0.1 * 50_000
    unit = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
    hits = 0
    for q, found, _ in f.nearest(ids, asked, 5):
        close = unit @ unit[q]
        close[q] = -2
        hits += len(set(found) & set(np.argsort(-close)[:5]))
    assert hits / (5 * len(ids)) >= 0.9


@pytest.mark.parametrize("shards", [1, 3])
def test_all_rows_scored_is_exact(spark, shards):
    rng = np.random.default_rng(9)
    vectors = np.round(rng.standard_normal((2000, 6)), 1)  # with ties
    vectors[:, 0] += 0.05
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(table, F.col("vec_id") % 50 == 0, k=7, shards=shards, scored=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    want = exact(np.arange(2000), vectors, 7)
    assert {q: [round(s, 9) for _, s in sorted(x.items())] for q, x in got.items()} == {q: [round(s, 9) for _, s in x] for q, x in want.items()}


def test_share_and_fewest_bound_the_scored_rows():
    f = forest.Forest(np.arange(4000), np.random.default_rng(3).standard_normal((4000, 16)))
    keys = forest.strings(f.vectors[:20])
    assert all(len(x) <= 200 for x in f.candidates(keys, 0.05, 10))
    assert all(len(x) <= 300 for x in f.candidates(keys, 0.05, 300))
    assert all(len(x) == 4000 for x in f.candidates(keys, 1.0, 10))
    with pytest.raises(ValueError):
        forest.nearest(None, None, scored=1.5)


def test_several_vectors_of_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [-1.0, -2.0])]
    found = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1.0), (2, -0.447214)]


def test_prefixes():
    rng = np.random.default_rng(0)
    f = forest.Forest(np.arange(500), rng.standard_normal((500, 8)))
    keys = forest.strings(f.vectors)
    for depth in (0, 1, 5, 31, 32):
        lo, hi = f.ranges(keys[:20], np.full(20, depth))
        for q in range(20):
            for t in (0, forest.TREES - 1):
                same = [x for x in range(500) if depth == 0 or int(keys[x, t]) >> (forest.BITS - depth) == int(keys[q, t]) >> (forest.BITS - depth)]
                assert sorted(f.rows[t][lo[q, t] : hi[q, t]]) == same


def test_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (0, v), (50, v), (1, v), (2, v), (3, v), (4, v), (5, v), (6, v), (7, [0.0, 0.0]), (8, None), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (None, v), (11, [1.0, 2.0, 3.0]), (12, [])]
    found = forest.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, k, k) for k in range(1, 6)] + [(50, k + 1, k) for k in range(5)]
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark)


def test_held_out_findings(spark, model):
    from pyspark.ml.functions import array_to_vector

    rows = [(secrets.features(t, a, b), float(y)) for t, a, b, y in secrets.labelled(800, 99)]
    scored = model.transform(spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label"))
    assert scored.where("label = prediction").count() / len(rows) > 0.97


def test_find_secrets(spark, model):
    key = "3f2a9c" * 6 + "b4e1"
    texts = [None, "", f'é token = "{key}" ok', "see therionthtereandheouthingnder and " + "w" * 40, f'token = "{key}"', "commit 0123456789abcdef0123456789abcdef01234567"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(4, texts[4], 0)], "doc_id long, text string, score int")
    found = secrets.find_secrets(docs, model=model).where("is_secret").collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == [(2, 11, 51), (4, 9, 49), (4, 9, 49)]
    assert secrets.find_secrets(docs.limit(0), model=model).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    kept = {r["doc_id"] for r in quality.op1_quality_rules(spark, folder).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = common.cut(stages["quality_rules"](spark, docs, folder))
    assert {r["doc_id"] for r in first.collect()} == kept
    of = classes([t for _, t in rows])
    rows = [rows[k] for k in range(len(rows)) if of[k] == k]
    second = common.cut(stages["near_dedup"](spark, first, folder))
    assert sorted(tuple(r) for r in second.select("doc_id", "text").collect()) == rows
    third = common.cut(stages["suffix_dedup"](spark, second, folder))
    removed = {i: x for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)}
    left = {r["doc_id"]: r for r in third.collect()}
    assert set(left) == set(removed)
    for i, (n, gone, _, _) in removed.items():
        assert 0 <= n - gone - len(left[i]["text"].encode()) <= 8 and left[i]["n_chars"] == len(left[i]["text"])
    fourth = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, third, folder).collect()}
    for i, r in left.items():
        assert fourth[i] == pii.masked(r["text"], pii.all_spans(r["text"], pii.trained())[1])
    assert all(s(spark, docs, folder).columns == docs.columns for _, s in corpus_pipeline.STAGES[:1])
    packed = corpus_pipeline.run(spark, folder).collect()
    words = {}
    for r in packed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["length"]
    assert words == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in fourth.items()}
