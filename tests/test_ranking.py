"""The best rows equal those of a full ranking, with less read."""

import random

import pytest
from pyspark.sql import functions as F

from patternlake.operators import ranking, search
from patternlake.sources.store import written
from tests.test_substring import rows_read


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    odds = [1 / (k + 1) for k in range(30)]
    rows = [(k, " ".join(rng.choices(words, odds, k=rng.randint(0, 60))), " ".join(rng.choices(words, odds, k=3))) for k in range(800)]
    catalog = spark.createDataFrame(rows, "id long, name string, description string")
    return rows, search.write_index(catalog, ("name", "description"))


def full(rows, query, most):
    import math

    words = list(dict.fromkeys(query.split()))
    tf = {w: {k: n for k, a, b in rows if (n := (a.split() + b.split()).count(w))} for w in words}
    score = {}
    for w in words:
        for k, n in tf[w].items():
            score[k] = score.get(k, 0) + n * math.log(len(rows) / len(tf[w]))
    return sorted(((k, round(s, 6)) for k, s in score.items()), key=lambda x: (-x[1], x[0]))[:most]


@pytest.mark.parametrize("head", [1, 40, 10_000])
def test_same_as_a_full_ranking(corpus, head):
    rows, index = corpus
    impacts = ranking.write_impacts(index, len(rows))
    for query, most in (("w0 w5 w29", 10), ("w20", 3), ("w1 w2 w3 nothing", 25), ("w0", 5)):
        got = [(r.id, r.score) for r in ranking.top(impacts, query, most, head).collect()]
        want = full(rows, query, most)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6), query
    assert ranking.top(impacts, "nothing !!", 5).collect() == []


def test_heads():
    steps = [(9, 2), (5, 3), (1, 100)]
    assert ranking._head(steps, 1) == (9, 5) and ranking._head(steps, 4) == (5, 1) and ranking._head(steps, 6) == (1, 0) and ranking._head(steps, 999) == (1, 0)


def test_reads_less(spark):
    """Long lists in which few rows have high counts: the heads and a few pages of ids are read."""
    n = 300_000
    rows = spark.range(n).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("token"))
    many = F.when(F.col("id") % 99_999 == 7, 30).otherwise(1)
    index = rows.select("id", F.lit("name").alias("column"), F.explode(F.sequence(F.lit(1), many)).alias("pos"), "token").where("token = 'a' OR id % 3 = 1")
    index = written(index.repartitionByRange(6, "token", "id").sortWithinPartitions("token", "id", "pos"), "tokens")
    impacts = ranking.write_impacts(index, n + 1000)
    best = ranking.top(impacts, "a b", 3, 3)
    assert len(best.collect()) == 3
    head = impacts.postings.where("token = 'a' AND tf >= 30")
    assert rows_read(head) < 0.3 * impacts.postings.count() and rows_read(best) < 0.6 * index.count()
    assert best.collect() == ranking.top(impacts, "a b", 3, 10**9).collect()
