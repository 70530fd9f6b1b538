"""The stored token table: a row for each token of a text, dealt to as many parts as its size asks for."""

from pyspark.sql import functions as F

from patternlake.operators import ranking, search, substring
from patternlake.sources.store import pieces, written

_TEXTS = [(1, "the cat the hat", "The"), (2, None, "!"), (3, "", "hat cat"), (5, "a the the the", None)]


def _catalog(spark):
    return spark.createDataFrame(_TEXTS, "id long, description string, name string")


def _expected():
    return sorted((k, c, p, t) for k, *texts in _TEXTS for c, text in zip(("description", "name"), texts) for p, t in enumerate((text or "").replace("!", "").lower().split()))


def test_postings_have_every_place_once(spark):
    postings = search.write_postings(_catalog(spark), ("description", "name"))
    assert postings.columns == ["token", "column", "id", "places"]
    rows = postings.collect()
    assert len(rows) == len({(r.token, r.column, r.id) for r in rows})
    assert sorted(map(tuple, search.as_index(postings).collect())) == _expected()
    empty = search.write_index(_catalog(spark).where("id = 2"), ("description", "name"))
    assert empty.count() == 0 and search.write_index(_catalog(spark).where("false"), ("name",)).count() == 0


def test_impacts_of_postings_are_those_of_the_index(spark):
    postings = search.write_postings(_catalog(spark), ("description", "name"))
    index = search.as_index(postings)
    found = [sorted(map(tuple, ranking.write_impacts(index, 4, p).postings.collect())) for p in (None, postings)]
    assert found[0] == found[1] and ("the", 3, 1) in found[0] and ("the", 3, 5) in found[0]


def test_trigrams_of_a_batch_once(spark):
    grams = substring.write_grams(_catalog(spark), ("description", "name"))
    want = sorted({(t[k : k + 3], i) for i, *texts in _TEXTS for t in texts if t for t in (t.lower(),) for k in range(len(t) - 2)})
    assert sorted(map(tuple, grams.postings.collect())) == want
    assert {r.gram: r.n for r in grams.counts.collect()}["the"] == 2


def test_parts_grow_with_what_is_stored(spark):
    rows = written(spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")), "sized")
    assert pieces(rows, mb=1) > 3 * pieces(rows, mb=8) >= 3
