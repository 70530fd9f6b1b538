import random
import re

import pytest

from patternlake.llm import packing, pii


def plain(text):
    """The patterns as written, by the regular-expression engine alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns():
    rng = random.Random(5)
    parts = ["a", "b", "@", ".", ".", "1", "23", "255", "4111111111111111", " ", "-", "+1", "(", "%", "\n", "ü", "٣"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "@" * 100_000, "1 " * 100_000, "dot " * 30_000])
def test_long_texts_stay_linear(text):
    pii.all_spans(text, pii.trained())


def test_held_out():
    field, hit, missed, wrong = pii.trained(), 0, 0, 0
    for text, marks in pii.generated(300, 77):
        base, every = pii.all_spans(text, field)
        got, want = set(every) - set(base), set(marks) - set(base)
        hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
    assert hit / (hit + missed) > 0.75 and hit / (hit + wrong) > 0.9


def test_added_spans():
    field = pii.trained()
    for text, kind in (("tel (555) 123-4567 now", 3), ("write to ana at host dot com please", 0)):
        base, every = pii.all_spans(text, field)
        assert not base and [k for _, k, _ in every] == [kind]
    assert pii.all_spans("meet ana at noon by the dot on page 12", field)[1] == []


def test_documents(spark):
    rows = [(1, "é a@b.co", "s"), (None, None, "s"), (2, "", None), (2, "", None), (1 << 60, "+1 (555) 123-4567, 10.0.0.1", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert found[1]["spans"] == "email:2:8" and found[None]["spans"] == "" and found[1 << 60]["n_phone"] == 1
    clean = pii.mask_pii(docs).collect()
    assert {r["text"] for r in clean} == {"é [EMAIL]", None, "", "[PHONE], [IP]"} and len(clean) == 5 and clean[0]["spans"] == "s"
    assert pii.find_pii(docs.limit(0)).count() == 0


def tightest(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [k for k, b in enumerate(bins) if b[0] >= length and source not in b[1] and cluster not in b[2]]
        if fits:
            k = min(fits, key=lambda k: bins[k][0])
        else:
            bins.append([capacity, {None} - {None}, set()])
            k = len(bins) - 1
        bins[k][0] -= length
        bins[k][1] |= {source} - {None}
        bins[k][2] |= {cluster} - {None}
        out.append(bins[k][0])
    return len(bins), out


def test_best_fit():
    rng = random.Random(2)
    for _ in range(20):
        pieces = [(rng.randrange(0, 60), rng.choice([None, "a", "a", "b", "c", "d"]), rng.choice([None, *range(30)])) for _ in range(200)]
        pieces.sort(key=lambda p: -p[0])
        where = packing.pack(pieces, 100)
        fill, marks = {}, {}
        for (length, *both), (b, at) in zip(pieces, where, strict=True):
            assert at == fill.get(b, 0)
            fill[b] = at + length
            for k, x in enumerate(both):
                assert x is None or (b, k, x) not in marks
                marks[b, k, x] = 1
        assert max(fill.values()) <= 100
        assert max(b for b, _ in where) + 1 <= 1.1 * tightest(pieces, 100)[0] + 1


def test_each_piece_goes_to_the_tightest_bin():
    """Replays the placements: no bin that admits a piece is tighter than the one it got, and one opens only where none does."""
    rng = random.Random(9)
    for _ in range(30):
        pieces = [(rng.randrange(0, 60), rng.choice([None, *"aabcd"]), rng.choice([None, *range(20)])) for _ in range(150)]
        pieces.sort(key=lambda p: -p[0])
        bins = {}
        for (length, source, cluster), (b, _) in zip(pieces, packing.pack(pieces, 100), strict=True):
            admit = [x["rest"] for x in bins.values() if x["rest"] >= length and (source is None or source not in x["s"]) and (cluster is None or cluster not in x["c"])]
            if b in bins:
                assert bins[b]["rest"] == min(admit)
            else:
                assert not admit
            bin_ = bins.setdefault(b, {"rest": 100, "s": set(), "c": set()})
            bin_["rest"] -= length
            bin_["s"].add(source)
            bin_["c"].add(cluster)


def test_given_clusters(spark):
    rows = [(k, f"w{k} x", None, 7 if k < 3 else None) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, c int")
    found = {r["doc_id"]: r["bin_id"] for r in packing.pack_documents(docs, capacity=20, cluster_col="c").collect()}
    assert len({found[k] for k in range(3)}) == 3 and len({found[k] for k in range(3, 6)}) == 1


def test_alike_rows_are_split(spark):
    docs = spark.range(4000, numPartitions=8).selectExpr("1L AS doc_id", "'a b' AS text", "CAST(NULL AS string) AS source")
    found = packing.pack_documents(docs, shard=500)
    assert found.count() == 4000 and found.selectExpr("shiftright(bin_id, 32) AS s").distinct().count() > 3


def test_whole_table(spark):
    """Every word of every document lies in one place of one bin, and no bin has a source or a cluster twice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.collect()}
    fill, marks, words = {}, set(), {}
    for r in sorted(packing.op4_best_fit_packing(spark, "/root/testdata/sf0.01").collect(), key=lambda r: (r["bin_id"], r["bin_offset"])):
        assert r["bin_offset"] == fill.get(r["bin_id"], 0) and r["start"] == r["piece"] * packing.CAPACITY
        fill[r["bin_id"]] = r["bin_offset"] + r["length"]
        words.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
        text = texts[r["doc_id"]]
        if r["length"]:
            for mark in (("s", text["source"]), ("c", " ".join(re.findall(r"[^\x20\x09-\x0D]+", text["text"])).lower())):
                assert (r["bin_id"], mark) not in marks
                marks.add((r["bin_id"], mark))
    assert max(fill.values()) <= packing.CAPACITY and set(words) == set(texts)
    for i, pieces in words.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]["text"]))
        assert [k for k, _ in sorted(pieces)] == list(range(len(pieces))) and sum(x for _, x in pieces) == n


def test_unique_marks_equal_plain_best_fit():
    rng = random.Random(3)
    pieces = sorted(((rng.randrange(1, 60), None, None) for _ in range(300)), reverse=True, key=lambda p: p[0])
    where = packing.pack(pieces, 100)
    assert max(b for b, _ in where) + 1 == tightest(pieces, 100)[0]


def test_pack_documents(spark):
    rows = [(1, "w " * 25, "a", 0), (2, "w  " * 25, "b", 0), (3, None, "a", 0), (None, "x y", None, 0), (4, "", "a", 0), (5, "q " * 20, "a", 0), (5, "q " * 20, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, piece int")
    found = packing.pack_documents(docs, capacity=10).collect()
    assert sum(r["length"] for r in found) == 25 + 25 + 2 + 40 and len(found) == 3 + 3 + 1 + 1 + 1 + 2 + 2
    spots = {(r["bin_id"], r["bin_offset"] + k) for r in found for k in range(r["length"])}
    assert len(spots) == 92 and max(r["bin_offset"] + r["length"] for r in found) <= 10
    ones = [r["bin_id"] for r in found if r["doc_id"] in (1, 2) and r["piece"] == 2]
    assert len(set(ones)) == 2  # the texts differ in blanks only
    assert packing.pack_documents(docs.limit(0)).count() == 0
