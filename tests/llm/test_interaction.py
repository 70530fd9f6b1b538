"""The audit against counting by hand, document by document and order by order."""

import re
from itertools import permutations

from patternlake.llm import interaction as I

SCHEMA = "doc_id long, text string, lang string, extra int, mask int, part string"


def brute(docs, labels):
    """(part, order, step) -> counts, by walking every document through every order."""
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for p in {d[2] or "" for d in docs}:
        mine = []
        for i, t, lang, *_ in docs:
            if (lang or "") != p:
                continue
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            f = {c for c, hit in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t])) if hit}
            mine.append((f, i))
        share = dict.fromkeys("ABCDE", 0)
        rows = {}
        for o in map("".join, permutations("ABCDE")):
            left = list(mine)
            for k, c in enumerate(o, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                share[c] += len(gone)
                fails = sum(c in d[0] for d in mine)
                rows[p, o, k] = [len(left), len(gone), fails - len(gone), sum(d[0] == {c} for d in mine), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]
        out |= {k: (*v, share[k[1][k[2] - 1]]) for k, v in rows.items()}
    return out


def test_every_order_is_counted(spark):
    many = " ".join(f"w{k}" for k in range(210))
    docs = [
        (1, many, "en"), (2, many, "en"), (2, many, "en"), (3, many + " $", "en"), (4, "A B c", "en"), (5, None, "en"), (6, "", "fr"), (7, None, None),
        (8, "x " * 300, "fr"), (9, "x " * 300, None), (None, many, "fr"), (None, None, "fr"), (10, "QQ | " * 300, ""), (11, "é" * 1000, "en"), (12, "x " * 1_000_000, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (5, 0, 1), (10, 1, 1), (99, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2, "z") for d in docs], SCHEMA).repartition(3)
    got = I.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(docs, labels)
    assert len(got) == 3 * 600


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert I.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en", 1, 1, "")], SCHEMA)
    assert {r.removed for r in I.audit(one, labels).where("step = 1 AND filter_order = 'ABCDE'").collect()} == {1}


def test_inversion_is_exact(spark):
    masks = spark.range(1000).selectExpr("cast(id * id % 8 as int) as m")
    got = {r["mask"]: r["n"] for r in I.cells(I.parity_sums(masks, "m", 3, []), 3).collect()}
    want = {}
    for k in range(1000):
        want[k * k % 8] = want.get(k * k % 8, 0) + 1
    assert {m: n for m, n in got.items() if n} == want


def test_one_text_is_dealt_by_id(spark):
    """Rows meet their text's smallest id by text and id; by text alone only partial sums are dealt."""
    docs = spark.createDataFrame([(1, "a", "en", 1, 1, "")], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = I.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    dealt = [k for k, x in enumerate(lines) if "Exchange hashpartitioning(" in x and "h#" in x]
    alone = [k for k in dealt if "i#" not in lines[k]]
    assert len(dealt) > len(alone) == 1 and "partial_min(i#" in lines[alone[0] + 1]
