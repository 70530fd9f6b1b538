"""Raw expressions against the full-text engine whose grammar they follow, and its errors."""

import random
import sqlite3

import pytest

from patternlake.operators import expression as E
from patternlake.operators import search

ROWS = [
    (1, "flow one", "two three flow_decision!!!", "Account", "flow_full", '["a", "b"]'),
    (2, "one two", "Café flow. A flow decision table", "Case", "flow_full", '["flow", "b c"]'),
    (3, "two", "one one two three four five six seven eight nine ten eleven twelve one", "Case", "apex", '["x"]'),
    (4, "", None, None, "near", "[]"),
    (5, "flower", "threefold one-two NEAR near", "Lead", "flow", '["one", "two"]'),
    (6, "not and or", "AND OR NOT", "Lead", "layout", '["one two"]'),
    (7, "three two one", "six one x two y three", "Account", "flow", "[]"),
]
NAMES = ("name", "description", "source_object", "pattern_type", "tags")

FORMS = '''one|one two|one AND two|one OR flow|one NOT two|one NOT two OR three|one OR two three|(one OR two) AND NOT|one AND two OR three NOT flow|flow*|"one two"|"one t"*|two + thr*|tw* + three
^one|^ flow|name : one|{name description} : two|- name : two|-{name tags} : one|name : (one OR two)|name : (one NOT description : two)|NEAR(one two)|NEAR(one two, 0)|NEAR(one two, 1)|NEAR(one three six, 2)
NEAR(one three, 3) AND two|NEAR("one two" five, 2)|NEAR(one one, 5)|NEAR(two one*, 1) OR flower|name : NEAR(two one, 3)|one "!!!"|one AND "!!!"|one NOT "!!!"|"!!!"|"!!!" OR two|"!!!" NOT one|NEAR(two "!!!" flow)|NEAR
"AND"|cafe|CAFÉ|"b"|tags : "a b"|"b c"|pattern_type : flow|(one)|((one) AND (two))|"say ""one"""|one name:flow|flow -name : two|NEAR(tw* thr*, 2) NOT name : three|NAME : one|one*two'''.replace("\n", "|").split("|")
ERRORS = ["", "  ", "!!!", "NOT one", "one NOT", "one AND", "one OR", "(", "(one", "one)", "flow (one)", "(one) two", "bad : one", "-one", "email-notification", "flow, email", '"open', "*", "one **", "one +", "{name : one",
          "name : - one", "name : description : two", "^NEAR(one two)", "near(one two)", "NEAR(one two, x)", "NEAR()", "name + x : y", "{} : one", "one : ", "-{name bad} : x", "NEAR(one OR two)"]


@pytest.fixture(scope="module")
def engine():
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(NAMES)})")
    con.executemany(f"INSERT INTO t(rowid, {', '.join(NAMES)}) VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    return lambda q: {i for (i,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,))}


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(ROWS, "id long, name string, description string, source_object string, pattern_type string, tags_text string")
    return search.token_table(rows).persist()


def ids(index, q):
    return {r.id for r in E.ids_matching(index, q).collect()}


def test_forms(engine, index):
    for q in FORMS:
        try:
            want = engine(q)
        except sqlite3.OperationalError:
            with pytest.raises(E.ExpressionError):
                E.parse(q)
            continue
        assert ids(index, q) == want, q


def test_errors(engine):
    for q in ERRORS:
        with pytest.raises(sqlite3.OperationalError):
            engine(q)
        with pytest.raises(E.ExpressionError):
            E.parse(q)


def made(rng, depth):
    word = lambda: rng.choice(["one", "two", "three", "flow", "fl*", "th*", "decision", '"one two"', '"two three"', "^one", "two + three", '"..."', "zebra"])
    near = lambda: f"NEAR({' '.join(w.strip('^') for w in (word(), word()))}, {rng.randint(0, 6)})"
    leaf = lambda: rng.choice(["", "", "name : ", "- description : ", "{tags name} : "]) + (near() if rng.random() < 0.3 else word())
    if depth == 0:
        return " ".join(leaf() for _ in range(rng.choice([1, 1, 2])))
    inner = made(rng, depth - 1)
    left = f"({inner})" if rng.random() < 0.5 else inner
    return f"{left} {rng.choice(['AND', 'OR', 'NOT'])} {made(rng, depth - 1)}"


def test_many_expressions(engine, index):
    """Trees and conditions of random expressions, on the driver: the leaves' rows come from Spark once."""
    rng = random.Random(9)
    queries = [made(rng, rng.choice([0, 1, 2])) for _ in range(150)]
    every = list(dict.fromkeys(n for q in queries for n in E.leaves(E.parse(q))))
    held = {}
    for k in range(0, len(every), 12):
        part = every[k : k + 12]
        spots = E._spots(index, part)
        several = {i: n for i, n in enumerate(part) if len(n.phrases) > 1}
        hits = spots.select("id", "leaf").where(~spots["leaf"].isin(*several)) if several else spots.select("id", "leaf")
        hits = hits.unionByName(E._close(spots, several)) if several else hits
        for r in hits.distinct().collect():
            held.setdefault(part[r.leaf], set()).add(r.id)

    def value(node):
        if isinstance(node, E.Near):
            return held.get(node, set())
        if isinstance(node, E.But):
            return value(node.wanted) - value(node.unwanted)
        parts = [value(p) for p in node.parts]
        return set.intersection(*parts) if isinstance(node, E.All) else set.union(*parts)

    for q in queries:
        assert value(E.parse(q)) == engine(q), q


def test_one_scan_and_one_grouping(index, spark):
    plan = E.ids_matching(index, "(one OR two) AND three NOT name : flow* OR x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and plan.count("Exchange ") == 1
