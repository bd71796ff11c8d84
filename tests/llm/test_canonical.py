import json
import random

from lodespark.llm import canonical
from tests.conftest import rows


def same(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return {r.id: r.keep_id for r in canonical.collapse(df, "id", "t").collect()}


def test_spellings_and_notations(spark):
    got = same(
        spark,
        "Risk: bad Hash in 'f', line 3!",
        "risk  BAD hash in f\nline\u00a03",
        '{"file": "a.py", "line": "3", "issue": "x y"}',
        "ISSUE = X Y; LINE = 3; FILE = A.PY;",
        "line: 3 | issue: x y | file: a.py",
        "- file:a.py,\tissue:x y, line:3",
        '{"file": "x y", "line": "3", "issue": "a.py"}',
        "file=a.py\nline=3",
        '{"line": 3, "file": "a.py", "issue": "x-y"}',
        '{"file": "a.py", "line": "3", "issue": "x y"',
    )
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7, 8: 2, 9: 2}


def test_prose_with_signs_is_no_record(spark):
    got = same(spark, "Risk: a in b, line 3", "line 3, Risk: a in b", "x is not covered; and y", "and y; x is not covered")
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, " \n"), (4, "--- !"), (5, "É"), (6, "é"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000)], "id long, t string")
    assert rows(canonical.collapse(df.withColumn("key", df.t), "id", "t")) == [(5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 7, 2)]
    assert canonical.collapse(df.limit(0), "id", "t").count() == 0


def test_hot_keys_equal_brute_force(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["Hot claim.", "hot, CLAIM"]) if rnd.random() < 0.4 else json.dumps({"a": rnd.randrange(40), "b": 1})) for i in rnd.sample(range(10_000), 1_500)]
    best, count = {}, {}
    key = lambda t: "hot" if t[0] != "{" else t
    for i, t in data:
        best[key(t)] = min(i, best.get(key(t), i))
        count[key(t)] = count.get(key(t), 0) + 1
    want = sorted([(i, best[key(t)], count[key(t)]) for i, t in data], key=repr)
    df = spark.createDataFrame(data + data[:50], "id long, t string")
    for hot_rows in (1, 100, 10_000):
        assert rows(canonical.collapse(df, "id", "t", hot_rows=hot_rows)) == want
