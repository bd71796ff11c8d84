import random

from lodespark.operators import snapshots
from tests.conftest import rows

FIELDS = ["branch", "n"]
SCHEMA = "repo string, snapshot_no int, load_no int, claim string, branch string, n int, ord int, next_no int, claim_key string, h string"


def brute(data):
    last = {}
    for r, s, load, *_ in data:
        if r is not None and s is not None:
            last[r, s] = max(load, last.get((r, s), load))
    held = {}
    for r, s, load, claim, b, n, *_ in data:
        key = claim.strip().lower() if claim else ""
        if key and last.get((r, s)) == load:
            held.setdefault((r, s), {})[key] = (b, n)
    out = []
    for r in {k[0] for k in last}:
        nos = sorted(s for rr, s in last if rr == r)
        for p, c in zip(nos, nos[1:], strict=False):
            old, new = held.get((r, p), {}), held.get((r, c), {})
            out += [(r, c, k, "added") for k in new.keys() - old.keys()] + [(r, c, k, "removed") for k in old.keys() - new.keys()]
            out += [(r, c, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out, key=repr)


def test_changes_equal_a_plain_comparison(spark):
    rnd = random.Random(3)
    data = []
    for repo in ["hot"] * 3 + ["a", "b"]:
        for s in sorted(rnd.sample(range(1, 9), 5)):
            for load in range(rnd.randint(1, 2)):
                for k in rnd.sample(range(12), rnd.randint(0, 9)):
                    v = (random.Random(f"{repo}{s}{load}{k}").choice([None, "x"]), random.Random(f"{s}{k}").choice([None, 1, 2]))
                    data.append((repo, s, load, rnd.choice(["Key{} ", "　key{}\t", "KEY{}"]).format(k), *v, 0, 0, "", ""))
    data += [("a", 3, 9, None, None, None, 0, 0, "", ""), ("a", 3, 0, " ", "x", 1, 0, 0, "", ""), (None, 1, 1, "k", "x", 1, 0, 0, "", ""), ("a", None, 1, "k", "x", 1, 0, 0, "", "")]
    data = [d for d in data if not (d[0] == "a" and d[1] == 3 and d[2] == 9)]
    df = spark.createDataFrame(data + data[:7], SCHEMA)
    got = snapshots.changes(df, FIELDS)
    assert rows(got.drop("old", "new")) == brute(data)
    changed = [r for r in got.collect() if r.change_kind == "changed"]
    assert changed and all(tuple(r.old) != tuple(r.new) for r in changed)
    assert all(r.old is None and r.new is None for r in got.collect() if r.change_kind != "changed")


def test_empty(spark):
    assert snapshots.changes(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0


def test_null_and_empty_text_are_different_values(spark):
    df = spark.createDataFrame([("r", 1, 1, "k", None, 1, 0, 0, "", ""), ("r", 2, 1, "k", "", 1, 0, 0, "", "")], SCHEMA)
    got = snapshots.changes(df, FIELDS).collect()
    assert [(r.repo, r.snapshot_no, r.claim_key, r.change_kind, tuple(r.old), tuple(r.new)) for r in got] == [("r", 2, "k", "changed", (None, 1), ("", 1))]


def test_index_advances_snapshot_by_snapshot(spark, tmp_path):
    index = snapshots.SnapshotIndex(spark, str(tmp_path / "index"), "repo", "k", ["v"], buckets=4)
    make = lambda d: spark.createDataFrame(d, "repo string, k string, v int")
    assert index.current() is None
    assert index.advance(make([("a", "x", 1), ("a", "y", 1)])) is None
    assert rows(index.advance(make([("a", "x", 1), ("a", "y", 2), ("a", "z", 1)]))) == [("a", "y", "changed"), ("a", "z", "added")]
    assert rows(index.advance(make([("a", "z", 1)]))) == [("a", "x", "removed"), ("a", "y", "removed")]


def test_a_load_of_blank_claims_is_a_delivery(spark):
    data = [("a", 1, 0, "k", "x", 1), ("a", 2, 0, " ", "x", 1), ("a", 3, 0, "k", "x", 1), ("a", 4, 0, "k", "x", 1), ("a", 4, 1, None, "x", 1)]
    df = spark.createDataFrame([(*d, 0, 0, "", "") for d in data], SCHEMA)
    got = snapshots.changes(df, FIELDS).drop("old", "new")
    assert rows(got) == brute([(*d, 0, 0, "", "") for d in data]) == [("a", 2, "k", "removed"), ("a", 3, "k", "added"), ("a", 4, "k", "removed")]


def _snap(spark, data):
    return spark.createDataFrame(data, "repo string, k string, v int")


def test_the_index_lies_still_while_it_is_probed(spark, tmp_path):
    index = snapshots.SnapshotIndex(spark, str(tmp_path / "index"), "repo", "k", ["v"], buckets=4)
    index.advance(_snap(spark, [("a", str(i), i) for i in range(50)]))
    old = index.current()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index.generation = 0
        new = snapshots.write_bucketed(snapshots.hash_index(_snap(spark, [("a", "1", 1)]).selectExpr("*", "false as ended"), "repo", "k", ["v"]), str(tmp_path / "other"), ["repo", "k"], 4)
        plan = snapshots.probe(old, new, ["repo", "k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_new_session_goes_on_with_the_index(spark, tmp_path):
    at = str(tmp_path / "index")
    make = lambda: snapshots.SnapshotIndex(spark, at, "repo", "k", ["v"], buckets=3)
    assert make().advance(_snap(spark, [("a", "x", 1), (None, "x", 1), ("a", None, 1)])) is None
    assert rows(make().advance(_snap(spark, [("a", "x", 2), ("b", "x", 1)]))) == [("a", "x", "changed"), ("b", "x", "added")]
    again = make()
    assert again.generation == 2
    (tmp_path / "index" / "changes-2" / "_SUCCESS").unlink()  # as if the session had died before the changes were whole
    assert make().generation == 0 or make().generation == 1
    assert rows(again.advance(_snap(spark, [("b", "x", 1)]))) == [("a", "x", "removed")]
