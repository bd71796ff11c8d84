import datetime as dt
import random

from lodespark.operators import history
from tests.conftest import rows

UPD = "update_id long, claim_id long, last_seen_run string, status string, confidence double, history array<struct<run_id string, confidence double, status_change string>>, received_at timestamp_ntz, ord int, block string"
DAY = dt.datetime(2031, 1, 1)


def brute(updates, runs):
    ts = {}
    for r, t in runs:
        ts[r] = min(t, ts.get(r, t))
    norm = lambda s: s and s.strip().lower().replace(" ", "_").replace("-", "_")
    best = {}
    for u, c, r, s, p, h, at, *_ in updates:
        if c is None:
            continue
        for rank, rr, ss, pp in [(1, r, s, p)] + [(0, x[0], x[2], x[1]) for x in h or []]:
            key, val = (c, rr), (rank, at, u, norm(ss) or "", -1 if pp is None else pp)
            if rr in ts and val > best.get(key, ((-1,), None))[0]:
                best[key] = (val, (norm(ss), pp))
    out = []
    for c in {k[0] for k in best}:
        seq = sorted((ts[r], r) for cc, r in best if cc == c)
        status = conf = prev = None
        opens = []
        for i, (_, r) in enumerate(seq):
            s, p = best[c, r][1]
            status, conf = s or status, conf if p is None else p
            if i == 0 or (status, conf) != prev:
                opens.append(r)
            prev = (status, conf)
        out += [(c, a, b) for a, b in zip(opens, [*opens[1:], ""], strict=True)]
    return sorted(out, key=repr)


def test_versions_equal_a_plain_fold(spark):
    rnd = random.Random(7)
    runs = [(f"r{i:03}", DAY + dt.timedelta(hours=30 * i)) for i in range(60)]
    updates = []
    for u in range(900):
        c = 1 if rnd.random() < 0.4 else rnd.randint(2, 20)  # one claim holds a large share
        r = rnd.randrange(60)
        hist = [(f"r{j:03}", rnd.choice([None, 0.5]), rnd.choice([None, "Open"])) for j in range(max(0, r - 3), r + 1)] if rnd.random() < 0.6 else rnd.choice([None, []])
        updates.append((u, c, f"r{r:03}", rnd.choice([None, "open", " Still Open", "still-open", "resolved"]), rnd.choice([None, 0.1, 0.2]), hist, DAY + dt.timedelta(minutes=rnd.randrange(10**6)), 0, "x"))
    updates += updates[:30]
    # the same history entry reads the same in every update, as a tracker's log does
    seen = {}
    fixed = []
    for u in updates:
        h = None if u[5] is None else [seen.setdefault((u[1], e[0]), e) for e in u[5]]
        fixed.append((*u[:5], h, *u[6:]))
    rnd.shuffle(fixed)
    got = history.versions(spark.createDataFrame(fixed, UPD), spark.createDataFrame(runs + runs[:5], "run_id string, ts timestamp_ntz"))
    assert rows(got.select("claim_id", "from_run", "to_run")) == brute(fixed, runs)


def test_defined_cases(spark):
    runs = spark.createDataFrame([("a", DAY), ("b", DAY), (None, DAY), ("c", None)], "run_id string, ts timestamp_ntz")
    ups = [(1, 5, "b", None, None, None, None, 0, ""), (2, 5, "a", "open", None, None, None, 0, ""), (3, None, "a", "open", 0.5, None, DAY, 0, ""), (4, 6, "c", "open", 0.5, None, DAY, 0, ""), (5, 6, None, None, None, [(None, 0.1, "x")], DAY, 0, "")]
    got = history.versions(spark.createDataFrame(ups, UPD), runs)
    assert rows(got.select("claim_id", "status", "confidence", "from_run", "to_run")) == [(5, "open", None, "a", "")]
    assert history.versions(spark.createDataFrame([], UPD), runs).count() == 0


def test_difference_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (None, "z", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "n", 1), (None, "z", 1)], "k int, v string, w int")
    assert rows(history.difference(a, b, ["k"], ["v", "w"]).select("k", "change")) == sorted([(1, "same"), (2, "changed"), (3, "inserted"), (None, "same")], key=repr)


def test_versions_over_snapshots_end_where_a_key_is_missing(spark):
    data = [("r", 1, 0, "K", "open", 0.1), ("r", 2, 0, "k ", "open", 0.1), ("r", 4, 0, "j", None, None), ("r", 5, 0, "k", "open", 0.1), ("r", 5, 1, "k", None, 0.1), ("r", 6, 0, "k", None, 0.1), ("s", 1, 0, "k", "x", 1.0), (None, 1, 0, "k", "x", 1.0), ("s", 1, 0, " ", "x", 1.0)]
    df = spark.createDataFrame([(*d, 7, "c") for d in data + data[:2]], "repo string, snapshot_no int, load_no int, claim string, status string, confidence double, ord int, change string")
    got = history.snapshot_versions(df, ["status", "confidence"])
    assert rows(got) == sorted([("r", "k", 1, 4, "open", 0.1), ("r", "j", 4, 5, None, None), ("r", "k", 5, None, None, 0.1), ("s", "k", 1, None, "x", 1.0)], key=repr)
    assert history.snapshot_versions(df.limit(0), ["status", "confidence"]).count() == 0


def test_wide_sides_are_not_broadcast(spark, monkeypatch):
    from lodespark import joins

    left, right = spark.range(3), spark.createDataFrame([(1, "x" * 500)], "id long, v string")
    plan = lambda: joins.lookup(left, right, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 400)
    assert "broadcast" not in plan()
