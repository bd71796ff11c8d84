import math
import random

from pyspark.sql import functions as F

from lodespark.llm import percentiles
from lodespark.storage import stored
from tests.conftest import rows

PS = [0.0, 0.5, 0.9, 0.99, 1.0]
SCHEMA = "trace_id long, phase string, function_name string, duration_ms double, code long, v double"


def brute(data):
    once = {t: (p, f, d) for t, p, f, d, *_ in data if t is not None and d is not None and math.isfinite(d) and d >= 0}
    groups = {}
    for p, f, d in once.values():
        for kind, k in (("phase", p), ("function_name", f)):
            if k is not None:
                groups.setdefault((kind, k), []).append(d)
    out = []
    for (kind, k), v in groups.items():
        v.sort()
        out += [(kind, k, len(v), p, v[max(1, math.ceil(p * len(v))) - 1]) for p in PS]
    return sorted(out, key=repr)


def data(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        d = rnd.choice([rnd.lognormvariate(2, 2), round(rnd.random(), 1), 5.0, 0.0])
        d = rnd.choice([None, float("nan"), -1.0, float("inf")]) if rnd.random() < 0.05 else d
        out.append((i, rnd.choice(["hot", "hot", "b", None]), rnd.choice(["f", None, f"g{rnd.randrange(20)}"]), d, 0, 0.0))
    return out + out[:40] + [(None, "hot", "f", 1.0, 0, 0.0)]


def test_exact_percentiles_by_rounds_and_by_sorting(spark):
    d = data(3_000)
    runs = stored(percentiles.summarise(spark.createDataFrame(d, SCHEMA).repartition(7)), "runs")
    want = brute(d)
    for finish in (1, 20, 10_000):
        assert rows(percentiles.percentiles(runs, PS, finish=finish)) == want
    assert rows(percentiles.percentiles(runs, PS, finish=5, max_targets=17)) == want


def test_pieces_combine(spark):
    d = data(1_500, 2)
    df = spark.createDataFrame(d, SCHEMA)
    a, b = (stored(percentiles.summarise(df.where(F.coalesce(F.col("trace_id") % 2, F.lit(0)) == k)), "runs") for k in (0, 1))
    assert rows(percentiles.percentiles(a.unionByName(b), PS)) == brute(d)


def test_an_id_redelivered_in_another_piece_counts_once(spark):
    d = data(900, 5)
    again = [(*x[:4], 1, x[5]) for x in d[:200]]  # the code column serves as the piece
    runs = stored(percentiles.summarise(spark.createDataFrame(d + again, SCHEMA).repartition(5), piece=F.col("code")), "runs")
    assert rows(percentiles.percentiles(runs, PS, finish=20)) == brute(d)
    first = runs.where("piece = 0").agg(F.sum("n")).collect()[0][0]
    assert first == len({x[0] for x in d if x[0] is not None and x[3] is not None and math.isfinite(x[3]) and x[3] >= 0})


def test_each_round_reads_less(spark):
    d = data(4_000, 6)
    runs, kept = stored(percentiles.summarise(spark.createDataFrame(d, SCHEMA).repartition(6)), "runs"), []
    assert rows(percentiles.percentiles(runs, PS, finish=2, log=kept)) == brute(d)
    assert len(kept) > 1 and kept[0] < 4_000 and all(b < a for a, b in zip(kept, kept[1:], strict=False))


def test_bounded_error(spark):
    d = data(1_500, 3)
    runs = stored(percentiles.summarise(spark.createDataFrame(d, SCHEMA), error=0.02), "runs")
    by = {(k, g, p): v for k, g, _, p, v in brute(d)}
    for r in percentiles.percentiles(runs, PS, finish=3).collect():
        assert abs(r.value - by[r.kind, r.key, r.p]) <= 0.0201 * by[r.kind, r.key, r.p]
    assert runs.select(F.max(F.size("values"))).collect()[0][0] < 400


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "p", None, 3.5, 0, 0.0)], SCHEMA)
    assert percentiles.trace_percentiles(df.limit(0), PS).count() == 0
    assert {r.value for r in percentiles.trace_percentiles(df, PS).collect()} == {3.5}
