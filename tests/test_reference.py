"""Small fixtures of the reference operators' edge semantics."""

import pytest

from lodespark.operators import consensus, feedback, graph, reports, search, tracker
from lodespark.operators import sources_of_code as code
from tests.conftest import rows

A, R, N = "APPROVE", "REJECT", "ABSTAIN"


def decide(spark, votes, strategy, quorum, least=0.5):
    df = spark.createDataFrame([("c", v, float(c), float(w)) for v, c, w in votes], "claim string, verdict string, confidence double, weight double")
    return consensus.decide(df, strategy, quorum, least=least).collect()[0]


@pytest.mark.parametrize(
    "votes, strategy, quorum, verdict, confidence, dissent",
    [
        ([(A, 0.9, 1), (A, 0.8, 1)], "unanimous", 2, A, 0.8, 0),
        ([(A, 0.9, 1), (R, 0.7, 1)], "unanimous", 2, R, 0.3, 1),
        ([(A, 0.9, 1), (A, 0.8, 1), (R, 0.6, 1)], "majority", 2, A, 0.85, 1),
        ([(A, 0.9, 1), (R, 0.8, 2)], "majority", 2, R, 0.8, 1),
        ([(A, 0.9, 1), (R, 0.9, 1)], "supermajority", 2, N, 0.0, 2),
        ([(A, 0.9, 2), (R, 0.5, 1)], "weighted", 2, A, 1.3 / 3, 1),
        ([(A, 0.9, 1)], "threshold", 1, A, 0.9, 0),
        ([(A, 0.9, 1)], "majority", 5, N, 0.0, 0),
        ([(A, 0.5, 1), (R, 0.5, 1)], "majority", 2, R, 0.5, 1),
        ([(N, 0.5, 1), (N, 0.5, 1)], "unanimous", 2, N, 0.0, 0),
        ([(A, 0.9, 1), (R, 0.8, 1), (A, 0.7, 1)], "no such", 2, A, 0.8, 1),
    ],
)
def test_votes(spark, votes, strategy, quorum, verdict, confidence, dissent):
    r = decide(spark, votes, strategy, quorum)
    assert (r.verdict, round(r.confidence, 6), r.n_dissent) == (verdict, round(confidence, 6), dissent)


def test_threshold_needs_sure_votes(spark):
    assert decide(spark, [(A, 0.7, 1), (R, 0.9, 1)], "threshold", 2, 0.8).verdict == R


def test_null_votes(spark):
    df = spark.createDataFrame([("c", None, None, None), ("c", A, None, None)], "claim string, verdict string, confidence double, weight double")
    r = consensus.decide(df, "majority").collect()[0]
    assert (r.verdict, r.confidence, r.n_votes) == (A, 0.0, 2)


def test_tracker_states(spark):
    seen = spark.createDataFrame([("new", 3), ("gap", 1), ("gap", 3), ("all", 1), ("all", 2), ("all", 3), ("late", 2), ("late", 3), ("gone", 1), ("gone", 1), (None, 1)], "k string, run int")
    got = {r.k: (r.status, r.run_count, r.first_run, r.last_run) for r in tracker.track(seen, "k", "run").collect()}
    assert got == {"new": ("open", 1, 3, 3), "gap": ("potentially_resolved", 2, 1, 3), "all": ("still_open", 3, 1, 3), "late": ("still_open", 2, 2, 3), "gone": ("potentially_resolved", 1, 1, 1)}


def test_merge_keeps_closed_states(spark):
    was = spark.createDataFrame([("a", "open", 1), ("b", "still_open", 2), ("c", "potentially_resolved", 1), ("d", "resolved", 4)], "k string, status string, run_count long")
    now = spark.createDataFrame([("a",), ("c",), ("d",), ("e",)], "k string")
    assert rows(tracker.merge(was, now, "k")) == [("a", "still_open", 2), ("b", "potentially_resolved", 2), ("c", "potentially_resolved", 2), ("d", "resolved", 5), ("e", "open", 1)]


def test_moving_average_equals_a_fold(spark):
    import random

    rnd = random.Random(1)
    data = [(rnd.choice("aab"), i * 7, rnd.choice([None, 0.0, 1.0])) for i in range(300)]
    got = {r.k: r.ema for r in feedback.moving_average(spark.createDataFrame(data, "k string, o long, x double"), "k", ["o"], "x", block=200).collect()}
    for k in "ab":
        ema = 0.5
        for kk, _, x in data:
            if kk == k and x is not None:
                ema = 0.7 * ema + 0.3 * x
        assert got[k] == pytest.approx(ema)


def test_ema_of_success_failure_success(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 0.0), ("p", 3, 1.0)], "k string, o long, x double")
    assert feedback.moving_average(df, "k", ["o"], "x").collect()[0].ema == pytest.approx(0.6185)


def test_confidence_update_is_clamped(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.9, 1.0), (0.9, -0.5), (0.1, -1.0), (0.9, 2.0)], "o double, s double")
    assert [round(r[0], 6) for r in df.select(feedback.updated_confidence(F.col("o"), F.col("s"))).collect()] == [0.93, 0.48, 0.0, 1.0]


def test_decayed_mean(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 0.0), (0.0, 30.0)], "s double, d double")
    assert df.agg(feedback.decayed_mean(F.col("s"), F.col("d"))).collect()[0][0] == pytest.approx(2 / 3)
    assert df.limit(0).agg(feedback.decayed_mean(F.col("s"), F.col("d"))).collect()[0][0] == 0


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "service.py", "def calculate_risk(): return 'market risk'"), (2, "b.py", "nothing"), (3, "market.py", None)], "id int, path string, text string")
    assert search.keywords("market risk calculation") == ["market", "risk", "calculation"]
    got = search.keyword_search(docs, "market risk calculation", 3, "id", "text", "path").collect()
    assert [(r.id, r.score) for r in got] == [(1, 3), (3, 2)]
    assert search.keyword_search(docs, "of it", 3, "id", "text", "path").count() == 0


def test_bow_cosine(spark):
    docs = spark.createDataFrame([(1, "eval() found in auth.py"), (2, "os.system() in shell.py")], "id int, text string")
    asked = spark.createDataFrame([(1, "eval usage detected"), (2, "eval() found in auth.py")], "qid int, query string")
    got = {(r.qid, r.id): r.score for r in search.bow_cosine(docs, asked, 5, "id", "text").collect()}
    assert got[1, 1] == pytest.approx(0.447) and got[2, 1] == 1.0
    assert got[1, 2] == 0.0 and len(got) == 4  # a text without a common word is listed with score 0
    nothing = spark.createDataFrame([(7, "zzz"), (8, None)], "qid int, query string")
    assert rows(search.bow_cosine(docs, nothing, 1, "id", "text")) == [(7, 1, 0.0), (8, 1, 0.0)]


def test_dense_cosine_in_blocks_equals_one_block(spark):
    import random

    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, None)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    one = rows(search.dense_cosine(df, 3, "id", "v", every=5))
    assert one == rows(search.dense_cosine(df, 3, "id", "v", every=5, block=4)) and len(one) == 36
    assert search.dense_cosine(df.limit(0), 3, "id", "v").count() == 0


def test_dense_cosine_takes_the_smallest_ids_of_copies(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(400, 0, -1)] + [(1000 + i, [1.0, -float(i), 0.0]) for i in range(50)]
    df = spark.createDataFrame(data, "id long, v array<double>").coalesce(1)
    got = rows(search.dense_cosine(df, 5, "id", "v", every=100).where("qid <= 400"))
    assert got == sorted(((q, i, 1.0) for q in (100, 200, 300, 400) for i in range(1, 6)), key=repr)


def test_searches_with_texts_keep_zeros_and_leave_out_the_query(spark):
    data = [(100, "eval usage (detected)", "a"), (1, "nothing", "usage.py"), (2, "eval usage. Eval", None), (3, None, "detected"), (200, "", None), (4, "", "x")]
    df = spark.createDataFrame(data, "id long, text string, path string")
    for block in (1, 10):
        got = rows(search.bow_cosine_all(df, 3, "id", "text", block=block))
        assert got == [(100, 1, 0.0), (100, 2, 0.775), (100, 4, 0.0), (200, 1, 0.0), (200, 2, 0.0), (200, 4, 0.0)]
        found = rows(search.keyword_search_all(df, 3, "id", "text", "path", block=block))
        assert found == [(100, 1, "usage.py", 2, "nothing"), (100, 2, None, 3, "eval usage. Eval"), (100, 3, "detected", 2, None)]


def test_traced_cycles_of_any_length(spark, tmp_path):
    import __spark_entry__ as entry

    data = [(i, "r", "call_enter", i, f"f{i % 7}", i) for i in range(8)]
    df = spark.createDataFrame(data, "trace_id long, run_id string, phase string, t long, function_name string, stack_depth int")
    df.selectExpr("trace_id", "run_id", "phase", "timestamp_seconds(t) ts", "function_name", "stack_depth").write.parquet(f"{tmp_path}/traces.parquet")
    assert rows(entry.queries()["trace_call_cycles"](spark, str(tmp_path))) == [(f"f{i}", 7) for i in range(7)]


def test_graph(spark):
    e = graph.edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), (None, "a"), ("a", "b")], "s string, t string"), "s", "t")
    assert e.count() == 4
    got = rows(graph.reachable(e, spark.createDataFrame([("a",), ("d",)], "n string")))
    assert got == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(graph.cycle_nodes(e)) == [("a", 3), ("b", 3), ("c", 3)]
    assert rows(graph.reachable(e, spark.createDataFrame([("a",)], "n string"), max_depth=1)) == [("a", "b", 1)]
    assert graph.hubs(e, 1).collect()[0].node == "c"
    names = spark.createDataFrame([("app.core.x.f",), ("z",)], "n string")
    known = spark.createDataFrame([("app",), ("app.core",)], "m string")
    assert rows(graph.resolve_longest(names, "n", known, "m")) == [("app.core.x.f", "app.core"), ("z", None)]


def test_branch_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 27, 701, 702, 18277, 18278, None, -1)], "i int")
    assert [r[0] for r in df.select(graph.branch_token(F.col("i"))).collect()] == ["a", "z", "aa", "ab", "zz", "aaa", "zzz", "aaaa", None, None]


def test_python_facts():
    src = "import os\nfrom a.b import c\ndef f(x):\n    try:\n        return eval(x)\n    except:\n        model.eval()\n        re.compile('x')\n"
    got = list(code.facts(src))
    assert ("import", "os", 1, 0.0) in got and ("import", "a.b", 2, 0.0) in got
    assert [g[1] for g in got if g[0] == "risk"] == ["critical:eval", "critical:model.eval"]
    assert [g[3] for g in got if g[0] == "function"] == [0.9]
    assert [g[2] for g in got if g[0] == "bare_except"] == [6]
    assert list(code.facts("def broken(")) == [] and list(code.facts("")) == []


def test_reports(spark):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([("x_total", 'a"b', None, 3)], "name string, l string, k string, v int")
    assert reports.exposition(m, "name", ["l", "k"], "v").collect()[0].line == 'x_total{l="a\\"b"} 3'
    assert m.select(reports.metric_kind(F.col("name"))).collect()[0][0] == "counter"
    assert m.select(reports.bar(F.lit(0.5), 4)).collect()[0][0] == "##.."


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_clamped_walk_equals_a_fold(spark):
    import random

    from lodespark.operators import rules

    rnd = random.Random(3)
    data = [(rnd.choice("aaab"), i, rnd.random() < 0.3 if i < 200 else rnd.random() < 0.95) for i in range(400)] + [("c", 1, True), (None, 2, True), ("a", 900, None)]
    got = {r.k: r.rate for r in rules.clamped_walk(spark.createDataFrame(data, "k string, o int, g boolean"), "k", ["o"], "g", block=7).collect()}
    for k in "ab":
        x = 1.0
        for _, _, g in [d for d in data if d[0] == k and d[2] is not None][4:]:
            x = min(1.0, max(0.1, 0.95 * x + (0.05 if g else -0.05)))
        assert got[k] == pytest.approx(x)
    assert set(got) == {"a", "b"}


def test_debate_softens_unsure_approvals(spark):
    votes = [("c", "security_auditor", R, 0.9, 1.0), ("c", "x", A, 0.6, 1.5), ("c", "y", A, 0.9, 0.2), ("d", "x", A, 0.5, 1.0), ("d", "y", A, 0.5, 1.0)]
    df = spark.createDataFrame(votes, "claim string, agent_role string, verdict string, confidence double, weight double")
    after = rows(consensus.debate(df))
    assert ("c", "x", N, 0.3, 1.5) in after and ("c", "y", A, 0.9, 0.2) in after and ("d", "x", A, 0.5, 1.0) in after
    assert rows(consensus.debate(consensus.debate(df))) == after
    assert {r.claim: r.verdict for r in consensus.decide(consensus.debate(df)).collect()} == {"c": R, "d": A}


def test_rules(spark):
    from pyspark.sql import functions as F

    from lodespark.operators import rules

    df = spark.createDataFrame([("ab",), ("b",), ("",), (None,)], "t string")
    rs = [(F.contains("t", F.lit("a")), "A"), (F.contains("t", F.lit("b")), "B")]
    assert [r[0] for r in df.select(rules.first_rule(rs, "-")).collect()] == ["A", "B", "-", "-"]
    assert [r[0] for r in df.select(rules.last_rule(rs, "-")).collect()] == ["B", "B", "-", "-"]
    assert [r[0] for r in df.select(rules.all_rules(rs, 1, ("x", "y"))).collect()] == [["A"], ["B"], ["x", "y"], ["x", "y"]]
    chain = rules.why_chain(spark.createDataFrame([("Unchecked EVAL",), ("x",)], "issue string"), "issue")
    mean = {r.issue: round(r.m, 4) for r in chain.groupBy("issue").agg(F.avg("confidence").alias("m")).collect()}
    assert mean == {"Unchecked EVAL": 0.86, "x": 0.75}
    s = spark.createDataFrame([("This sentence is surely long enough. What is it? Short. This sentence is surely long enough. Another one that is long enough!",)], "t string")
    assert s.select(rules.sentences(F.col("t"))).collect()[0][0] == ["This sentence is surely long enough", "Another one that is long enough!"]


def test_a_dropped_row_drops_no_other(spark):
    import datetime as dt
    import random

    from lodespark.operators import feedback

    t0 = dt.datetime(2031, 1, 1, 23, 50)
    rnd = random.Random(4)
    data = [("a", t0 + dt.timedelta(seconds=s), i, "x") for i, s in enumerate((0, 200, 400, 650, 701, 1500, 86_000, 86_200, 86_400))]
    data += [(rnd.choice(["hot", None, "c"]), t0 + dt.timedelta(seconds=rnd.choice([rnd.randrange(200_000), 600 * rnd.randrange(300)])), 100 + i, "x") for i in range(900)]
    data += [("a", None, 5000, "x"), ("a", None, 5001, "x")]
    want, last = {5000, 5001}, {}
    for k, t, i, _ in sorted((d for d in data if d[1]), key=lambda d: (str(d[0]), d[1], d[2])):
        if k not in last or (t - last[k]).total_seconds() > 300:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, i long, _b string")
    got = feedback.within_seconds(df.withColumnRenamed("_b", "block"), ["k"], "ts", "i")
    assert {r.i for r in got.collect()} == want and got.columns == ["k", "ts", "i", "block"]
    assert {0, 2, 4, 5} <= want and 1 not in want
    assert feedback.within_seconds(df.limit(0), ["k"], "ts", "i").count() == 0


def test_contained_terms_in_blocks(spark):
    texts = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "xbc")], "id int, t string")
    terms = spark.createDataFrame([("ab",), ("bc",), ("bc",), (None,), ("",), ("c",)], "w string")
    for block in (1, 2, 100):
        assert rows(search.contained(texts, "t", terms, "w", block).select("id", "w")) == [(1, "ab"), (1, "bc"), (1, "c"), (4, "bc"), (4, "c")]
    assert search.contained(texts, "t", terms.limit(0), "w").count() == 0


def test_ranks_without_a_window(spark):
    from lodespark.joins import ranked

    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n int").repartition(5)
    assert rows(ranked(df, "n", "place")) == sorted([(i, i + 1) for i in range(101)], key=repr)
    assert ranked(df.limit(0), "n", "place").count() == 0


def test_trimming_keeps_cycles_only(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "a"), ("d", "e")], "src string, dst string")
    assert rows(graph.trimmed(e)) == [("a", "b"), ("b", "a")]
    assert rows(graph.cycle_nodes(e)) == [("a", 2), ("b", 2)]
    assert graph.cycle_nodes(e.where("src = 'c'")).count() == 0


def test_all_kinds_of_findings_in_code():
    src = "def f(a):\n  'd'\n  cursor.execute(f'select {a}')\n  compile(a, '', 'exec')\n  re.compile(a)\n  yaml.unsafe_load(a)\n  pickle.loads(a)\n  subprocess.call(a)\n  ast.literal_eval(a)\n" + "  x = 1\n" * 50
    got = [(k, n) for k, n, *_ in code.facts(src)]
    assert [n for k, n in got if k == "risk"] == ["high:compile", "critical:yaml.unsafe_load", "critical:pickle.loads", "high:subprocess.call"]
    assert ("fstring_sql", "cursor.execute") in got and ("long_function", "f") in got


def test_secret_lines(spark):
    lines = ['PASSWORD = "hunter2"', "password = 'test'", 'api_key="abc"', 'db_url = "x" or config.get("y")', "pwd = os.environ['x']", None, "connection_string = 'a=b'"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string")
    assert rows(code.secret_lines(df).select("id", "risk_type")) == [(0, "hardcoded_password"), (2, "hardcoded_secret"), (6, "hardcoded_connection")]
