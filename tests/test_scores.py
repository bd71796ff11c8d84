"""Scores and classes on nulls, empty texts and the cases that their tables name."""

from pyspark.sql import functions as F

from lodespark.operators import scores
from tests.conftest import rows


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", make(F.col("x")).alias("y")).collect())]


def test_scores_of_texts(spark):
    texts = ["Payment AUTH", "", None, "a secret_leak here"]
    assert [round(x, 2) for x in column(spark, texts, "string", lambda c: scores.claim_risk(c, F.lit(True), F.lit(None)))] == [0.65, 0.45, 0.45, 0.45]
    assert column(spark, texts, "string", scores.security) == [0.95, 0.95, 0.95, 0.0]
    assert [round(x, 2) for x in column(spark, ["all safe tests never run fast", "it is so as it is told", None, "x"], "string", lambda c: scores.reflected_confidence(c, F.lit(0.9), F.lit(3)))] == [0.6, 0.9, 0.8, 0.8]


def test_confidence_and_quality(spark):
    assert column(spark, [0.9, 0.1, None], "double", lambda c: scores.supported_confidence(c, F.lit(0))) == [0.30, 0.1, None]
    assert column(spark, [0.9, None], "double", lambda c: scores.supported_confidence(c, F.lit(1))) == [0.9, None]
    assert [round(x, 2) for x in column(spark, [0, 1, None, 4], "int", lambda c: scores.quality(c, c, c, c))] == [0.35, 0.8, 0.35, 0.9]


def test_first_and_last_rules(spark):
    assert column(spark, [True, False, None], "boolean", lambda c: scores.failure_class(F.lit(True), c, F.lit(False), F.lit(False))) == ["patch_scope_failure", "test_failure", "patch_scope_failure"]
    assert column(spark, ["TypeError", "OSError", "PatchError", "E", None], "string", lambda c: scores.error_class(c, F.lit("a timeout"))) == ["validation", "network", "patch", "timeout", "timeout"]
    assert column(spark, ["the guard has no docstring", "it is so fine", "short guard", None], "string", lambda c: scores.hypothesis(c, F.lit("f"))) == ["f handles edge case inputs gracefully", "f exists and is callable", None, None]
    assert column(spark, ["nothing", None, "eval a long request check"], "string", lambda c: F.size(scores.counterfactuals(c))) == [2, 2, 5]
    assert column(spark, [0.9, 0.5, None], "double", lambda c: scores.correction(F.lit("x"), c, F.lit(0), F.lit(0), F.lit(3))) == ["none", "expand_deeper", "expand_deeper"]
    assert column(spark, [1, 9], "int", lambda c: scores.stop_before(F.lit(False), c, F.lit(True), 5)) == ["budget_exhausted", "max_depth"]
    assert column(spark, [0.1, 0.9], "double", lambda c: scores.stop_after(F.lit(0.9), F.lit(0.7), c)) == ["low_novelty", None]


def test_targets_and_causes(spark):
    assert column(spark, ["tests/a.py", "deploy/x.md", "b.PY", None], "string", lambda c: scores.target_score(c, F.lit(True), F.lit("add test"), ("deploy",))) == [4.5, -1.5, 3.0, None]
    seen = spark.createDataFrame([(1, "bare_except", 9.0, "c"), (1, "bare_except", 1.0, "c"), (1, None, 1.0, "c"), (2, "other", 1.0, "c")], "g int, kind string, w double, cause string")
    assert rows(scores.abduced(seen, "g", "kind", "w")) == [(1, 3, 2, 0.77), (2, 1, 0, 0.0)]
    assert sorted(r.likely for r in scores.causes(seen, "g", "kind").collect()) == [False, False, True]
    assert scores.abduced(seen.limit(0), "g", "kind", "w").count() == scores.causes(seen.limit(0), "g", "kind").count() == 0
