"""Rule tables as expressions: the first that holds, all that hold, the last; roll-ups of gates; weighted scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def first_rule(rules: Sequence[Rule], default: str | None = None) -> Column:
    """The result of the first rule that holds; a null condition does not."""
    out = None
    for cond, result in rules:
        out = F.when(F.coalesce(cond, F.lit(False)), result) if out is None else out.when(F.coalesce(cond, F.lit(False)), result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def last_rule(rules: Sequence[Rule], default: str | None = None) -> Column:
    """The result of the last rule that holds."""
    return first_rule(list(reversed(rules)), default)


def all_rules(rules: Sequence[Rule], cap: int, fallback: Sequence[str] = ()) -> Column:
    """The different results of all rules that hold, in order, at most ``cap``; the fallback if there is none."""
    hit = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), r) for c, r in rules)))
    hit = F.array_distinct(hit)
    return F.when(F.size(hit) > 0, F.slice(hit, 1, cap)).otherwise(F.array(*map(F.lit, fallback)).cast("array<string>"))


def gates(passed: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Whether all gates pass, how many do, and "k/n passed"; a null gate is not passed."""
    n = sum((F.coalesce(p.cast("int"), F.lit(0)) for p in passed), F.lit(0))
    return n == len(passed), n, F.concat(n.cast("string"), F.lit(f"/{len(passed)} passed"))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    """A weighted sum."""
    out = F.lit(0.0)
    for w, c in parts:
        out = out + F.lit(w) * c
    return out


# Fixed values: (impact, risk) of each claim type, and the types that lack evidence most.
CLAIM_WEIGHTS = {
    "security": (0.95, 0.95), "validation": (0.85, 0.75), "architecture": (0.80, 0.65), "automation": (0.75, 0.60),
    "configuration": (0.78, 0.70), "feature_gap": (0.72, 0.72), "operations": (0.70, 0.68), "general": (0.55, 0.45),
}
WIDE_GAP = ("security", "feature_gap", "validation")


def claim_priority(claim_type: Column, claim: Column) -> Column:
    """.35 impact + .30 risk + .20 novelty + .15 gap: longer claims are taken as more novel."""
    base = {t: 0.35 * impact + 0.30 * risk + 0.15 * (0.75 if t in WIDE_GAP else 0.50) for t, (impact, risk) in CLAIM_WEIGHTS.items()}
    by_type = F.create_map(*(F.lit(x) for pair in base.items() for x in pair))
    return F.try_element_at(by_type, claim_type) + 0.20 * F.when(F.length(claim) > 40, 0.80).otherwise(0.65)


# Kinds of questions with impact, uncertainty and risk.
QUESTIONS = (("missing", 0.9, 0.9, 0.5), ("contradiction", 0.8, 0.7, 0.6), ("risk", 0.7, 0.6, 0.9), ("deepening", 0.75, 0.7, 0.4))


def top_questions(claims: DataFrame, novelty: Column, k: int = 2) -> DataFrame:
    """All columns and qtype, priority, place of the k best questions of each row; the first of equals. By explode, without a join or shuffle."""
    q = F.array(*(F.struct((-F.round(weighted([(0.35, F.lit(i)), (0.25, F.lit(u)), (0.20, F.lit(r)), (0.20, novelty)]), 6)).alias("p"), F.lit(n).alias("n"), F.lit(t).alias("t")) for n, (t, i, u, r) in enumerate(QUESTIONS)))
    best = F.slice(F.array_sort(q), 1, k)
    return claims.select(*claims.columns, F.posexplode(best).alias("_i", "_s")).select(
        *claims.columns, F.col("_s.t").alias("qtype"), (-F.col("_s.p")).alias("priority"), (F.col("_i") + 1).alias("place")
    )


def evidence_confidence(n_for: Column, n_against: Column) -> Column:
    """A step function of how much speaks for a claim and how much against it."""
    return F.when(n_for == 0, 0.25).when(n_against >= n_for, 0.45).when((n_for >= 3) & (n_against == 0), 0.85).otherwise(0.65)


def viable(claim: Column) -> Column:
    """Whether a text can be a claim: 24 characters or more, no question, mostly words."""
    low = F.lower(F.trim(claim))
    odd = F.length(F.regexp_replace(low, r"[a-z0-9_/.\-]", ""))
    return F.coalesce((F.length(low) >= 24) & ~low.startswith("what ") & ~F.contains(low, F.lit("?")) & (odd <= F.length(low) * 0.4), F.lit(False))


def sentences(text: Column, limit: int = 5) -> Column:
    """The first ``limit`` different viable sentences of a text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.split(flat, r"(?<=[!?])\s+|(?<=[A-Za-z0-9])\.\s+")
    return F.slice(F.array_distinct(F.filter(parts, viable)), 1, limit)


# Confidence of each answer of a why-chain by the issue's class, levels 1 to 5.
WHY = {
    "eval": (1.0, 0.9, 0.75, 0.85, 0.8),
    "os.system": (1.0, 0.85, 0.6, 0.85, 0.8),
    "missing_docstring": (1.0, 0.8, 0.8, 0.85, 0.8),
    "": (1.0, 0.5, 0.6, 0.85, 0.8),
}


def why_chain(findings: DataFrame, issue: str, max_depth: int = 5, least: float = 0.3) -> DataFrame:
    """All columns and level, confidence: the chain of whys of each finding; it ends before the first answer below ``least``."""
    low = F.lower(F.coalesce(issue, F.lit("")))
    rows = None
    for name, conf in WHY.items():
        kept = []
        for level, c in enumerate(conf[:max_depth], 1):
            if c < least and level > 1:
                break
            kept.append(F.struct(F.lit(level).alias("level"), F.lit(c).alias("confidence")))
        chain = F.array(*kept)
        rows = F.when(F.contains(low, F.lit(name)), chain) if rows is None else (rows.when(F.contains(low, F.lit(name)), chain) if name else rows.otherwise(chain))
    return findings.select(*findings.columns, F.explode(rows).alias("_c")).select(*findings.columns, "_c.*")


def tree_action(severity: Column, aggregate: Column) -> Column:
    """What to do about a finding by its severity and the confidence of its tree."""
    s = F.lower(severity)
    return first_rule([((s == "critical") & (aggregate > 0.7), "patch"), (s.isin("critical", "high") & (aggregate > 0.5), "review"), (aggregate < 0.3, "ignore")], "escalate")


def clamped_walk(rows: DataFrame, key: str, order: list[str], good: str, start: float = 1.0, keep: float = 0.95, step: float = 0.05, low: float = 0.1, high: float = 1.0, skip: int = 4, block: int = 10_000) -> DataFrame:
    """key, n, rate: x becomes keep * x + step on success and keep * x - step on failure, held within low and high; the first ``skip`` rows of a key don't count.

    A step is the map x -> min(h, max(l, a x + b)), and such maps compose to one of the same form. So rows
    are folded in blocks of bounded size, in parallel, and a key's few blocks are composed in order.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.where(F.col(key).isNotNull() & F.col(good).isNotNull()).withColumn("_i", F.row_number().over(w)).where(F.col("_i") > skip)
    one = F.struct(F.col("_i"), F.when(F.col(good), F.lit(step)).otherwise(F.lit(-step)).alias("b"))
    blocks = numbered.groupBy(key, F.floor(F.col("_i") / block).alias("_b")).agg(F.array_sort(F.collect_list(one)).alias("l"), F.count("*").alias("n"))
    ident = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("l"), F.lit(float("inf")).alias("h"))

    def then(f: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
        fit = lambda x: F.least(hi, F.greatest(lo, a * x + b))
        return F.struct((a * f["a"]).alias("a"), (a * f["b"] + b).alias("b"), fit(f["l"]).alias("l"), fit(f["h"]).alias("h"))

    folded = blocks.select(key, "_b", "n", F.aggregate("l", ident, lambda f, x: then(f, F.lit(keep), x["b"], F.lit(low), F.lit(high))).alias("f"))
    whole = folded.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("fs"))
    f = F.aggregate("fs", ident, lambda f, x: then(f, x["f"]["a"], x["f"]["b"], x["f"]["l"], x["f"]["h"]))
    return whole.select(key, "n", f.alias("f")).select(key, "n", F.least(F.col("f.h"), F.greatest(F.col("f.l"), F.col("f.a") * start + F.col("f.b"))).alias("rate"))
