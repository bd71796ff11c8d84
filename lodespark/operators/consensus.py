"""Weighted voting: five strategies over one aggregation of the votes of a claim.

Sums and extremes of all strategies are partial aggregates, so a claim with a third of all votes is
combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVE, REJECT, ABSTAIN = "APPROVE", "REJECT", "ABSTAIN"
Ruling = tuple[Column, Column, Column]  # verdict, confidence, whether a quorum stood


def _of(verdict: str, value: Column) -> Column:
    return F.when(F.col("verdict") == verdict, value)


def tally(votes: DataFrame, claim: str = "claim", least: float = 0.5) -> DataFrame:
    """One row for each claim with what all strategies need; null confidence counts 0, null weight 1, null verdict as abstention."""
    v = votes.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "weight": F.coalesce("weight", F.lit(1.0)), "verdict": F.coalesce("verdict", F.lit(ABSTAIN))})
    conf, weight = F.col("confidence"), F.col("weight")
    sides = []
    for name, side in (("a", APPROVE), ("r", REJECT)):
        sides += [
            F.count(_of(side, F.lit(1))).alias(f"{name}_n"),
            F.coalesce(F.sum(_of(side, weight)), F.lit(0.0)).alias(f"{name}_w"),
            F.coalesce(F.sum(_of(side, conf * weight)), F.lit(0.0)).alias(f"{name}_cw"),
            F.min(_of(side, conf)).alias(f"{name}_min"),
            F.max(_of(side, conf)).alias(f"{name}_max"),
            F.max(F.when((F.col("verdict") == side) & (conf >= least), conf)).alias(f"{name}_over"),
        ]
    return v.groupBy(claim).agg(F.count("*").alias("n_votes"), *sides)


def _zero() -> Column:
    return F.lit(0.0)


def unanimous() -> Ruling:
    """Approved only without any rejection; a rejection's confidence is what its surest voter leaves open."""
    any_vote = (F.col("a_n") + F.col("r_n")) > 0
    verdict = F.when(~any_vote, ABSTAIN).when(F.col("r_n") == 0, APPROVE).otherwise(REJECT)
    conf = F.when(~any_vote, _zero()).when(F.col("r_n") == 0, F.col("a_min")).otherwise(1.0 - F.col("r_max"))
    return verdict, conf, any_vote


def _mean(side: str) -> Column:
    return F.when(F.col(f"{side}_w") != 0, F.col(f"{side}_cw") / F.col(f"{side}_w")).otherwise(_zero())


def majority() -> Ruling:
    """More than half of the weight approves; a tie rejects."""
    total = F.col("a_w") + F.col("r_w")
    wins = F.col("a_w") / F.nullif(total, F.lit(0.0)) > 0.5
    verdict = F.when(total == 0, ABSTAIN).when(wins, APPROVE).otherwise(REJECT)
    return verdict, F.when(total == 0, _zero()).when(wins, _mean("a")).otherwise(_mean("r")), total != 0


def supermajority() -> Ruling:
    """Two thirds of the weight decide; else nothing is decided."""
    total = F.col("a_w") + F.col("r_w")
    share = lambda s: F.col(f"{s}_w") / F.nullif(total, F.lit(0.0)) >= 2 / 3
    verdict = F.when(share("a"), APPROVE).when(share("r"), REJECT).otherwise(ABSTAIN)
    return verdict, F.when(share("a"), _mean("a")).when(share("r"), _mean("r")).otherwise(_zero()), total != 0


def weighted() -> Ruling:
    """The sign of the weighted mean of signed confidences; sums are compared to nine places, so their order does not matter."""
    total = F.col("a_w") + F.col("r_w")
    score = F.coalesce(F.round(F.col("a_cw") - F.col("r_cw"), 9) / F.nullif(total, F.lit(0.0)), _zero())
    return F.when(score > 0, APPROVE).when(score < 0, REJECT).otherwise(ABSTAIN), F.abs(score), total != 0


def threshold() -> Ruling:
    """Any sure enough approval decides before any sure enough rejection."""
    a, r = F.col("a_over"), F.col("r_over")
    return F.when(a.isNotNull(), APPROVE).when(r.isNotNull(), REJECT).otherwise(ABSTAIN), F.coalesce(a, r, _zero()), F.lit(True)


STRATEGIES: dict[str, Callable[[], Ruling]] = {"unanimous": unanimous, "majority": majority, "supermajority": supermajority, "weighted": weighted, "threshold": threshold}


def decide(votes: DataFrame, strategy: str = "majority", quorum: int = 2, claim: str = "claim", least: float = 0.5) -> DataFrame:
    """claim, n_votes, verdict, confidence, quorum_reached, n_dissent. An unknown strategy is majority; too few votes abstain.

    Dissent counts the votes of neither the verdict nor abstention; where the verdict is abstention
    with a quorum, all votes of either side dissent.
    """
    t = tally(votes, claim, least)
    verdict, conf, stood = STRATEGIES.get(strategy, majority)()
    enough = F.col("n_votes") >= quorum
    out = t.select(
        claim,
        "n_votes",
        F.when(enough, verdict).otherwise(ABSTAIN).alias("verdict"),
        F.when(enough, conf).otherwise(_zero()).alias("confidence"),
        F.coalesce(enough & stood, F.lit(False)).alias("quorum_reached"),
        "a_n",
        "r_n",
    )
    against = F.when(F.col("verdict") == APPROVE, F.col("r_n")).when(F.col("verdict") == REJECT, F.col("a_n")).otherwise(F.col("a_n") + F.col("r_n"))
    return out.withColumn("n_dissent", F.when(F.col("n_votes") >= quorum, against).otherwise(F.lit(0)).cast("long")).drop("a_n", "r_n")


# The panel's roles with their weights, words and what they vote on a hit and otherwise.
PANEL = (
    ("security_auditor", 1.5, ("eval", "exec", "os.system", "pickle", "secret", "password", "sql"), (REJECT, 0.85), (APPROVE, 0.7)),
    ("documentation_enforcer", 0.8, ("docstring", "document", "missing"), (APPROVE, 0.8), (ABSTAIN, 0.5)),
    ("test_coverage_analyst", 1.0, ("test", "coverage", "untested"), (APPROVE, 0.75), (ABSTAIN, 0.5)),
    ("architecture_analyst", 1.2, ("dependency", "coupling", "module", "import", "hub", "boundary"), (APPROVE, 0.8), (ABSTAIN, 0.5)),
)


def panel_votes(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """All columns and agent_role, verdict, confidence, weight: one vote of each role on each row, by explode (no join)."""
    text = F.lower(F.col(claim))
    votes = []
    for role, weight, words, hit, miss in PANEL:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        votes.append(
            F.struct(
                F.lit(role).alias("agent_role"),
                F.when(found, hit[0]).otherwise(miss[0]).alias("verdict"),
                F.when(found, hit[1]).otherwise(miss[1]).alias("confidence"),
                F.lit(weight).alias("weight"),
            )
        )
    return claims.withColumn("_v", F.explode(F.array(*votes))).select(*claims.columns, "_v.*")


# Claim types in their order of precedence with their words.
CLAIM_TYPES = (
    ("architecture", ("architecture", "module", "boundary", "entrypoint", "control flow", "subsystem")),
    ("validation", ("test", "validation", "coverage", "assert", "quality")),
    ("security", ("security", "auth", "token", "secret", "credential", "payment", "billing")),
    ("configuration", ("config", "configuration", "environment", "env", "setting", "dependency")),
    ("automation", ("ci", "workflow", "pipeline", "automation", "build", "deploy")),
    ("feature_gap", ("gap", "missing", "should", "lack", "not detected", "under-specified")),
    ("operations", ("runtime", "operations", "monitoring", "logging", "service", "server")),
)


def best_label(text: Column, labels: tuple = CLAIM_TYPES, default: str = "general") -> Column:
    """The label of which most words occur in the text; the first of equals; the default if none occurs."""
    low = F.lower(text)
    hits = []
    for _, words in labels:
        n = F.lit(0)
        for w in words:
            n = n + F.contains(low, F.lit(w)).cast("int")
        hits.append(n)
    most = F.greatest(*hits)
    out = F.when(most.isNull() | (most == 0), default)
    for (name, _), n in zip(labels, hits, strict=True):
        out = out.when(n == most, name)
    return out


def debate(votes: DataFrame, strategy: str = "majority", quorum: int = 2, claim: str = "claim", persuasive: str = "security_auditor") -> DataFrame:
    """The votes after dissent was heard: where a voter of the persuasive role dissents, less sure approvals become abstentions.

    An approval that .3 less confidence would bring below .4 abstains with .3; surer ones stay as they
    were, so a second hearing changes nothing more and the rounds have a closed form. Votes need
    agent_role. A claim's ruling and whether it is persuaded are one aggregate; votes are joined to it.
    """
    ruled = decide(votes, strategy, quorum, claim).select(claim, F.col("verdict").alias("_ruled"), F.col("n_dissent").alias("_d"))
    sides = votes.where(F.col("agent_role") == persuasive).groupBy(claim).agg(F.max((F.col("verdict") == APPROVE).cast("int")).alias("_pa"), F.max((F.col("verdict") == REJECT).cast("int")).alias("_pr"))
    heard = ruled.join(sides, claim).where((F.col("_d") > 0) & ((F.col("_pr") == 1) & (F.col("_ruled") != REJECT) | (F.col("_pa") == 1) & (F.col("_ruled") != APPROVE)))
    j = votes.join(heard.select(claim, F.lit(True).alias("_heard")), claim, "left")
    soft = F.col("_heard") & (F.col("verdict") == APPROVE) & (F.coalesce("agent_role", F.lit("")) != persuasive) & (F.greatest(F.lit(0.1), F.col("confidence") - 0.3) < 0.4)
    soft = F.coalesce(soft, F.lit(False))
    return j.withColumns({"verdict": F.when(soft, ABSTAIN).otherwise(F.col("verdict")), "confidence": F.when(soft, 0.3).otherwise(F.col("confidence"))}).select(*votes.columns)
