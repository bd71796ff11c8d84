"""Scores and classes of claims, nodes, failures and edit targets, as expressions; causes of observations by a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.operators.rules import Rule, all_rules, first_rule, last_rule

# Words of risky subjects, and substrings that veto a claim.
RISKY_SUBJECTS = ("security", "finance", "medical", "health", "market", "auth", "payment")
BLOCKED = ("unsafe_tool", "secret_leak", "policy_violation")
# Words of absolute claims, and words that call for a counter-example.
ABSOLUTE = ("all", "every", "always", "never", "no ", "none")
COUNTER = (("secure", "safe"), ("all", "every"), ("test", "coverage"), ("fast", "performance"), ("no ", "never"), ("thread", "concurrent"))
# What tells a claim about claims.
META = ("claim about", "previous claim", "claim that", "meta-claim", "recursive claim")
# Which words of a claim raise which questions.
WHAT_IFS = (
    (("validation", "guard", "check", "sanitize"), (
        "What if an attacker provides None or malformed input?",
        "What if the input is at the maximum possible size?",
        "What if the input contains unicode null bytes or escape sequences?",
    )),
    (("eval", "exec"), (
        "What if the expression string contains '__import__('os').system('rm -rf /')'?",
        "What if a trusted user accidentally passes user-controlled input?",
    )),
    (("docstring", "documented"), (
        "What if a new developer joins and cannot understand the function's contract?",
        "What if the function behavior changes but the callers assume the old contract?",
    )),
    (("network", "request", "fetch", "call"), (
        "What if the remote server is down or responds with a 500 error?",
        "What if the connection hangs indefinitely (no timeout)?",
        "What if DNS resolution fails or the network is partitioned?",
    )),
    (("hardcoded", "secret", "password"), (
        "What if the source code is leaked or committed to a public repository?",
        "What if the hardcoded value needs to change across environments (dev/staging/prod)?",
    )),
    (("bare except",), (
        "What if a KeyboardInterrupt or SystemExit is silently swallowed?",
        "What if an unrelated bug is masked because all exceptions are caught?",
    )),
    (("long", "complex"), (
        "What if a bug exists in line 40 but tests only cover lines 1-10?",
        "What if two developers modify different parts of this function simultaneously?",
    )),
    (("mutable default", "default arg"), ("What if the function is called twice — does the default list accumulate state?",)),
)
OTHERWISE = (
    "What if the claim holds in the current codebase but fails after the next refactoring?",
    "What if the observed pattern is actually a symptom of a deeper architectural issue?",
)
# Which words of a claim give which hypothesis about its target; the last that holds counts.
HYPOTHESES = (
    (("input validation", "no guard", "lacks validation", "not validated"), " raises ValueError on invalid input"),
    (("docstring", "documented"), " has a non-empty docstring"),
    (("eval",), " does not use eval() on untrusted data"),
    (("type annotation", "typing", "not typed"), " has type annotations on all parameters"),
    (("zero", "division", "guard"), " handles edge case inputs gracefully"),
    (("bare except", "except:"), " catches specific exceptions only"),
)
EXISTS = " exists and is callable"
# The causes of each kind of observation, the likeliest first.
CAUSES = {
    "long_function": ("Function has multiple responsibilities (SRP violation)", "Lack of helper function extraction", "Accumulated technical debt without refactoring"),
    "many_arguments": ("Function depends on too many data sources", "Missing parameter object or data class", "Feature envy — function may belong to another module"),
    "high_import_count": ("Module is a 'god module' with too many concerns", "Low cohesion — unrelated functionality grouped together", "Possible circular dependency risk"),
    "bare_except": ("Developer was unsure which exceptions to catch", "Error handling was added as an afterthought", "Missing domain-specific exception hierarchy"),
    "missing_docstring": ("Rapid prototyping without documentation discipline", "Developer assumed code was self-explanatory", "Missing code review process that checks documentation"),
    "unused_import": ("Refactoring left dead imports behind", "Copy-paste coding from another module", "Lack of automated linting (e.g. flake8)"),
    "deep_nesting": ("Complex conditional logic without early returns", "Missing guard clause pattern adoption", "State machine or strategy pattern could simplify"),
    "mutable_default_arg": ("Python gotcha — mutable default arguments are dangerous", "Developer unfamiliar with Python's default argument behavior", "Missing static analysis tools that catch this"),
    "eval_usage": ("Developer chose convenience over security", "Lack of secure parsing alternatives awareness", "Missing security review in development process"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text, in lower case, holds any of the words; false for null."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def supported_confidence(confidence: Column, n_for: Column) -> Column:
    """A confidence without support is 0.30 at most; null stays null."""
    return F.when(F.coalesce(n_for, F.lit(0)) == 0, F.when(confidence.isNotNull(), F.least(confidence, F.lit(0.30)))).otherwise(confidence)


def claim_risk(claim: Column, counter: Column, unsupported: Column) -> Column:
    """0.35, more for a risky subject, for real counter-evidence and for missing support; 0.95 at most."""
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.least(F.lit(0.35) + add(has_any(claim, RISKY_SUBJECTS), 0.20) + add(counter, 0.10) + add(unsupported, 0.20), F.lit(0.95))


def quality(n_for: Column, n_against: Column, n_assumptions: Column, n_questions: Column) -> Column:
    """What of evidence, counter-evidence, assumptions and four questions a node has; null counts as none."""
    add = lambda n, least, w: F.when(F.coalesce(n, F.lit(0)) >= least, w).otherwise(0.0)
    return F.least(F.lit(0.35) + add(n_for, 1, 0.20) + add(n_against, 1, 0.15) + add(n_assumptions, 1, 0.10) + add(n_questions, 4, 0.10), F.lit(1.0))


def security(claim: Column) -> Column:
    """0 for a claim with a blocked substring, else 0.95."""
    return F.when(has_any(claim, BLOCKED), 0.0).otherwise(0.95)


def stop_before(timed_out: Column, depth: Column, exhausted: Column, max_depth: int) -> Column:
    """Why a node is not expanded, null if it is: time, depth, budget, in this order."""
    return first_rule([(timed_out, "timeout"), (depth >= max_depth, "max_depth"), (exhausted, "budget_exhausted")])


def stop_after(security_: Column, quality_: Column, novelty: Column, min_security: float = 0.80, min_quality: float = 0.60, min_novelty: float = 0.20) -> Column:
    """Why a scored node is not followed, null if it is."""
    return first_rule([(security_ < min_security, "low_security"), (quality_ < min_quality, "low_quality"), (novelty < min_novelty, "low_novelty")])


def failure_class(applied: Column, tested: Column, in_scope: Column, harmless: Column) -> Column:
    """The first step of a verification that failed; a step of which nothing is known passed."""
    no = lambda c: ~F.coalesce(c, F.lit(True))
    return first_rule([(no(applied), "patch_apply_failure"), (no(tested), "test_failure"), (no(in_scope), "patch_scope_failure"), (no(harmless), "sensitive_edit")], "no_failure_detected")


def error_class(name: Column, message: Column) -> Column:
    """The class of an error by its type's name, then its message."""
    return first_rule(
        [
            (name.isin("ValueError", "TypeError", "AssertionError", "KeyError"), "validation"),
            (name.isin("ConnectionError", "TimeoutError", "OSError"), "network"),
            (F.contains(F.lower(name), F.lit("patch")) | F.contains(message, F.lit(" Patch")), "patch"),
            (F.contains(F.lower(message), F.lit("timeout")), "timeout"),
        ],
        "unknown",
    )


def reflected_confidence(claim: Column, confidence: Column, n_evidence: Column) -> Column:
    """A confidence less what weak evidence, absolute words, three counter-examples and too few words cost; 0 at least."""
    c, n = F.coalesce(confidence, F.lit(0.0)), F.coalesce(n_evidence, F.lit(0))
    enough = (n >= 3) & (c >= 0.7)
    against = sum((has_any(claim, w).cast("int") for w in COUNTER), F.lit(0))
    text = F.trim(F.regexp_replace(F.coalesce(claim, F.lit("")), r"\s+", " "))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    cost = F.when(enough, 0.0).otherwise(0.3) + F.when(has_any(claim, ABSOLUTE), 0.2).otherwise(0.0) + F.when(against >= 3, 0.1).otherwise(0.0) + F.when(words < 5, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), c - cost)


def counterfactuals(claim: Column, most: int = 5) -> Column:
    """The questions that a claim's words raise, in the table's order, ``most`` at most; two general ones if there is none."""
    rules: list[Rule] = [(has_any(claim, words), q) for words, questions in WHAT_IFS for q in questions]
    return all_rules(rules, most, OTHERWISE)


def hypothesis(claim: Column, target: Column) -> Column:
    """What a claim lets one test about its target; null without a target or with fewer than four words."""
    text = F.trim(F.regexp_replace(claim, r"\s+", " "))
    said = last_rule([(has_any(claim, words), end) for words, end in HYPOTHESES], EXISTS)
    return F.when((target != "") & (F.size(F.split(text, " ")) >= 4), F.concat(target, said))


def correction(claim: Column, confidence: Column, n_for: Column, n_against: Column, budget: Column, min_confidence: float = 0.6, min_counter: int = 1) -> Column:
    """What is to be done about a claim: the first of its faults."""
    return first_rule(
        [
            (budget <= 0, "budget_halt"),
            (has_any(claim, META), "flag_meta"),
            ((n_against < min_counter) & (n_for > 0), "seek_counter_evidence"),
            (F.coalesce(confidence, F.lit(0.0)) < min_confidence, "expand_deeper"),
        ],
        "none",
    )


def target_score(path: Column, exists: Column, title: Column, sensitive: tuple[str, ...]) -> Column:
    """How good a file is as the target of an edit; null paths have no score."""
    low = F.lower(path)
    kind = F.when(low.endswith(".py"), 2.0).when(low.rlike(r"\.(md|txt|rst)$"), 0.5).otherwise(0.0)
    tests = F.when(F.contains(low, F.lit("test")), F.when(has_any(title, ("test", "coverage")), 1.5).otherwise(0.5)).otherwise(0.0)
    touched = F.lit(False)
    for p in sensitive:
        touched = touched | F.contains(path, F.lit(p))
    score = F.when(F.coalesce(exists, F.lit(False)), 1.0).otherwise(0.0) + kind + tests - F.when(touched, 3.0).otherwise(0.0)
    return F.when(path.isNotNull(), F.round(score, 2))


def _known(kind: Column) -> Column:
    table = F.create_map(*(x for k, v in CAUSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.try_element_at(table, kind)


def abduced(observations: DataFrame, group: str, kind: str, weight: str) -> DataFrame:
    """group, n, matched, confidence: how far known causes explain a group's observations.

    Weights count up to 3 each. One aggregate that combines before its shuffle; causes are looked up
    within the row.
    """
    found = _known(F.col(kind)).isNotNull()
    sums = observations.groupBy(group).agg(F.count("*").alias("n"), F.count_if(found).alias("matched"), F.sum(F.when(found, F.least(F.col(weight), F.lit(3.0))).otherwise(0.0)).alias("_w"))
    sure = F.least(F.lit(1.0), F.col("matched") / F.col("n") * 0.7 + F.least(F.col("_w") * 0.1, F.lit(0.3)))
    return sums.select(group, "n", "matched", F.round(sure + 1e-9, 2).alias("confidence"))


def causes(observations: DataFrame, group: str, kind: str) -> DataFrame:
    """group, cause, likely: the different causes of a group's observations; likely where one is the first of its kind."""
    each = observations.select(group, F.posexplode(_known(F.col(kind))).alias("_i", "cause"))
    return each.groupBy(group, "cause").agg(F.max(F.col("_i") == 0).alias("likely"))
