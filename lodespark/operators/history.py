"""History of changing attributes: versions with the runs from and until which they held.

States of an entity follow each other by an ordinal. Consecutive states are differenced by a
null-safe full outer join (ordinal n against n - 1), which classifies each as inserted, changed,
deleted or the same. The change events together, each closed by the next one (lead), are the
versions: an insertion or change opens one, a deletion closes the last. Updates (``versions``) say of
an entity only what is reported, so it is deleted after its last report, and the version before holds on;
full snapshots (``snapshot_versions``) also say what is gone, for good or until it comes again.

No window runs over a whole entity: an entity that holds a third of all rows is cut into blocks of
time; windows run within a block, and only one summary row for each block is looked at by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.text import norm, words_norm
from lodespark.joins import lookup
from lodespark.operators.snapshots import latest_loads
from lodespark.storage import stored

#: Seconds of time that one block of an entity's history covers.
BLOCK_SECONDS = 7 * 86_400


def run_order(runs: DataFrame) -> DataFrame:
    """run_id, run_ts: each run once, the earliest ts of repeated rows; a run without id or ts has no place."""
    return runs.where("run_id is not null and ts is not null").groupBy("run_id").agg(F.min("ts").alias("run_ts"))


def claim_states(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """claim_id, run_id, run_ts, status, confidence: what is known of a claim at each run, nulls as reported.

    Of several updates of one run the last received holds (the greatest update_id, status and
    confidence at the same moment); a history entry stands only where the claim has no update of its
    run. Statuses are in one spelling. Rows without claim_id, or of a run that ``runs`` lacks, have
    no place in the order and are left out.
    """
    own = updates.select(
        "claim_id", F.col("last_seen_run").alias("run_id"), F.lit(1).alias("rank"), "received_at", "update_id", words_norm("status").alias("status"), "confidence"
    )
    told = updates.select("claim_id", "received_at", "update_id", F.explode("history").alias("h")).select(
        "claim_id", F.col("h.run_id").alias("run_id"), F.lit(0).alias("rank"), "received_at", "update_id", words_norm("h.status_change").alias("status"), F.col("h.confidence").alias("confidence")
    )
    rows = own.unionByName(told).where("claim_id is not null and run_id is not null")
    best = rows.groupBy("claim_id", "run_id").agg(F.max(F.struct("rank", "received_at", "update_id", "status", "confidence")).alias("b"))
    held = best.select("claim_id", "run_id", F.col("b.status").alias("status"), F.col("b.confidence").alias("confidence"))
    return lookup(held, stored(run_order(runs), "run-order"), ["run_id"], "inner").select("claim_id", "run_id", "run_ts", "status", "confidence")


def _block(ts: Column) -> Column:
    return F.floor(ts.cast("timestamp").cast("long") / F.lit(BLOCK_SECONDS))


def numbered_and_filled(states: DataFrame, key: str, ts: str, tie: str, attributes: list[str]) -> DataFrame:
    """Adds ``ord`` (1, 2, ... by ts and tie) and carries the last known value of each attribute forward.

    Two levels: within (key, block), then over one summary a block. Values before an attribute is
    first known stay null.
    """
    rows = states.withColumn("block", _block(F.col(ts)))
    within = Window.partitionBy(key, "block").orderBy(ts, tie)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.row_number().over(within)).withColumns({a: F.last(a, ignorenulls=True).over(so_far) for a in attributes})
    last_of = {f"{a}_last": F.max_by(a, "n") for a in attributes}
    blocks = rows.groupBy(key, "block").agg(F.max("n").alias("rows"), *(c.alias(k) for k, c in last_of.items()))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        key,
        "block",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        *(F.last(f"{a}_last", ignorenulls=True).over(before).alias(f"{a}_before") for a in attributes),
    )
    out = rows.join(blocks, [key, "block"]).withColumn("ord", F.col("n") + F.col("rows_before"))
    out = out.withColumns({a: F.coalesce(a, f"{a}_before") for a in attributes})
    return out.drop("n", "rows_before", *(f"{a}_before" for a in attributes))


def difference(previous: DataFrame, current: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Null-safe full outer join of two snapshots: keys, change (inserted, changed, deleted, same), old and new row.

    A key may be null, and null is a value of an attribute. Each key occurs at most once a side. The
    rows of either side stand whole in the struct columns ``old`` and ``new``, so clashing names do
    no harm.
    """
    old = previous.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.struct(*previous.columns).alias("old"))
    new = current.select(*(F.col(k).alias(f"_n_{k}") for k in keys), F.struct(*current.columns).alias("new"))
    on = F.lit(True)
    for k in keys:
        on = on & old[f"_o_{k}"].eqNullSafe(new[f"_n_{k}"])
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(f"old.`{a}`").eqNullSafe(F.col(f"new.`{a}`"))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(same, "same").otherwise("changed")
    picked = [F.when(F.col("new").isNull(), F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")).alias(k) for k in keys]
    return old.join(new, on, "full_outer").select(*picked, change.alias("change"), "old", "new")


def close_by_lead(events: DataFrame, key: str, opens: list[str], closes: dict[str, str]) -> DataFrame:
    """Adds the columns of ``closes`` ({new name: column}): its value at the next event of the key, null at the last.

    ``opens`` orders the events, ``block`` holds each event's block.
    """
    within = Window.partitionBy(key, "block").orderBy(*opens)
    nxt = F.struct(*(F.col(c).alias(n) for n, c in closes.items()))
    rows = events.withColumn("_next", F.lead(nxt).over(within))
    blocks = events.groupBy(key, "block").agg(F.min_by(nxt, F.struct(*opens)).alias("_first"))
    blocks = blocks.select(key, "block", F.lead("_first").over(Window.partitionBy(key).orderBy("block")).alias("_later"))
    rows = rows.join(blocks, [key, "block"]).withColumn("_next", F.coalesce("_next", "_later"))
    return rows.select(*events.columns, *(F.col(f"_next.`{n}`").alias(n) for n in closes))


def versions(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """claim_id, version_from_ord, status, confidence, from_run, to_run, from_ts, to_ts; to_run '' and to_ts null while it holds.

    A version opens where status or confidence differs from the state before, null-safe; the first
    state of a claim always opens one. Empty tables give no rows.
    """
    facts = ["status", "confidence"]
    known = stored(claim_states(updates, runs), "reported")  # a few columns a claim and run; all that follows reads only this
    states = stored(numbered_and_filled(known, "claim_id", "run_ts", "run_id", facts), "states")
    earlier = states.select("claim_id", (F.col("ord") + 1).alias("ord"), "block", *facts)
    found = difference(earlier, states, ["claim_id", "ord"], facts).where("change != 'same'")
    # one row of the join is one event; an entity's end has no run and no time
    gone = F.col("change") == "deleted"
    events = found.select(
        "claim_id", "ord", "change", F.when(gone, F.col("old.block")).otherwise(F.col("new.block")).alias("block"), "new.status", "new.confidence",
        F.when(gone, F.lit("")).otherwise(F.col("new.run_id")).alias("from_run"), F.col("new.run_ts").alias("from_ts"),
    )
    closed = close_by_lead(stored(events, "events"), "claim_id", ["ord"], {"to_run": "from_run", "to_ts": "from_ts"})
    return closed.where("change != 'deleted'").select("claim_id", F.col("ord").alias("from_ord"), "change", "status", "confidence", "from_run", "to_run", "from_ts", "to_ts")


def snapshot_versions(rows: DataFrame, attributes: list[str], scope: str = "repo", snapshot: str = "snapshot_no", load: str = "load_no") -> DataFrame:
    """scope, claim_key, from_no, to_no and the attributes: the versions of each key over a scope's full snapshots.

    to_no is the snapshot that first shows another state, or in which the key is missing; null while the
    version holds. Only the highest load of a snapshot counts; rows without scope, snapshot or key are
    left out; of differing rows of one key the greatest stands. A key has at most one row a snapshot, so
    windows by key are as short as a scope has snapshots.
    """
    keyed = rows.select(scope, snapshot, load, *attributes, norm("claim").alias("claim_key"))
    best, deliveries = latest_loads(keyed, scope, snapshot, load)
    held = best.where("claim_key is not null and claim_key != ''").groupBy(scope, "claim_key", "ord", "ended").agg(F.max(F.struct(*attributes)).alias("v"))
    states = stored(held.select(scope, "claim_key", "ord", "ended", "v.*"), "snapshots")
    earlier = states.where("not ended").withColumn("ord", F.col("ord") + 1)  # after the last snapshot nothing is known to be gone
    events = difference(earlier, states, [scope, "claim_key", "ord"], attributes).where("change != 'same'").select(scope, "claim_key", "ord", "change", *(f"new.{a}" for a in attributes))
    events = lookup(events, deliveries, [scope, "ord"], "inner").withColumnRenamed(snapshot, "from_no")
    closed = events.withColumn("to_no", F.lead("from_no").over(Window.partitionBy(scope, "claim_key").orderBy("ord")))
    return closed.where("change != 'deleted'").select(scope, "claim_key", "from_no", "to_no", *attributes)
