"""Feedback over time: decayed means, moving averages as folds, and who repeats what when."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.storage import stored

#: Steps of one key that a single fold may hold; longer histories are folded block by block.
FOLD_ROWS = 100_000


def decayed_mean(value: Column, days_old: Column, half_life: float = 30.0) -> Column:
    """Aggregate: mean with weight halved each ``half_life`` days; null age counts in full, no rows give 0."""
    weight = F.when(days_old.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), days_old / half_life))
    weight = F.when(value.isNotNull(), weight)
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, start: float = 0.5, block: int = FOLD_ROWS) -> DataFrame:
    """key, n, ema: the exponential moving average over all of a key's values in order.

    The average is a weighted sum, alpha * (1 - alpha) ** (n - i) * x_i and (1 - alpha) ** n * start, so
    it is a plain aggregate once each row knows how many follow it. Rows are numbered from the end in
    two levels (blocks of the order's first column, then their counts), so no window spans a hot key's
    whole history. Null values are skipped; a key with none is left out.
    """
    held = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    first = F.col(order[0])
    kind = rows.schema[order[0]].dataType.typeName()
    place = F.floor(first.cast("timestamp").cast("long") / 86_400) if kind.startswith("timestamp") else F.floor(first / block)
    held = held.withColumn("_b", place)
    inner = Window.partitionBy(key, "_b").orderBy(*[F.desc(c) for c in order])
    held = held.withColumn("_after", F.row_number().over(inner) - 1)
    counts = held.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_b", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    steps = held.join(counts, [key, "_b"]).withColumn("_w", F.pow(F.lit(1 - alpha), (F.col("_after") + F.col("_later")).cast("double")))
    out = steps.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double") * F.col("_w")).alias("_s"))
    return out.select(key, "n", (F.lit(alpha) * F.col("_s") + F.lit(start) * F.pow(F.lit(1 - alpha), F.col("n").cast("double"))).alias("ema"))


def updated_confidence(old: Column, score: Column, alpha: float = 0.3) -> Column:
    """One step of feedback on a confidence, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), old * (1 - alpha) + score * alpha))


def within_seconds(rows: DataFrame, keys: list[str], ts: str, tie: str, seconds: int = 300) -> DataFrame:
    """Rows that follow no kept equal row (same keys) within ``seconds``; a row that is dropped does not make later ones drop.

    Null keys are equal to each other; rows without time are all kept. Which rows are kept follows from
    one to the next only within a burst: after a pause longer than ``seconds`` the next row is kept
    whatever came before. So bursts are told apart in blocks of a day, and each burst is read in order as
    a stream: no key's rows are held together, and a key's bursts spread over tasks.
    """
    micros = seconds * 1_000_000
    timed = rows.where(F.col(ts).isNotNull()).withColumn("_at", _micros(F.col(ts))).withColumn("_b", F.floor(F.col("_at") / 86_400_000_000))
    w = Window.partitionBy(*keys, "_b").orderBy("_at", tie)
    ends = timed.groupBy(*keys, "_b").agg(F.max("_at").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b"))).select(*(F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_b").alias("_kb"), "_before")
    same = F.col("_b") == F.col("_kb")
    for n, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}"))
    joined = timed.join(before, same).drop("_kb", *(f"_k{n}" for n in range(len(keys))))
    starts = (F.col("_at") - F.coalesce(F.lag("_at").over(w), "_before") > micros) | F.coalesce(F.lag("_at").over(w), "_before").isNull()
    marked = joined.withColumn("_first", starts)
    # the burst a row belongs to: its last start in the block, or the last one of the blocks before
    own = F.last(F.when(F.col("_first"), F.col("_at")), ignorenulls=True).over(w)
    placed = stored(marked.withColumn("_own", own), "bursts")
    last = placed.groupBy(*keys, "_b").agg(F.max("_own").alias("_o"))
    carried = last.withColumn("_carry", F.last("_o", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.select(*(F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_b").alias("_kb"), "_carry")
    bursts = placed.join(carried, same).withColumn("_burst", F.coalesce("_own", "_carry"))
    names = [c for c in rows.columns]
    group = F.xxhash64(*(x for k in keys for x in (F.col(f"`{k}`"), F.col(f"`{k}`").isNull())), F.col("_burst"))
    ordered = bursts.withColumn("_g", group).repartition(*(F.col(f"`{k}`") for k in keys), "_burst").sortWithinPartitions(*(F.col(f"`{k}`") for k in keys), "_burst", "_at", tie)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, until = None, 0
        for b in batches:
            g, at = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            chosen = []
            for i, (x, t) in enumerate(zip(g, at, strict=True)):
                if x != group_of or t > until:
                    group_of, until = x, t + micros
                    chosen.append(i)
            yield b.take(pa.array(chosen, pa.int64())).select(names)

    kept = ordered.select(*(f"`{c}`" for c in names), "_g", "_at").mapInArrow(keep, rows.schema)
    return kept.unionByName(rows.where(F.col(ts).isNull()))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as one aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key by ``order``; ranks are cut within tasks before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def reflection(rows: DataFrame, key: str, score: str, ts: str, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rates over all feedback, and the ``worst`` keys by mean score of which those below 0 remain."""
    s = F.col(score)
    total = rows.agg(
        F.count("*").alias("total"),
        F.round(F.count_if(s > 0) / F.count("*"), 6).alias("success_rate"),
        F.round(F.count_if(s < 0) / F.count("*"), 6).alias("false_positive_rate"),
        F.countDistinct(F.to_date(ts)).alias("days"),
    )
    means = rows.groupBy(key).agg(F.avg(s).alias("_m"), F.count("*").alias("occurrences"))
    low = means.orderBy("_m", key).limit(worst).where("_m < 0").select(key, F.round("_m", 2).alias("average_feedback"), "occurrences")
    return total, low


def learned(rows: DataFrame, node_key: str, score: str, least: int = 3) -> DataFrame:
    """issue_type, n, action: what the feedback on each type (the key up to its first colon) teaches."""
    t = rows.withColumn("issue_type", F.substring_index(node_key, ":", 1)).groupBy("issue_type").agg(F.count("*").alias("n"), F.avg(score).alias("_m"))
    action = F.when(F.col("_m") > 0.4, "boost").when(F.col("_m") < -0.4, "skip").otherwise("keep")
    return t.where(F.col("n") >= least).select("issue_type", "n", action.alias("action"))
