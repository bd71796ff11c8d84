"""What changed between consecutive full snapshots, by a bucketed index of keys and hashes.

The index of the last snapshot holds, for each scope and key, a hash of the row's attributes: some
tens of bytes a row whatever the rows' width. It is stored in buckets by scope and key. New rows are
hashed and stored in the same buckets, so they probe the index bucket by bucket and the index never
moves; old and new values are fetched only for keys whose hashes differ. Then the new index takes the
old one's place.

``SnapshotIndex`` does this delivery by delivery and can be taken up again by another session;
``changes`` drives it over a table that holds many deliveries of many scopes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodespark.functions.text import norm
from lodespark.joins import lookup
from lodespark.storage import children, drop_path, new_path, open_bucketed, stored, write_bucketed

#: Generations of the index that are written and probed in one job.
TOGETHER = 16


def row_hash(attributes: list[str]) -> Column:
    """64 bits over the attributes; null differs from every value and from an empty text.

    Only hashes of one key's consecutive rows are compared, so a change is missed once in 2 ** 64 changes.
    """
    return F.xxhash64(*(x for a in attributes for x in (F.col(a), F.col(a).isNull())))


def hash_index(rows: DataFrame, scope: str, key: str, attributes: list[str], ended: str = "ended") -> DataFrame:
    """scope, key, h, ended: one entry for each key; of differing rows of one key the greatest hash, so the result has no order in it."""
    return rows.groupBy(scope, key).agg(F.max(row_hash(attributes)).alias("h"), F.max(ended).alias("ended"))


def probe(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """on, change_kind for each key that the two indexes hold differently. Two tables in the same buckets by ``on`` are joined where they lie."""
    was, now = old.select(*on, F.col("h").alias("h_old")), new.select(*on, F.col("h").alias("h_new"))
    kind = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") != F.col("h_new"), "changed")
    return was.join(now, on, "full_outer").select(*on, kind.alias("change_kind")).where("change_kind is not null")


class SnapshotIndex:
    """A stored index that takes one full snapshot after another.

    ``path`` is a folder all executors share. Each generation is a table in buckets by scope and key;
    ``advance`` writes the next generation, stores what changed, and only then drops the generation
    before. Which generation holds is read from the folder, so a session that starts anew goes on
    where the last one ended, and an ``advance`` that was lost half-way can be repeated. Rows without
    scope or key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, scope: str, key: str, attributes: list[str], buckets: int | None = None) -> None:
        self.spark, self.path, self.on, self.attributes = spark, path, [scope, key], attributes
        held = [m for n in children(spark, path) if (m := re.fullmatch(r"index-(\d+)-in-(\d+)", n))]
        done = {n for n in children(spark, path) if n.startswith("changes-")}
        # a generation counts once what it changed is stored too; the first changes nothing
        whole = sorted((int(m[1]), int(m[2])) for m in held if m[1] == "1" or f"changes-{m[1]}" in done)
        self.generation, self.buckets = whole[-1] if whole else (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _at(self, generation: int) -> str:
        return f"{self.path}/index-{generation}-in-{self.buckets}"

    def current(self, schema: StructType | None = None) -> DataFrame | None:
        """The index of the last snapshot: scope, key, h, ended; None before the first. ``schema`` is needed only where it may be empty."""
        if not self.generation:
            return None
        at = self._at(self.generation)
        return open_bucketed(self.spark, at, schema or self.spark.read.parquet(at).schema, self.on, self.buckets)

    def advance(self, snapshot: DataFrame, ended: str | None = None) -> DataFrame | None:
        """Scope, key, change_kind against the last snapshot, stored; None for the first.

        One shuffle, of the new keys and hashes. A scope that ``snapshot`` lacks has lost all its keys,
        unless the column ``ended`` was true for it: then no further delivery of it is awaited.
        """
        keyed = snapshot.where(" and ".join(f"`{k}` is not null" for k in self.on)).withColumn("ended", F.col(ended) if ended else F.lit(False))
        fresh = hash_index(keyed, *self.on, self.attributes)
        old = self.current(fresh.schema)
        new = write_bucketed(fresh, self._at(self.generation + 1), self.on, self.buckets)
        self.generation += 1
        if old is None:
            return None
        out = f"{self.path}/changes-{self.generation}"
        changed = probe(old.where("not ended"), new, self.on)
        changed.write.mode("overwrite").parquet(out)
        drop_path(self.spark, self._at(self.generation - 1))
        return self.spark.read.schema(changed.schema).parquet(out)


def latest_loads(rows: DataFrame, scope: str, snapshot: str, load: str) -> tuple[DataFrame, DataFrame]:
    """The rows of each snapshot's highest load with ``ord``, which counts a scope's delivered snapshots from 1, and ``ended`` at its last; and the deliveries: scope, snapshot, ord."""
    known = rows.where(F.col(scope).isNotNull() & F.col(snapshot).isNotNull())
    w = Window.partitionBy(scope).orderBy(snapshot)
    numbers = {"ord": F.row_number().over(w), "ended": F.lead(snapshot).over(w).isNull()}
    deliveries = stored(known.groupBy(scope, snapshot).agg(F.max(load).alias("_load")).withColumns(numbers), "deliveries")
    return lookup(known, deliveries, [scope, snapshot], "inner").where(F.col(load).eqNullSafe(F.col("_load"))).drop("_load", load), deliveries.select(scope, snapshot, "ord")


def changes(rows: DataFrame, attributes: list[str], scope: str = "repo", snapshot: str = "snapshot_no", load: str = "load_no", key: Column | None = None) -> DataFrame:
    """scope, snapshot, claim_key, change_kind, old, new: each key added, removed or changed against the snapshot delivered before.

    The n-th deliveries of all scopes make the index's generation n, which probes generation n - 1 where
    it lies. Generations are written ``TOGETHER`` at a time to one table in buckets; each row is shuffled
    once, as key and hash, combined before. ``old`` and ``new`` are the attributes of a changed key,
    fetched for those keys only; they are null for a key added or removed. Only a scope's highest load
    of a snapshot counts. Rows whose scope, snapshot or key is null, or whose key is blank, have no
    identity and are left out; null is a value of an attribute; a scope's first snapshot gives no rows.
    Repeated rows count once; of differing rows of one key that with the greatest hash stands.
    """
    spark = rows.sparkSession
    keyed = rows.select(scope, snapshot, load, *attributes, (norm("claim") if key is None else key).alias("claim_key"))
    best, deliveries = latest_loads(keyed, scope, snapshot, load)  # a load of blank keys only is a delivery too
    path, on, buckets = new_path(spark, "deliveries"), [scope, "claim_key"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    best.where("claim_key is not null and claim_key != ''").write.partitionBy("ord").parquet(path)
    held = spark.read.schema(best.schema).parquet(path)
    rounds = deliveries.agg(F.max("ord")).collect()[0][0] or 0
    old, found = None, []
    for lo in range(1, rounds + 1, TOGETHER):
        own = range(lo, min(lo + TOGETHER, rounds + 1))
        made = [hash_index(held.where(F.col("ord") == n), *on, attributes).withColumn("ord", F.lit(n)) for n in own]
        table = write_bucketed(_united(made), new_path(spark, "snapshot-index"), on, buckets, order="ord")
        for n in own:
            new = table.where(F.col("ord") == n)
            if old is not None:
                found.append(probe(old.where("not ended"), new, on).withColumn("ord", F.lit(n)))
            old = new
    events = stored(_united(found), "events") if found else held.select(*on, F.lit("").alias("change_kind"), "ord").limit(0)
    values = with_values(events.where("change_kind = 'changed'"), held, attributes, scope)
    none = F.lit(None).cast(values.schema["old"].dataType)
    rest = events.where("change_kind != 'changed'").withColumns({"old": none, "new": none})
    return lookup(rest.unionByName(values), deliveries, [scope, "ord"], "inner").select(scope, snapshot, "claim_key", "change_kind", "old", "new")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_values(changed: DataFrame, held: DataFrame, attributes: list[str], scope: str = "repo") -> DataFrame:
    """Adds structs ``old`` and ``new`` of the attributes to changed keys (scope, ord, claim_key); only their rows of ``held`` are kept.

    Few changed keys are sent to the rows' scans; many are joined by shuffle.
    """
    on = [scope, "ord", "claim_key"]
    asked = stored(changed, "changed")
    v = F.struct(*attributes)
    both = asked.select(*on, F.lit("new").alias("side")).unionByName(asked.select(scope, (F.col("ord") - 1).alias("ord"), "claim_key", F.lit("old").alias("side")))
    got = lookup(held.select(*on, v.alias("v"), row_hash(attributes).alias("h")), both, on, "inner")
    at = got.groupBy(scope, "claim_key", F.when(F.col("side") == "old", F.col("ord") + 1).otherwise(F.col("ord")).alias("ord"))
    pair = at.agg(*(F.max_by("v", F.when(F.col("side") == s, F.col("h"))).alias(s) for s in ("old", "new")))
    return asked.join(pair, on, "inner")
