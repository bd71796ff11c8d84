"""Copies hidden by formatting: one record for each claim, with the number of its copies.

The canonical key of a text is what remains in lower case of its letters and digits. A text made of
named fields (JSON, or ``name: value`` parts divided by line ends, ``;``, ``|``, tabs or commas) has
its fields in the key by name, so order and notation do not matter; two texts whose fields hold each
other's values stay apart.

Hot keys are found exactly from partial counts. Their rows are salted and aggregated in two levels;
all other keys are grouped by one shuffle. At most ``1 / HOT_SHARE`` keys can be hot, which bounds
what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.joins import spread
from lodespark.storage import stored

#: A key is hot that holds at least this share of all rows, and at least HOT_ROWS of them.
HOT_SHARE, HOT_ROWS = 1 / 1000, 2_000

#: How a text of fields begins.
_FIRST = r"^[^\p{L}\p{N}]*[\p{L}_][\p{L}\p{N}_-]*[\"'`]?\s*[:=]"
_FIELD = r"(?s)^[^\p{L}\p{N}]*([\p{L}_][\p{L}\p{N}_-]*)[\"'`]?\s*[:=]+(.*)$"


def letters(c: Column) -> Column:
    """The letters and digits of a text in lower case, and nothing else."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{N}]+", "")


def _pairs(text: Column, divider: str) -> Column:
    """Sorted name-value pairs where every part of the text is a field and there are two or more; else null."""
    parts = F.filter(F.split(text, divider), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    fields = F.size(F.filter(parts, lambda p: p.rlike(_FIELD)))
    pairs = F.transform(parts, lambda p: F.concat(letters(F.regexp_extract(p, _FIELD, 1)), F.lit("\x1e"), letters(F.regexp_extract(p, _FIELD, 2))))
    return F.when((F.size(parts) >= 2) & (fields == F.size(parts)), F.array_sort(pairs))


def canonical_key(text: Column) -> Column:
    """16 bytes that texts of the same meaning share; null for null, blank and texts without letter or digit."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    alone = ~F.regexp_replace(text, r"(?s)\{.*\}", "").rlike(r"[\p{L}\p{N}]")
    obj = F.when(F.contains(text, F.lit("{")) & (body != "") & alone, F.from_json(body, "map<string,string>"))
    from_object = F.when(
        F.size(obj) > 0,
        F.array_sort(F.transform(F.map_entries(obj), lambda e: F.concat(letters(e["key"]), F.lit("\x1e"), F.coalesce(letters(e["value"]), F.lit(""))))),
    )
    # most prose has no two signs of a field, or does not begin like one: it is not cut into parts at all
    may = (F.length(text) - F.length(F.translate(text, ":=", "")) >= 2) & text.rlike(_FIRST)
    fields = F.coalesce(from_object, F.when(may, F.coalesce(_pairs(text, r"[\n\r;|]+"), _pairs(text, r"[\n\r;|,\t]+"))))
    plain = letters(text)
    key = F.when(fields.isNotNull(), F.concat(F.lit("f\x1f"), F.concat_ws("\x1f", fields))).otherwise(F.concat(F.lit("t\x1f"), plain))
    return F.when(plain != "", F.unhex(F.md5(key)))


def collapse(rows: DataFrame, id_col: str, text_col: str, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, keep_id, copies: each identified row with its claim's smallest id and the number of the claim's rows.

    Rows with a null id, and texts that are null, blank or without letter and digit, are left out.
    A row that is repeated with the same id counts once. An empty table gives no rows.
    """
    own = spread(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    said = own.where(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))  # a filter on the key would compute it twice
    keyed = said.select("id", canonical_key(F.col("text")).alias("key"))
    keyed = stored(keyed, "canonical")  # 24 bytes a row: texts are read and parsed once
    total = keyed.count()
    least = max(hot_rows, int(total * hot_share))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key", F.lit(True).alias("hot"))
    salts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = keyed.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(-1)).cast("int"))
    part = Window.partitionBy("key", "salt")
    once = salted.withColumn("before", F.lag("id").over(part.orderBy("id"))).where("before is null or before != id")
    cold = once.where("salt < 0").select("id", F.min("id").over(part).alias("keep_id"), F.count("*").over(part).alias("copies"))
    warm = once.where("salt >= 0").select("id", "key", "salt")
    level1 = warm.groupBy("key", "salt").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    level2 = level1.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return cold.unionByName(warm.join(F.broadcast(level2), "key").select("id", "keep_id", "copies"))


def pairs(members: DataFrame) -> DataFrame:
    """keep_id, copy_id for each row that is not its claim's representative."""
    return members.where("id != keep_id").select("keep_id", F.col("id").alias("copy_id"))


def representatives(members: DataFrame) -> DataFrame:
    """keep_id, copies: one row for each claim; the representative counts as a copy."""
    return members.where("id = keep_id").select("keep_id", "copies")
