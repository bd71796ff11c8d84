"""Queries on training text, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.joins import lookup
from lodespark.llm import canonical, encode, packing, percentiles, reading, secrets
from lodespark.llm.syntax import files
from lodespark.plans.catalog import Catalog
from lodespark.sources.tables import table

LLM = Catalog()
PS = [0.5, 0.9, 0.95, 0.99]


def _plain(x: str) -> str:
    return rf"regexp_replace(lower(upper({x})), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _fields(divider: str) -> str:
    """SQL of the sorted fields of a claim whose parts are all fields."""
    field = r"(?s)^[^\p{L}\p{N}]*([\p{L}_][\p{L}\p{N}_-]*)[\"''`]?\s*[:=]+(.*)$"
    parts = f"list_filter(regexp_split_to_array(claim, '{divider}'), lambda p: {_plain('p')} <> '')"
    name, value = (_plain(f"regexp_extract(p, '{field}', {i})") for i in (1, 2))
    return f"""case when len({parts}) >= 2 and len(list_filter({parts}, lambda p: regexp_matches(p, '{field}'))) = len({parts})
      then list_sort(list_transform({parts}, lambda p: {name} || chr(30) || {value})) end"""


_BODY = r"regexp_extract(claim, '(?s)\{.*\}')"
_OUTSIDE = _plain(r"regexp_replace(claim, '(?s)\{.*\}', '')")
_VALUE = _plain(f"json_extract_string({_BODY}, '$.\"' || k || '\"')")
_P2_SQL = f"""with k as (select report_id, {_plain('claim')} plain, coalesce(
    case when {_BODY} <> '' and json_valid({_BODY}) and {_OUTSIDE} = '' then list_sort(list_transform(json_keys({_BODY}::json), lambda k: {_plain('k')} || chr(30) || coalesce({_VALUE}, ''))) end,
    {_fields("[" + chr(92) + "n" + chr(92) + "r;|]+")}, {_fields("[" + chr(92) + "n" + chr(92) + "r;|," + chr(92) + "t]+")}) f from claim_reports where claim is not null and report_id is not null),
  r as (select report_id, case when f is not null then 'f' || chr(31) || array_to_string(f, chr(31)) else 't' || chr(31) || plain end g from k where plain <> ''),
  m as (select report_id, min(report_id) over (partition by g) keep_id, count(*) over (partition by g) copies from r) """


@LLM.query("p2_found", _P2_SQL + "select keep_id, report_id copy_id from m where keep_id <> report_id")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy of a claim with the claim's smallest report_id."""
    return canonical.pairs(canonical.collapse(table(spark, sf, "claim_reports", "report_id", "claim"), "report_id", "claim"))


@LLM.query("p2_claims", _P2_SQL + "select keep_id, copies from m where keep_id = report_id")
def p2_claims(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each claim with the number of its copies."""
    return canonical.representatives(canonical.collapse(table(spark, sf, "claim_reports", "report_id", "claim"), "report_id", "claim"))


_P6_SQL = """
with t as (select trace_id, min(phase) phase, min(function_name) function_name, max(duration_ms) v from traces
  where trace_id is not null and duration_ms is not null and not isnan(duration_ms) and duration_ms >= 0 and not isinf(duration_ms) group by 1),
g as (select 'phase' kind, phase "key", v from t where phase is not null union all select 'function_name', function_name, v from t where function_name is not null),
r as (select kind, "key", v, row_number() over (partition by kind, "key" order by v) rn, count(*) over (partition by kind, "key") n from g)
select kind, "key", n, p, v "value" from r, (select unnest([0.5::double, 0.9::double, 0.95::double, 0.99::double]) p) where rn = greatest(1, ceil(p * n))
"""


@LLM.query("p6_percentiles", _P6_SQL)
def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of duration_ms by phase and by function_name, from the runs of pieces, one a quarter; each trace_id in one piece only."""
    return percentiles.trace_percentiles(_traces(spark, sf), PS, piece=percentiles.quarter())


@LLM.query("p6_bounded")
def p6_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The same within one percent, from pieces whose size is bounded: one for each quarter, combined by union."""
    return percentiles.trace_percentiles(_traces(spark, sf), PS, error=0.01, piece=percentiles.quarter())


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "traces", "trace_id", "phase", "function_name", "duration_ms", "ts")


@LLM.query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_corpus(table(spark, sf, "documents", "doc_id", "text"))


@LLM.query("p9_packing")
def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.pack_documents(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "pack_specs"))


@LLM.query("p9_use")
def p9_use(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed = p9_packing(spark, sf)
    used = packed.groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return lookup(used, table(spark, sf, "pack_specs").distinct(), ["spec_id"], "inner").withColumn("full", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


@LLM.query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The band of each English prose document that is not graded."""
    graded = table(spark, sf, "reading_labels")
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "doc_kind", "n_chars")
    levels = reading.reading_levels(docs, graded).select("doc_id", "band").distinct()
    return levels.join(graded.select("doc_id").distinct(), "doc_id", "left_anti")


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patches", "patch_id", "file_path", "old_content", "new_content", "diff")


@LLM.query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on which a credential's value starts."""
    return secrets.found_lines(_patches(spark, sf))


@LLM.query("p7_redacted")
def p7_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The texts with only the credentials' values blanked."""
    return secrets.redacted(_patches(spark, sf)).distinct()


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return files.flags(table(spark, sf, "patches", "patch_id", "repo", "file_path", "new_content"), table(spark, sf, "file_languages"))


@LLM.query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Patches whose new content is not valid in the language of its path."""
    return _flags(spark, sf).where("invalid").select("patch_id").distinct()


@LLM.query("p4_rates")
def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How many files of each repo and language are not valid."""
    return files.rates(_flags(spark, sf))
