"""Search, classification and voting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import consensus, search
from lodespark.plans.catalog import CORE
from lodespark.sources.tables import table

QUERY = "What does the rollback journal record about the import layer?"
WORDS = search.keywords(QUERY)
_count = " + ".join(
    f"((length(t) - length(replace(t, '{w}', ''))) / {len(w)})::bigint + case when contains(p, '{w}') then 2 else 0 end" for w in WORDS
)
_SCORED = f"select doc_id, source, text, {_count} score from (select *, lower(text) t, lower(coalesce(source, '')) p from documents where text is not null)"
_first = "least(" + ", ".join(f"nullif(strpos(lower(text), '{w}'), 0)" for w in WORDS) + ") - 1"


@CORE.query(
    "keyword_search_topk",
    f"""select doc_id, source, score, trim(replace(case when f is null then substr(text, 1, 220) else substr(text, greatest(0, f - 80) + 1, f + 220 - greatest(0, f - 80)) end, chr(10), ' ')) snippet
    from (select *, {_first} f from ({_SCORED}) where score > 0 order by score desc, doc_id limit 10)""",
)
def keyword_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 documents by keyword score with snippets."""
    return search.keyword_search(table(spark, sf, "documents", "doc_id", "text", "source"), QUERY, 10, "doc_id", "text", "source")


@CORE.query("keyword_scores", f"select doc_id, score::bigint score from ({_SCORED}) where score > 0")
def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T1 without the cut: every document's score."""
    docs = table(spark, sf, "documents", "doc_id", "text", "source")
    return docs.withColumn("score", search.keyword_score(F.col("text"), F.coalesce("source", F.lit("")), WORDS)).where("score > 0").select("doc_id", "score")


ASKED = [(1, "the rollback journal replaced the older entries"), (2, "epistemological decomposition of the configuration"), (3, "run it first and ask the bot")]
_BAG = r"regexp_split_to_array(translate(lower({0}), '().', '   '), '\s+')"
_asked = ", ".join(f"({i}, '{q}')" for i, q in ASKED)


@CORE.query(
    "bow_cosine_topk",
    f"""with w as (select doc_id, unnest({_BAG.format("text")}) word from documents where text is not null),
    tf as (select doc_id, word, count(*) n from w where word <> '' group by all), norms as (select doc_id, sqrt(sum(n * n)) norm from tf group by 1),
    qw as (select qid, unnest({_BAG.format("query")}) word from (values {_asked}) v(qid, query)), q as (select qid, word, count(*) m from qw where word <> '' and word in (select word from tf) group by all),
    qn as (select qid, sqrt(sum(m * m)) qnorm from q group by 1), d as (select qid, doc_id, sum(n * m) dot from tf join q using (word) group by all),
    h as (select qid, doc_id, round(dot / (norm * qnorm), 3) score from d join norms using (doc_id) join qn using (qid)),
    s as (select v.qid, doc_id, coalesce(score, 0) score from (select distinct qid from (values {_asked}) v(qid, query)) v cross join (select distinct doc_id from documents where text is not null) left join h using (qid, doc_id))
    select qid, doc_id, score from (select *, row_number() over (partition by qid order by score desc, doc_id) k from s) where k <= 5""",
)
def bow_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 documents of each question by cosine of word counts."""
    asked = spark.createDataFrame(ASKED, "qid int, query string")
    return search.bow_cosine(table(spark, sf, "documents", "doc_id", "text"), asked, 5, "doc_id", "text")


_STRIP = ".,()[]{}\"''`-_"
_stop = ", ".join(f"'{w}'" for w in search.STOP)


@CORE.query(
    "keyword_search_documents",
    rf"""with l as (select doc_id qid, list_filter(list_transform(regexp_split_to_array(translate(lower(text), ':?', '  '), '\s+'), lambda w: trim(w, '{_STRIP}')), lambda w: length(w) >= 4 and w not in ({_stop})) l
      from documents where doc_id % 100 = 0 and text is not null),
    w as (select distinct qid, unnest(list_filter(l, lambda w, i: list_position(l, w) = i)[:8]) w from l),
    s as (select qid, doc_id, any_value(source) source, any_value(text) text, min(nullif(strpos(lower(text), w), 0)) - 1 f,
      sum(coalesce((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w), 0) + case when contains(lower(coalesce(source, '')), w) then 2 else 0 end)::bigint score
      from w join documents on doc_id <> qid group by qid, doc_id),
    b as (select *, row_number() over (partition by qid order by score desc, doc_id) k from s where score > 0)
    select qid, doc_id, source, score, trim(replace(case when f is null then substr(text, 1, 220) else substr(text, greatest(0, f - 80) + 1, f + 220 - greatest(0, f - 80)) end, chr(10), ' ')) snippet from b where k <= 10""",
)
def keyword_search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """T1, T2 asked with every document whose doc_id is divisible by 100: its top 10 others with snippets."""
    return search.keyword_search_all(table(spark, sf, "documents", "doc_id", "text", "source"), 10, "doc_id", "text", "source")


@CORE.query(
    "bow_cosine_documents",
    f"""with w as (select doc_id, unnest({_BAG.format("text")}) word from documents where text is not null), tf as (select doc_id, word, count(*) n from w where word <> '' group by all),
    norms as (select doc_id, sqrt(sum(n * n)) norm from tf group by 1), d as (select a.doc_id qid, b.doc_id, sum(a.n * b.n) dot from tf a join tf b using (word) where a.doc_id % 100 = 0 group by all),
    s as (select q.doc_id qid, t.doc_id, coalesce(round(dot / (nt.norm * nq.norm), 3), 0) score from documents q join documents t on q.doc_id <> t.doc_id and q.doc_id % 100 = 0 and q.text is not null and t.text is not null
      left join d on d.qid = q.doc_id and d.doc_id = t.doc_id left join norms nq on nq.doc_id = q.doc_id left join norms nt on nt.doc_id = t.doc_id)
    select qid, doc_id, score from (select *, row_number() over (partition by qid order by score desc, doc_id) k from s) where k <= 5""",
)
def bow_cosine_documents(spark: SparkSession, sf: str) -> DataFrame:
    """T3, X6 asked with every document whose doc_id is divisible by 100: its top 5 others; scores of zero are kept."""
    return search.bow_cosine_all(table(spark, sf, "documents", "doc_id", "text"), 5, "doc_id", "text")


@CORE.query(
    "embedding_cosine_topk",
    """with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
    s as (select a.vec_id qid, b.vec_id id, round(list_cosine_similarity(a.e, b.e), 4) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
    select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) k from s) where k <= 5""",
)
def embedding_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """T3 over dense vectors: the five nearest of every vector whose id is divisible by 100."""
    return search.dense_cosine(table(spark, sf, "embeddings", "vec_id", "embedding"), 5, "vec_id", "embedding")


def _contains(col: str, words: tuple) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


_hits = ", ".join("(" + " + ".join(f"contains(t, '{w}')::int" for w in words) + f") h_{name}" for name, words in consensus.CLAIM_TYPES)
_most = "greatest(" + ", ".join(f"h_{name}" for name, _ in consensus.CLAIM_TYPES) + ")"
_pick = "case when coalesce(m, 0) = 0 then 'general' " + " ".join(f"when h_{name} = m then '{name}'" for name, _ in consensus.CLAIM_TYPES) + " end"


@CORE.query("claim_classify", f"select report_id, {_pick} claim_type from (select *, {_most} m from (select report_id, {_hits} from (select report_id, lower(claim) t from claim_reports)))")
def claim_classify(spark: SparkSession, sf: str) -> DataFrame:
    """P10: each claim's type by most words, first of equals."""
    return table(spark, sf, "claim_reports", "report_id", "claim").select("report_id", consensus.best_label(F.col("claim")).alias("claim_type"))


_VOTES = "select l_orderkey claim, case l_returnflag when 'A' then 'APPROVE' when 'R' then 'REJECT' else 'ABSTAIN' end verdict, l_discount * 10 confidence, l_quantity weight from lineitem"
_TALLY = f"""select claim, count(*) n_votes, count(*) filter (verdict = 'APPROVE') a_n, count(*) filter (verdict = 'REJECT') r_n,
 coalesce(sum(weight) filter (verdict = 'APPROVE'), 0) a_w, coalesce(sum(weight) filter (verdict = 'REJECT'), 0) r_w,
 coalesce(sum(confidence * weight) filter (verdict = 'APPROVE'), 0) a_cw, coalesce(sum(confidence * weight) filter (verdict = 'REJECT'), 0) r_cw,
 min(confidence) filter (verdict = 'APPROVE') a_min, max(confidence) filter (verdict = 'REJECT') r_max,
 max(confidence) filter (verdict = 'APPROVE' and confidence >= 0.5) a_over, max(confidence) filter (verdict = 'REJECT' and confidence >= 0.5) r_over from ({_VOTES}) group by claim"""
_RULES = {
    "unanimous": ("case when a_n + r_n = 0 then 'ABSTAIN' when r_n = 0 then 'APPROVE' else 'REJECT' end", "case when a_n + r_n = 0 then 0 when r_n = 0 then a_min else 1 - r_max end", "a_n + r_n > 0"),
    "majority": (
        "case when a_w + r_w = 0 then 'ABSTAIN' when a_w / (a_w + r_w) > 0.5 then 'APPROVE' else 'REJECT' end",
        "case when a_w + r_w = 0 then 0 when a_w / (a_w + r_w) > 0.5 then a_cw / a_w else r_cw / r_w end",
        "a_w + r_w <> 0",
    ),
    "supermajority": (
        "case when a_w + r_w = 0 then 'ABSTAIN' when a_w / (a_w + r_w) >= 2/3 then 'APPROVE' when r_w / (a_w + r_w) >= 2/3 then 'REJECT' else 'ABSTAIN' end",
        "case when a_w + r_w = 0 then 0 when a_w / (a_w + r_w) >= 2/3 then a_cw / a_w when r_w / (a_w + r_w) >= 2/3 then r_cw / r_w else 0 end",
        "a_w + r_w <> 0",
    ),
    "weighted": ("case when round(a_cw - r_cw, 9) > 0 then 'APPROVE' when round(a_cw - r_cw, 9) < 0 then 'REJECT' else 'ABSTAIN' end", "case when a_w + r_w = 0 then 0 else abs(round(a_cw - r_cw, 9) / (a_w + r_w)) end", "a_w + r_w <> 0"),
    "threshold": ("case when a_over is not null then 'APPROVE' when r_over is not null then 'REJECT' else 'ABSTAIN' end", "coalesce(a_over, r_over, 0)", "true"),
}


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "APPROVE").when(F.col("l_returnflag") == "R", "REJECT").otherwise("ABSTAIN")
    return table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_discount", "l_quantity").select(
        F.col("l_orderkey").alias("claim"), verdict.alias("verdict"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_quantity").alias("weight")
    )


def _add(strategy: str) -> None:
    v, c, q = _RULES[strategy]
    sql = f"""select claim, n_votes, verdict, round(confidence + 1e-9, 6)::double confidence, quorum_reached,
      (case when n_votes < 2 then 0 when verdict = 'APPROVE' then r_n when verdict = 'REJECT' then a_n else a_n + r_n end)::bigint n_dissent
      from (select *, case when n_votes < 2 then 'ABSTAIN' else {v} end verdict, case when n_votes < 2 then 0 else {c} end confidence, n_votes >= 2 and ({q}) quorum_reached from ({_TALLY}))"""

    @CORE.query(f"consensus_{strategy}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Verdict of each order's lines as votes."""
        return consensus.decide(_votes(spark, sf), strategy).withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


for _s in _RULES:
    _add(_s)

_roles = " union all ".join(
    f"select report_id, {weight} weight, case when {_contains('t', words)} then '{hit[0]}' else '{miss[0]}' end verdict, case when {_contains('t', words)} then {hit[1]} else {miss[1]} end confidence from c"
    for _, weight, words, hit, miss in consensus.PANEL
)


@CORE.query(
    "panel_vote",
    f"""with c as (select report_id, lower(claim) t from claim_reports where claim is not null), v as ({_roles}),
    s as (select report_id, sum(weight) filter (verdict = 'APPROVE') a, coalesce(sum(weight) filter (verdict = 'REJECT'), 0) r,
      sum(weight * confidence) filter (verdict = 'APPROVE') ac, sum(weight * confidence) filter (verdict = 'REJECT') rc from v group by 1)
    select report_id, case when coalesce(a, 0) / (coalesce(a, 0) + r) > 0.5 then 'APPROVE' else 'REJECT' end verdict,
      round((case when coalesce(a, 0) / (coalesce(a, 0) + r) > 0.5 then ac / a else rc / r end)::double, 6) confidence from s""",
)
def panel_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The panel of four roles on every reported claim, by majority of weight."""
    claims = table(spark, sf, "claim_reports", "report_id", "claim").where("claim is not null")
    ruled = consensus.decide(consensus.panel_votes(claims), "majority", claim="report_id")
    return ruled.select("report_id", "verdict", F.round("confidence", 6).alias("confidence"))
