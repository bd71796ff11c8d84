"""Keyword search with snippets, and cosine search over bags of words or dense vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.joins import lookup, spread
from lodespark.storage import stored

# Words that say nothing about a query's subject.
STOP = ("what", "which", "this", "that", "claim", "evidence", "against")
#: Query vectors that are sent to the executors at once.
QUERY_BLOCK = 50_000
#: Query texts that are sent at once, and the queries and texts that are scored as one matrix.
TEXT_BLOCK, MATRIX = 10_000, 1_000


# What parts the words of a query, and what does not count at a word's ends.
_EDGE = r"\s:?.,()\[\]{}\"'`\-_"
_WORD = re.compile(rf"[^{_EDGE}](?:[^\s:?]*[^{_EDGE}])?")
#: Letters that a keyword has at least, and how many keywords count.
SHORTEST, KEYWORDS = 4, 8


def keywords(query: str) -> list[str]:
    """The first eight different words of four or more letters, without stop words."""
    found: dict[str, None] = {}
    for m in _WORD.finditer(query.lower()):
        if len(m[0]) >= SHORTEST and m[0] not in STOP:
            found[m[0]] = None
        if len(found) == KEYWORDS:
            break
    return [*found]


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs in ``text`` without overlap; 0 for null."""
    without = F.replace(text, F.lit(word), F.lit(""))
    return F.coalesce(((F.length(text) - F.length(without)) / len(word)).cast("long"), F.lit(0).cast("long"))


def keyword_score(text: Column, path: Column, words: Sequence[str]) -> Column:
    """Occurrences of all words in the text, and two for each word in the path."""
    body, where = F.lower(text), F.lower(path)
    score = F.lit(0).cast("long")
    for w in words:
        score = score + occurrences(body, w) + F.when(F.instr(where, w) > 0, 2).otherwise(0).cast("long")
    return score


def snippet(text: Column, words: Sequence[str], window: int = 220, before: int = 80) -> Column:
    """The text around the first place of any word, line ends as blanks; its beginning if there is none."""
    places = [F.when(F.instr(F.lower(text), w) > 0, F.instr(F.lower(text), w) - 1) for w in words]
    first = F.least(*places, F.lit(None).cast("int")) if len(places) > 1 else places[0]
    start = F.greatest(F.lit(0), first - before)
    cut = F.when(first.isNull(), F.substring(text, 1, window)).otherwise(text.substr(start + 1, first + window - start))
    return F.trim(F.replace(cut, F.lit("\n"), F.lit(" ")))


def keyword_search(docs: DataFrame, query: str, top_k: int, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """The top_k rows by score above 0, ties by id: id, path, score, snippet. A query without keywords finds nothing.

    One scan; each task keeps its own best top_k.
    """
    words = keywords(query)
    if not words:
        return docs.select(id_col, path_col).withColumns({"score": F.lit(0).cast("long"), "snippet": F.lit("")}).limit(0)
    scored = docs.withColumn("score", keyword_score(F.col(text_col), F.coalesce(path_col, F.lit("")), words)).where("score > 0")
    best = scored.orderBy(F.desc("score"), id_col).limit(top_k)
    return best.select(id_col, path_col, "score", snippet(F.col(text_col), words).alias("snippet"))


def bag(text: Column) -> Column:
    """Words of a text for the bag: lower case, dots and round brackets as blanks."""
    return F.filter(F.split(F.translate(F.lower(text), "().", "   "), r"\s+"), lambda w: w != "")


def bow_cosine(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str, text_col: str) -> DataFrame:
    """qid, id, score (3 places): the top_k texts of each query by cosine of word counts; of equals the smaller id.

    Texts without a common word have score 0 and are listed where fewer than top_k others are: those of
    the smallest ids. Null texts are none. ``queries``: qid, query; few rows. The vocabulary is the corpus's, so a query's other words do not
    count in its norm. Texts are turned to counts once; only words of queries are joined.
    """
    asked = queries.select("qid", F.explode(bag(F.col("query"))).alias("word")).groupBy("qid", "word").agg(F.count("*").alias("m"))
    wanted = asked.select("word").distinct().withColumn("wanted", F.lit(True))
    words = spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)).select(id_col, F.explode(bag(F.col(text_col))).alias("word"))
    tf = lookup(words.groupBy(id_col, "word").agg(F.count("*").alias("n")), wanted, ["word"])
    hit = F.collect_list(F.when(F.col("wanted"), F.struct("word", "n")))  # no longer than the queries' words
    texts = tf.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), hit.alias("hits")).where(F.size("hits") > 0)
    texts = stored(texts, "bags").select(id_col, "norm", F.explode("hits").alias("h")).select(id_col, "norm", "h.*")
    asked = stored(asked.join(texts.select("word").distinct(), "word", "left_semi"), "asked")  # the vocabulary's words only
    qnorm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("qnorm"))
    dots = lookup(texts, asked, ["word"], "inner").groupBy("qid", id_col, "norm").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = lookup(dots, qnorm, ["qid"], "inner").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 3))
    # at most top_k hits of a query are among the top_k smallest ids, so these are enough to fill up with
    first = docs.where(F.col(text_col).isNotNull()).select(id_col).distinct().orderBy(id_col).limit(top_k)
    rest = queries.select("qid").distinct().join(F.broadcast(first)).select("qid", id_col, F.lit(0.0).alias("score"))
    every = scored.select("qid", id_col, "score").unionByName(rest).groupBy("qid", id_col).agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), id_col)
    return every.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k).select("qid", id_col, "score")


def best(score: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's top_k columns by whole-numbered score, the first columns of equals; NaN is no score.

    Score and column make one number that no two columns share, so a tie at the cut is no chance.
    """
    n = score.shape[1]
    k = min(top_k, n)
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key = np.where(np.isnan(score), np.iinfo(np.int64).max // 2, np.arange(n) - np.nan_to_num(score).astype(np.int64) * n)
    at = np.argpartition(key, k - 1, axis=1)[:, :k].ravel()
    row = np.repeat(np.arange(len(score)), k)
    value = score[row, at]
    ok = ~np.isnan(value)
    return row[ok], at[ok], value[ok]


class Asked:
    """Queries as postings: for each of ``words`` the queries that have it and how often."""

    def __init__(self, ids: Sequence[int], bags: Sequence[dict[str, int]]) -> None:
        self.ids = np.asarray(ids)
        self.norm = np.sqrt([float(sum(m * m for m in b.values())) for b in bags])
        place = {w: i for i, w in enumerate(dict.fromkeys(w for b in bags for w in b))}
        self.words = list(place)
        entries = np.asarray([(place[w], q, m) for q, b in enumerate(bags) for w, m in b.items()], np.int64).reshape(-1, 3)
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        self.begin = np.searchsorted(entries[:, 0], np.arange(len(place) + 1))
        self.query, self.times = entries[:, 1], entries[:, 2]

    def dots(self, doc: np.ndarray, word: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
        """A row for each query and a column for each of ``docs``: sums of products of counts over the words in both."""
        reach = self.begin[word + 1] - self.begin[word]
        of = np.repeat(np.arange(len(word)), reach)
        at = np.arange(len(of)) + np.repeat(self.begin[word] - (np.cumsum(reach) - reach), reach)
        sums = np.bincount(self.query[at] * docs + doc[of], n[of] * self.times[at], len(self.ids) * docs)
        return sums.reshape(len(self.ids), docs)

    def hits(self, score: np.ndarray, rows: np.ndarray, top_k: int, unit: float) -> pa.RecordBatch:
        """The best texts of each query but itself; ``rows`` ascend, ``score`` is in whole units."""
        score[self.ids[:, None] == rows[None, :]] = np.nan
        q, at, value = best(score, top_k)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(rows[at]), pa.array(value / unit)], names=["qid", "id", "score"])


def _in_order(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by its first column, in slices for one matrix."""
    b = b.take(pc.sort_indices(b.column(0)))
    for lo in range(0, b.num_rows, MATRIX):
        yield b.slice(lo, MATRIX)


def _each_block(docs: DataFrame, id_col: str, query: Column, bag_of: Callable, run: Callable, block: int, top_k: int) -> DataFrame:
    """qid, id, score: ``run`` over ``docs`` for blocks of queries, merged by query. The queries are the rows whose id is divisible by 100."""
    kind = docs.schema[id_col].dataType.simpleString()
    spark, parts, ids, bags = docs.sparkSession, [], [], []

    def ask() -> DataFrame:
        sent = spark.sparkContext.broadcast([Asked(ids[lo : lo + MATRIX], bags[lo : lo + MATRIX]) for lo in range(0, len(ids), MATRIX)])
        return run(sent, f"qid {kind}, id {kind}, score double")

    for row in docs.where(F.col(id_col) % 100 == 0).select(id_col, query.alias("query")).toLocalIterator():
        ids.append(row[0])
        bags.append(bag_of(row[1]))
        if len(ids) == block:
            parts.append(ask())
            ids, bags = [], []
    if ids or not parts:
        parts.append(ask())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k).select("qid", F.col("id").alias(id_col), "score")


def bow_cosine_all(docs: DataFrame, top_k: int, id_col: str, text_col: str, block: int = TEXT_BLOCK) -> DataFrame:
    """qid, id, score (3 places): for each text whose id is divisible by 100, its top_k others by cosine of word counts.

    Scores of zero count, so every query has top_k rows if there are as many other texts. Null texts are
    neither query nor result; a text without words has the score 0. Ids are unique.
    """
    docs = docs.where(F.col(text_col).isNotNull())

    def run(sent, schema: str) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = [pa.array(a.words, pa.string()) for a in sent.value]
            for b in batches:
                for part in _in_order(b):
                    rows, bags = np.asarray(part.column(0)), part.column(1)
                    coded = bags.flatten().dictionary_encode()
                    doc, width = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(bags))), max(1, len(coded.dictionary))
                    cell, n = np.unique(doc * width + np.asarray(coded.indices), return_counts=True)
                    doc, code = cell // width, cell % width
                    norm = np.sqrt(np.bincount(doc, n * n, len(rows)))
                    for a, words in zip(sent.value, sets, strict=True):
                        word = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, words), -1), np.int64)[code]
                        known = word >= 0
                        dot = a.dots(doc[known], word[known], n[known], len(rows))
                        size = norm[None, :] * a.norm[:, None]
                        yield a.hits(np.floor(dot / np.where(size == 0, 1, size) * 1e3 + 0.5), rows, top_k, 1e3)

        return spread(docs.select(id_col, text_col)).select(id_col, bag(F.col(text_col)).alias("bag")).mapInArrow(score, schema)

    return _each_block(docs, id_col, bag(F.col(text_col)), lambda b: dict(Counter(b)), run, block, top_k)


def keyword_search_all(docs: DataFrame, top_k: int, id_col: str, text_col: str, path_col: str, block: int = TEXT_BLOCK) -> DataFrame:
    """qid, id, path, score, snippet: ``keyword_search`` for the text of each row whose id is divisible by 100, over all other rows.

    A word has four letters or more, so a text is searched only for words that begin with four letters
    it has in a row. Ids are unique.
    """

    def run(sent, schema: str) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begins: list[dict[str, list[tuple[int, str]]]] = []
            for a in sent.value:
                begins.append({})
                for i, w in enumerate(a.words):
                    begins[-1].setdefault(w[:4], []).append((i, w))
            for b in batches:
                for part in _in_order(b):
                    rows, texts, paths = np.asarray(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()
                    fours = [{t[i : i + 4] for t in (text, path) for i in range(len(t) - 3)} for text, path in zip(texts, paths, strict=True)]
                    for a, begin in zip(sent.value, begins, strict=True):
                        found = [
                            (d, i, n)
                            for d, (text, path, four) in enumerate(zip(texts, paths, fours, strict=True))
                            for f in four & begin.keys()
                            for i, w in begin[f]
                            if (n := text.count(w) + 2 * (w in path))
                        ]
                        doc, word, n = np.asarray(found, np.int64).reshape(-1, 3).T
                        sums = a.dots(doc, word, n, len(rows))
                        yield a.hits(np.where(sums > 0, sums, np.nan), rows, top_k, 1)

        low = [F.coalesce(F.lower(c), F.lit("")).alias(f"low{i}") for i, c in enumerate((text_col, path_col))]
        return spread(docs.select(id_col, text_col, path_col)).select(id_col, *low).mapInArrow(score, schema)

    hits = _each_block(docs.where(F.col(text_col).isNotNull()), id_col, F.col(text_col), lambda t: dict.fromkeys(keywords(t), 1), run, block, top_k)
    hits = stored(hits.withColumn("score", F.col("score").cast("long")), "hits")
    texts = lookup(docs.select(id_col, path_col, text_col), hits, [id_col], "inner")
    queries = docs.where(F.col(id_col) % 100 == 0).select(F.col(id_col).alias("qid"), F.col(text_col).alias("_q"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, low, query in zip(*(b.column(i).to_pylist() for i in (4, 5, 6)), strict=True):
                first = min((p for p in map((low or "").find, keywords(query)) if p >= 0), default=None)
                start = max(0, (first or 0) - 80)
                out.append(None if text is None else (text[:220] if first is None else text[start : first + 220]).replace("\n", " ").strip(" "))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.string())], names=["qid", id_col, path_col, "score", "snippet"])

    shown = texts.join(queries, "qid").select("qid", id_col, path_col, "score", text_col, F.lower(text_col).alias("_low"), "_q")
    return shown.mapInArrow(cut, f"qid {kind}, {id_col} {kind}, {path_col} string, score long, snippet string")


def dense_cosine(vectors: DataFrame, top_k: int, id_col: str, vec_col: str, every: int = 100, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, score: for each vector whose id is divisible by ``every``, its top_k others by cosine over all rows.

    Queries go out in blocks of at most ``block``; every task keeps its own best top_k of a query, and
    these are merged by query, equal scores (4 places) by id in both. A null vector, or one of zeros, is neither query nor result.
    """
    asked = vectors.where((F.col(id_col) % every == 0) & F.col(vec_col).isNotNull()).select(id_col, vec_col)
    spark = vectors.sparkSession
    parts, ids, vecs = [], [], []

    def ask() -> DataFrame:
        q = np.asarray(vecs, np.float64)
        norm = np.linalg.norm(q, axis=1)
        unit, names = (q / np.where(norm == 0, 1, norm)[:, None])[norm > 0], np.asarray(ids)[norm > 0]
        sent = spark.sparkContext.broadcast((unit, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, names = sent.value
            for b in batches:
                x = np.stack([np.asarray(v, np.float64) for v in b.column(1).to_pylist()])
                n = np.linalg.norm(x, axis=1)
                rows = np.asarray(b.column(0))
                rows, x = rows[n > 0], (x / np.where(n == 0, 1, n)[:, None])[n > 0]
                order = np.argsort(rows, kind="stable")
                rows, x = rows[order], x[order]
                for lo in range(0, len(names), 1_000):
                    some = names[lo : lo + 1_000]
                    score = unit[lo : lo + 1_000] @ x.T
                    score[some[:, None] == rows[None, :]] = np.nan
                    q, at, value = best(np.where(np.isfinite(score), np.sign(score) * np.floor(np.abs(score) * 1e4 + 0.5), np.nan), top_k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[q]), pa.array(rows[at]), pa.array(value / 1e4)], names=["qid", "id", "score"])

        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, f"qid {kind}, id {kind}, score double")

    for row in asked.toLocalIterator():
        ids.append(row[0])
        vecs.append(row[1])
        if len(ids) == block:
            parts.append(ask())
            ids, vecs = [], []
    if ids or not parts:
        if not ids:
            return vectors.select(F.col(id_col).alias("qid"), F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
        parts.append(ask())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k).select("qid", "id", "score")


def contained(texts: DataFrame, text_col: str, terms: DataFrame, term_col: str, block: int = 50_000) -> DataFrame:
    """All columns of ``texts`` and ``term_col``: one row for each text and each different term that it contains.

    Terms go to the executors ``block`` at a time, however many there are; each block is one automaton
    that reads every text once, so the work grows with texts and hits, not with pairs. Null texts
    contain nothing; null and empty terms are none.
    """
    out = None
    names, kinds = texts.columns, texts.schema
    term_kind = terms.select(term_col).schema[0]
    for part in _blocks(terms.where(F.col(term_col).isNotNull() & (F.col(term_col) != "")).select(term_col).distinct().toLocalIterator(), block):
        found = texts.where(F.col(text_col).isNotNull()).mapInArrow(_automaton(part, text_col, names, term_col), T.StructType([*kinds, term_kind]))
        out = found if out is None else out.unionByName(found)
    return texts.withColumn(term_col, F.lit(None).cast("string")).limit(0) if out is None else out


def _blocks(rows: Iterator, size: int) -> Iterator[list[str]]:
    held: list[str] = []
    for r in rows:
        held.append(r[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _automaton(terms: list[str], text_col: str, names: list[str], term_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for t in terms:
            known.add_word(t, t)
        known.make_automaton()
        for b in batches:
            take, found = [], []
            for i, text in enumerate(b.column(names.index(text_col)).to_pylist()):
                hits = dict.fromkeys(t for _, t in known.iter(text))
                take += [i] * len(hits)
                found += hits
            kept = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], names=[*names, term_col])

    return run
