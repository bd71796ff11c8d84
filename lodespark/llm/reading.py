"""Reading level by a familiar-word formula.

Words are familiar that occur in a share of the corpus's documents; the list is derived from document
frequencies over all English prose, and as it holds no word of a smaller share, it has at most (mean
number of distinct words in a document) / FAMILIAR entries. A document's score joins its share of
unfamiliar words and its mean sentence length; the weights of the two and the scores where bands meet
are fitted on graded documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.joins import lookup, spread
from lodespark.storage import stored

#: Share of the documents in which a familiar word occurs.
FAMILIAR = 0.12
#: The most gradings that the fit looks at (those of the smallest hash of their document and grader).
GRADINGS = 20_000
#: Share of a band's gradings at either end that may be slips and don't move a cut.
SLIPS = 0.05
#: Bands from the least to the most demanding.
BANDS = ("basic", "intermediate", "advanced")

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_NO_PROSE = re.compile(r"#|==|[-=*_|:+ \t]+$|(?:[^|]*\|){2}")
_ITEM = re.compile(r"(?:[-*•+>]|\d+[.)])\s+")
_END = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"`[^`\n]*`")


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence, lower case, without headings, tables, fenced and inline code; a list item ends where the next begins."""
    parts: list[str] = []

    def finished() -> Iterator[list[str]]:
        for s in _END.split(" ".join(parts)):
            if words := _WORD.findall(_CODE.sub(" ", s.lower())):
                yield words
        parts.clear()

    for line in _FENCE.sub("\n", text).split("\n"):
        line = line.strip()
        if not line or _NO_PROSE.match(line):
            yield from finished()
            continue
        if m := _ITEM.match(line):
            yield from finished()
            line = line[m.end() :]
        parts.append(line)
    yield from finished()


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scored: Column | None = None) -> DataFrame:
    """id, n_sentences, n_words, words (map of word to count), scored (true if not given): one row for each row of ``docs``, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, maps = [], []
                for t in part.column(1):
                    count: Counter = Counter()
                    k = 0
                    for words in sentences(t.as_py() or ""):
                        k += 1
                        count.update(words)
                    n.append(k)
                    maps.append(list(count.items()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([sum(c for _, c in m) for m in maps], pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.int64())), part.column(2)],
                    names=["id", "n_sentences", "n_words", "words", "scored"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = F.coalesce(F.lit(True) if scored is None else scored, F.lit(False)).alias("scored")
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), asked)).mapInArrow(run, f"id {kind}, n_sentences long, n_words long, words map<string,bigint>, scored boolean")


def familiar_words(words: DataFrame, n_docs: int, share: float = FAMILIAR) -> DataFrame:
    """word: those in at least ``share`` of the documents, counted over all of them."""
    df = words.select(F.explode(F.map_keys("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.where(F.col("df") >= max(1.0, share * n_docs)).select("word")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FAMILIAR, scored: Column | None = None) -> DataFrame:
    """id, unfamiliar (share of words, 0..1), sentence_words (mean) of the ``scored`` rows, all if not given; both 0 for a text without words.

    The familiar words are those of all rows. Words are counted once and stored. A document's words stand in one row, so the sum over them
    combines before its shuffle; the list of familiar words is sent to the executors, its size being
    bounded (see above). Repeated rows are kept apart by a row number and give equal rows.
    """
    words = stored(word_table(docs, id_col, text_col, scored).withColumn("row", F.monotonically_increasing_id()), "words")
    known = familiar_words(words, words.count(), share).withColumn("known", F.lit(1))
    each = words.where("scored").select("id", "row", "n_sentences", "n_words", F.explode_outer("words").alias("word", "n"))
    sums = each.join(F.broadcast(known), "word", "left").groupBy("id", "row", "n_sentences", "n_words").agg(F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("strange"))
    return sums.select(
        F.col("id").alias(id_col),
        F.when(F.col("n_words") > 0, F.coalesce("strange", F.lit(0)) / F.col("n_words")).otherwise(0.0).alias("unfamiliar"),
        F.when(F.col("n_sentences") > 0, F.col("n_words") / F.col("n_sentences")).otherwise(0.0).alias("sentence_words"),
    )


@dataclass(frozen=True)
class Formula:
    """score = weight * 100 * unfamiliar + (1 - weight) * sentence_words; bands meet at the two cuts."""

    weight: float
    cuts: tuple[float, float]
    accuracy: float


def fit(x: np.ndarray, y: np.ndarray) -> Formula:
    """The weight under which most gradings hold; cuts lie midway between neighbouring bands, each taken without its outer SLIPS.

    x: rows of (unfamiliar, sentence_words); y: band ordinals. Of weights whose gradings hold about
    equally often (within a third of a percent), the one that sets the bands furthest apart. Without
    gradings of all bands the cuts stand at 11 and 22, for sentence length alone.
    """
    if len(set(y.tolist())) < len(BANDS):
        return Formula(0.0, (11.0, 22.0), 0.0)
    tried = []
    for w in np.linspace(0, 0.5, 51):
        score = w * 100 * x[:, 0] + (1 - w) * x[:, 1]
        edges = [np.quantile(score[y == k], (SLIPS, 1 - SLIPS)) for k in range(len(BANDS))]
        gaps = [edges[k + 1][0] - edges[k][1] for k in range(len(BANDS) - 1)]
        cuts = [(edges[k + 1][0] + edges[k][1]) / 2 for k in range(len(BANDS) - 1)]
        right = float(np.mean(np.digitize(score, cuts) == y)) if cuts[0] <= cuts[1] else 0.0
        tried.append((right, min(gaps) / (score.std() or 1.0), float(w), (float(cuts[0]), float(cuts[1]))))
    most = max(t[0] for t in tried)
    right, _, w, cuts = max((t for t in tried if t[0] >= most - 1 / 300), key=lambda t: t[1])
    return Formula(w, cuts, right)


def fit_on_gradings(measured: DataFrame, gradings: DataFrame, id_col: str = "doc_id", limit: int = GRADINGS) -> Formula:
    """Fits on at most ``limit`` gradings; other spellings of a band count, unknown bands don't."""
    band = F.lower(F.trim("band"))
    known = gradings.where(band.isin(*BANDS)).select(id_col, band.alias("band"), F.xxhash64(id_col, "grader").alias("h")).orderBy("h", "band").limit(limit)
    rows = lookup(measured, known, [id_col], "inner").select("unfamiliar", "sentence_words", "band").collect()  # at most ``limit``
    x = np.array([(r[0], r[1]) for r in rows], float).reshape(-1, 2)
    return fit(x, np.array([BANDS.index(r[2]) for r in rows], int))


def english_prose(docs: DataFrame) -> DataFrame:
    """Documents whose lang names English in any spelling (en, eng, English, en_GB ...) and that are neither log nor code."""
    lang = F.lower(F.trim("lang"))
    return docs.where(lang.rlike(r"^en(g|glish)?([^a-z].*)?$") & (F.col("doc_kind").isNull() | ~F.lower(F.trim("doc_kind")).isin("log", "code")))


def reading_levels(docs: DataFrame, gradings: DataFrame, least_chars: int = 400) -> DataFrame:
    """doc_id, unfamiliar, sentence_words, score, band of each English prose document of at least ``least_chars``; shorter ones count for the familiar words."""
    measured = stored(features(english_prose(docs), scored=F.col("n_chars") >= least_chars), "reading")
    f = fit_on_gradings(measured, gradings)
    score = F.lit(f.weight * 100) * F.col("unfamiliar") + F.lit(1 - f.weight) * F.col("sentence_words")
    band = F.when(F.col("score") < f.cuts[0], BANDS[0]).when(F.col("score") < f.cuts[1], BANDS[1]).otherwise(BANDS[2])
    return measured.withColumn("score", score).withColumn("band", band)
