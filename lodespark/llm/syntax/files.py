"""Which files are not valid source in the language their path claims.

A file is split into chunks of whole lines. Each chunk is summarised by a map from the lexer's states to
the state and open brackets at its end; maps are composed, in any grouping, and tell in which state and
at which depth each chunk begins. With that its statements are cut and parsed by the grammar of the
language, those that run over chunks after their parts were joined; what statements say of each other
(names declared twice, places of imports) meets by file.

A file up to ``CHUNK`` characters goes through all of this where it is read, in chunks of
``grammars.PIECE``; the chunks of a longer one are spread over tasks, their maps reduced block by block,
and verdicts are the same. Where the lexer finds strings or brackets open, the grammar judges the whole
(not in JSON and TOML, which the lexer reads for certain); so it does YAML of several documents, and
TOML's keys defined twice.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.joins import lookup, spread
from lodespark.llm.syntax import script
from lodespark.llm.syntax.chunks import DEEP, LEXERS, Entry, compose, is_whole, prefixes, state_map
from lodespark.llm.syntax.grammars import GRAMMARS, check_file, chunks_of, cuts_apart, future_order, json_member, pieces
from lodespark.storage import stored

#: Characters of a chunk of a file that is spread over tasks, and chunks whose maps are composed by one task.
CHUNK, BLOCK = 1 << 18, 256
_CHUNK_SCHEMA = pa.schema([("file", pa.string()), ("lang", pa.string()), ("i", pa.int32()), ("text", pa.string())])
_MAP_SCHEMA = pa.schema([("file", pa.string()), ("lang", pa.string()), ("i", pa.int32()), ("map", pa.string())])
_SCRIPTS = ("javascript", "typescript")


def languages_of(patches: DataFrame, languages: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Adds lang_name by the extension of the path, in any case; rows of other extensions are left out."""
    known = languages.where(F.col("lang_name").isin(*LEXERS)).groupBy(F.lower(F.trim("ext")).alias("_ext")).agg(F.min("lang_name").alias("lang_name"))
    ext = F.regexp_extract(F.lower(F.rtrim(path_col)), r"\.([^./\\]+)$", 1)
    return lookup(patches.withColumn("_ext", ext), known, ["_ext"], "inner").drop("_ext")


def flags(patches: DataFrame, languages: DataFrame, size: int = CHUNK, keep: tuple[str, ...] = ("patch_id", "repo")) -> DataFrame:
    """keep, lang_name, invalid of each row whose new_content is not null and whose extension has a language.

    An empty file is valid in every language but JSON. Repeated rows give equal rows. Line ends of any
    kind and a byte order mark make no difference.
    """
    rows = languages_of(spread(patches.select(*keep, "file_path", "new_content").where("new_content is not null")), languages).select(*keep, "lang_name", "new_content")
    short = rows.where(F.length("new_content") <= size)
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # of doubtful but valid Python
                bad = [not check_file(lang, t.as_py()) for lang, t in zip(langs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep) + 1)), pa.array(bad, pa.bool_())], names=[*keep, "lang_name", "invalid"])

    done = short.mapInArrow(judge, f"{fields}, lang_name string, invalid boolean")
    long = rows.where(F.length("new_content") > size).withColumn("file", F.md5(F.concat_ws("\x1f", "lang_name", "new_content")))
    cut = stored(_cut(long, size), "chunks")
    if cut.isEmpty():
        return done
    bad = stored(_bad_files(cut), "bad-files").withColumn("invalid", F.lit(True))
    late = lookup(long.select(*keep, "lang_name", "file"), bad, ["file"]).select(*keep, "lang_name", F.coalesce("invalid", F.lit(False)).alias("invalid"))
    return done.unionByName(late)


def _cut(long: DataFrame, size: int) -> DataFrame:
    """file, lang, i, text: the chunks of each different long file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for i, text in enumerate(chunks_of(row["lang_name"], row["new_content"], size)):
                    yield pa.RecordBatch.from_pylist([{"file": row["file"], "lang": row["lang_name"], "i": i, "text": text}], schema=_CHUNK_SCHEMA)

    return long.select("file", "lang_name", "new_content").mapInArrow(run, "file string, lang string, i int, text string").dropDuplicates(["file", "i"])


def _bad_files(cut: DataFrame) -> DataFrame:
    """file of each long file that is not valid."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                known = state_map(row["lang"], row["text"])
                if not cuts_apart(row["lang"], row["text"], row["i"] == 0):
                    known = {s: (DEEP, "", "", False) for s in known}
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "lang": row["lang"], "i": row["i"], "map": json.dumps(known)}], schema=_MAP_SCHEMA)

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        """The map of a block of chunks; composing is associative, so blocks are reduced apart."""
        whole = reduce(compose, (_map(m) for m in pdf.sort_values("i")["map"]))
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "lang": pdf["lang"].iloc[:1], "b": pdf["b"].iloc[:1], "map": [json.dumps(whole)]})

    def of_file(pdf: pd.DataFrame) -> pd.DataFrame:
        """What holds where each block of a file begins, from one map a block."""
        pdf = pdf.sort_values("b")
        lang = pdf["lang"].iloc[0]
        at, end = prefixes(LEXERS[lang][1][0], map(_map, pdf["map"]))
        whole = is_whole(lang, end)
        deep = end[0] == DEEP or whole == (lang == "toml") and lang != "json"
        return pd.DataFrame({"file": pdf["file"], "b": pdf["b"], "before": [json.dumps(x) for x in at], "whole": whole, "deep": deep})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """What holds where each chunk of a block begins."""
        pdf = pdf.sort_values("i")
        at, _ = prefixes(tuple(json.loads(pdf["before"].iloc[0])), map(_map, pdf["map"]))
        return pd.DataFrame({"file": pdf["file"], "i": pdf["i"], "state": [x[0] for x in at], "openers": [x[2] for x in at], "whole": pdf["whole"], "deep": pdf["deep"]})

    mapped = stored(cut.mapInArrow(maps, "file string, lang string, i int, map string").withColumn("b", (F.col("i") / BLOCK).cast("int")), "maps")
    blocks = mapped.groupBy("file", "lang", "b").applyInPandas(of_block, "file string, lang string, b int, map string")
    heads_ = blocks.groupBy("file").applyInPandas(of_file, "file string, b int, before string, whole boolean, deep boolean")
    begun = stored(mapped.join(heads_, ["file", "b"]).groupBy("file", "b").applyInPandas(within, "file string, i int, state string, openers string, whole boolean, deep boolean"), "begun")
    torn = begun.where("not whole and not deep").select("file").distinct()

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                parts = list(pieces(r["lang"], r["text"], r["state"], r["openers"]))
                head = parts.pop(0)[1] if parts and parts[0][0] == 0 else ""
                tail = parts.pop()[1] if parts else None
                bracket = r["openers"][:1] or r["text"].lstrip()[:1]
                own = _declared(r["lang"], [p for _, p in parts])
                ok = own is not None and (r["lang"] in _SCRIPTS or all(_holds(r["lang"], p, False, False, bracket) for _, p in parts))
                row = {"file": r["file"], "lang": r["lang"], "i": r["i"], "bracket": bracket, "head": head, "tail": tail, "ok": ok, "names": list((own or {}).items()), **_places(r["lang"], [p for _, p in parts], r["i"] << 32)}
                yield pa.RecordBatch.from_pylist([row], schema=cut_schema)

    cut_schema = pa.schema(
        [("file", pa.string()), ("lang", pa.string()), ("i", pa.int32()), ("bracket", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("ok", pa.bool_()), ("names", pa.map_(pa.string(), pa.string())), *_PLACES]
    )
    parts = stored(
        cut.join(begun.where("whole"), ["file", "i"]).select("file", "lang", "i", "text", "state", "openers").mapInArrow(statements, "file string, lang string, i int, bracket string, head string, tail string, ok boolean, names map<string, string>, other long, future long"),
        "statements",
    )
    w = Window.partitionBy("file").orderBy("i")
    slim = parts.select("file", "i", F.col("tail").isNotNull().alias("starts"))  # the texts stay out of this window
    begins = slim.select(
        "file",
        "i",
        F.coalesce(F.last(F.when(F.col("starts"), F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("begun_in"),
        F.coalesce(F.max(F.when(F.col("starts"), F.col("i"))).over(Window.partitionBy("file")), F.lit(-1)).alias("last_start"),
    )
    placed = parts.join(begins, ["file", "i"])
    heads = placed.select("file", "lang", "bracket", "last_start", F.col("begun_in").alias("begin"), "i", F.col("head").alias("text"))
    tails = placed.where("tail is not null").select("file", "lang", "bracket", "last_start", F.col("i").alias("begin"), F.lit(-1).alias("i"), F.col("tail").alias("text"))
    joined = heads.unionByName(tails).groupBy("file", "lang", "begin", "last_start").agg(F.max("bracket").alias("bracket"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = _declared(r["lang"], [r["text"]])
                ok = own is not None and (r["lang"] in _SCRIPTS or _holds(r["lang"], r["text"], r["begin"] == -1, r["begin"] == r["last_start"], r["bracket"]))
                out.append({"file": r["file"], "ok": ok, "names": list((own or {}).items()), **_places(r["lang"], [r["text"]], (max(r["begin"], 0) << 32) + (1 << 31) * (r["begin"] >= 0))})
            yield pa.RecordBatch.from_pylist(out, schema=joined_schema)

    joined_schema = pa.schema([("file", pa.string()), ("ok", pa.bool_()), ("names", pa.map_(pa.string(), pa.string())), *_PLACES])

    def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [r["file"] for r in b.to_pylist() if not check_file(r["lang"], r["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["file"])

    deep = cut.join(begun.where("deep").select("file").distinct(), "file", "left_semi").groupBy("file", "lang")
    deep = deep.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))
    judged = stored(parts.select("file", "ok", "names", "other", "future").unionByName(joined.mapInArrow(assembled, "file string, ok boolean, names map<string, string>, other long, future long")), "judged")
    twice = judged.select("file", F.explode("names").alias("name", "how")).groupBy("file", "name").agg(F.count("*").alias("n"), F.max(F.col("how") == "let").alias("lexical")).where("n > 1 and lexical")
    late = judged.groupBy("file").agg(F.min("other").alias("other"), F.max("future").alias("future")).where("other < future").select("file")
    found = torn.unionByName(late).unionByName(judged.where("not ok").select("file")).unionByName(twice.select("file")).unionByName(deep.mapInArrow(whole_files, "file string"))
    return found.distinct()


def _map(text: str) -> dict[str, Entry]:
    return {s: tuple(e) for s, e in json.loads(text).items()}


def _declared(lang: str, statements: list[str]) -> dict[str, str] | None:
    """What statements of a script declare at their top, nothing in other languages; None if one is not valid or a name clashes."""
    declared: dict[str, str] = {}
    for p in statements if lang in _SCRIPTS else ():
        own = script.names(p, lang == "typescript") if p.strip() else {}
        if own is None or script.clash(declared, own):
            return None
        declared |= own
    return declared


_PLACES = [("other", pa.int64()), ("future", pa.int64())]


def _places(lang: str, statements: list[str], first: int) -> dict[str, int | None]:
    """Where the first statement of Python stands before which a __future__ import must, and the last such import."""
    other, future = future_order(statements) if lang == "python" else (None, None)
    return {"other": None if other is None else first + other, "future": None if future is None else first + future}


def _holds(lang: str, text: str, first: bool, last: bool, bracket: str) -> bool:
    if lang != "json":
        check = GRAMMARS[lang]
        lone = lang == "python" and text.startswith("@")  # its definition may have begun in the next chunk
        return not text.strip() or check(text) or lone and check(text + "\ndef _(): pass")
    if not text.strip() and first and not last:
        return False
    lead = text.lstrip(" \t\n\r")[:1] if first else bracket
    return json_member(text, first, last, lead if lead in ("{", "[") else None)


def rates(flagged: DataFrame) -> DataFrame:
    """repo, lang_name, files, invalid_files, rate: over different patch_ids; a patch counts as invalid if any of its rows is."""
    each = flagged.groupBy("patch_id", "repo", "lang_name").agg(F.max("invalid").alias("invalid"))
    return (
        each.groupBy("repo", "lang_name")
        .agg(F.count("*").alias("files"), F.count_if("invalid").alias("invalid_files"))
        .withColumn("rate", F.round(F.col("invalid_files") / F.col("files"), 6))
    )
