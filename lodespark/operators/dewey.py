"""Nested trees to flat tables by Dewey labels.

A record of a tree (JSON text) becomes one row for each node, evidence entry and metadata value.
A row's ``row_path`` is its Dewey label: the ordinals on the way down from the root. The parent's
label is a truncation of it, so no link is kept beside it, and any two rows of one tree can be
related by prefix. Rows that share a ``schema_path`` (the way down without ordinals) form one flat
table; which tables there are and which fields each has is found from the data.

Defined cases: a tree that is null, not JSON, or not an object gives no rows. A list entry or lone
item that is null takes its position and gives no row; so does a child that is no object. Values whose
paths collide (``{"a.b": 1, "a": {"b": 2}}``) are rows of their own, told apart by schema path or value. Children
may be a list, one lone object (position 0) or either of them as JSON text. Repeated records give
their rows once. A tree of any depth is read; nothing recurses.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.storage import stored

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([\[\]{},:])|([^\s\[\]{},:"]+))', re.S)

_LABELS = "row_kind string, row_path string"
_VALUES = "schema_path string, value_type string, value string"
_ARROW = {"row_kind": pa.string(), "row_path": pa.string(), "schema_path": pa.string(), "value_type": pa.string(), "value": pa.string()}


def read_json(text: str) -> object:
    """JSON of any depth; raises ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str) -> object:
    """As json.loads, with a stack of its own in place of recursion."""
    stack: list = []
    done: list = []
    key: list = []
    want, pos = "value", 0

    def put(v: object) -> str:
        if not stack:
            done.append(v)
            return "end"
        if isinstance(stack[-1], list):
            stack[-1].append(v)
        else:
            stack[-1][key.pop()] = v
        return "next"

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip():
                raise ValueError("no JSON")
            break
        pos = m.end()
        string, mark, word = m.groups()
        if mark in ("]", "}") and stack and want in ("next", "first"):
            top = stack.pop()
            if isinstance(top, list) != (mark == "]"):
                raise ValueError("brackets cross")
            want = put(top)
        elif mark == "," and want == "next":
            want = "value" if isinstance(stack[-1], list) else "key"
        elif mark == ":" and want == "colon":
            want = "value"
        elif string and stack and isinstance(stack[-1], dict) and want in ("key", "first"):
            key.append(json.loads(string))
            want = "colon"
        elif mark in ("[", "{") and (want == "value" or want == "first" and isinstance(stack[-1], list)):
            stack.append([] if mark == "[" else {})
            want = "first"
        elif (string or word) and (want == "value" or want == "first" and isinstance(stack[-1], list)):
            want = put(json.loads(string or word))
        else:
            raise ValueError("no JSON")
    if want != "end":
        raise ValueError("JSON ends early")
    return done[0]


def _unwrap(v: object) -> object:
    """What JSON text holds, and any other value as it is; None for text that holds nothing."""
    while isinstance(v, str):
        try:
            v = read_json(v)
        except ValueError:
            return None
    return v


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _kind(v: object) -> str:
    return {bool: "boolean", int: "number", float: "number", str: "string", dict: "object", list: "array"}.get(type(v), "null")


def label_tree(text: str | None, values: bool = True) -> Iterator[tuple]:
    """Rows (row_kind, row_path[, schema_path, value_type, value]) of one tree, each once. Keys within a schema path have their dots escaped."""
    root = _unwrap(text) if text is not None else None
    if not isinstance(root, dict):
        return
    seen: set = set()
    nodes: list = [("0", 1, root)]
    while nodes:
        path, depth, node = nodes.pop()
        if values:
            own = {k: v for k, v in node.items() if k not in ("children", "evidence", "metadata")}
            yield "node", path, "node", "object", _text(own)
        else:
            yield "node", path
        entries = node.get("evidence")
        for i, item in enumerate(entries if isinstance(entries, list) else [entries]):
            if item is not None:
                yield ("evidence", f"{path}#{i}", f"node.evidence.{_kind(item)}", _kind(item), _text(item)) if values else ("evidence", f"{path}#{i}")
        todo: list = [((), (), node.get("metadata"))]
        while todo:
            keys, shape, v = todo.pop()
            if isinstance(v, dict):
                todo += [((*keys, k), (*shape, k.replace("\\", "\\\\").replace(".", "\\.")), x) for k, x in v.items()]
            elif isinstance(v, list):
                todo += [((*keys, str(i)), (*shape, "*"), x) for i, x in enumerate(v)]
            elif v is not None:
                label = f"{path}@{'.'.join(keys)}"
                row = ("metadata", label, ".".join(("node", "metadata", *shape)), _kind(v), _text(v)) if values else ("metadata", label)
                if row not in seen:
                    seen.add(row)
                    yield row
        children = _unwrap(node.get("children"))
        for i, child in enumerate(children if isinstance(children, list) else [children]):
            child = _unwrap(child)
            if isinstance(child, dict):
                nodes.append((f"{path}.{i}", depth + 1, child))


def parent_path(row_kind: Column, row_path: Column) -> Column:
    """The parent's label by truncation: '' for a root, the holding node for evidence and metadata."""
    return (
        F.when(row_kind == "node", F.when(F.instr(row_path, ".") == 0, F.lit("")).otherwise(F.regexp_replace(row_path, r"\.[0-9]+$", "")))
        .when(row_kind == "evidence", F.substring_index(row_path, "#", 1))
        .otherwise(F.substring_index(row_path, "@", 1))
    )


def label_trees(trees: DataFrame, id_col: str = "tree_id", tree_col: str = "tree", values: bool = True) -> DataFrame:
    """Rows of all trees: id, row_kind, row_path, parent_path and, with ``values``, schema_path, value_type, value.

    Trees are parsed where they are read (no shuffle of texts); the one shuffle is of finished rows,
    partly distinct before it, and spreads by whole rows, so neither one huge tree nor one id that is
    repeated in a third of the records makes a hot task.
    """
    id_field = trees.schema[id_col]
    names = ["row_kind", "row_path", *(["schema_path", "value_type", "value"] if values else [])]
    id_type = trees.select(id_col).schema[0].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            take: list[int] = []
            out: list[list] = [[] for _ in names]

            def flush() -> pa.RecordBatch:
                arrays = [ids.take(pa.array(take, pa.int64())), *(pa.array(v, _ARROW[n]) for n, v in zip(names, out, strict=True))]
                take.clear()
                for v in out:
                    v.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["id", *names])

            for i, text in enumerate(batch.column(1)):
                for row in label_tree(text.as_py(), values):
                    take.append(i)
                    for v, x in zip(out, row, strict=True):
                        v.append(x)
                    if len(take) >= 50_000:
                        yield flush()
            if take:
                yield flush()

    schema = f"id {id_type}, {_LABELS}" + (f", {_VALUES}" if values else "")
    rows = trees.select(F.col(id_col).alias("id"), F.col(tree_col).alias("tree")).where("tree is not null").mapInArrow(parse, schema).distinct()
    out = rows.withColumn("parent_path", parent_path(F.col("row_kind"), F.col("row_path")))
    return out.select(F.col("id").alias(id_field.name), "row_kind", "row_path", "parent_path", *names[2:])


def schema_tables(labelled: DataFrame) -> DataFrame:
    """schema_path, n_rows, fields: the tables that the data hold, with the fields of those whose rows are objects.

    Two small results joined: rows are counted, and fields found, by partial aggregates that combine
    before they move, so a path that holds a third of all rows is no hot task.
    """
    counted = labelled.groupBy("schema_path").agg(F.count("*").alias("n_rows"))
    keys = labelled.where("value_type = 'object'").select("schema_path", F.explode(F.json_object_keys("value")).alias("field")).distinct()
    fields = keys.groupBy("schema_path").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return counted.join(fields, "schema_path", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def flat_table(labelled: DataFrame, schema_path: str, fields: Sequence[str], id_col: str = "tree_id") -> DataFrame:
    """id, row_path, parent_path and the ``fields`` of the rows of one schema path, as text; a field that a row lacks is null."""
    held = F.from_json("value", "map<string, string>")
    rows = labelled.where(F.col("schema_path") == schema_path).withColumn("_m", held)
    return rows.select(id_col, "row_path", "parent_path", *(F.try_element_at("_m", F.lit(f)).alias(f) for f in fields))


def tables(trees: DataFrame, id_col: str = "tree_id", tree_col: str = "tree") -> dict[str, DataFrame]:
    """Every flat table of the trees by schema path; the trees are parsed once and their labelled rows stored.

    Rows whose schema path has no objects have one column, ``value``. For data with few schema paths:
    their names and fields are held by the driver.
    """
    labelled = stored(label_trees(trees, id_col, tree_col), "labelled")
    out = {}
    for t in schema_tables(labelled).toLocalIterator():
        own = labelled.where(F.col("schema_path") == t["schema_path"]).select(id_col, "row_path", "parent_path", "value")
        out[t["schema_path"]] = flat_table(labelled, t["schema_path"], t["fields"], id_col) if t["fields"] else own
    return out


def node_table(labelled: DataFrame, id_col: str = "tree_id") -> DataFrame:
    """The flat table of nodes, with the fields of a node as columns."""
    t = flat_table(labelled, "node", ["level", "question", "answer", "confidence", "rebuttal"], id_col)
    depth = F.size(F.split("row_path", r"\."))
    numbers = {"level": F.expr("try_cast(level as int)"), "confidence": F.expr("try_cast(confidence as double)")}
    return t.withColumns(numbers).select(id_col, F.col("row_path").alias("node_path"), "parent_path", depth.alias("depth"), "level", "question", "answer", "confidence", "rebuttal")


def evidence_table(labelled: DataFrame, id_col: str = "tree_id") -> DataFrame:
    """The flat tables of evidence together: text entries in ``text``, object entries in their own columns."""
    place = [id_col, F.col("row_path").alias("evidence_path"), F.col("parent_path").alias("node_path"), F.substring_index("row_path", "#", -1).cast("int").alias("position")]
    objects = flat_table(labelled, "node.evidence.object", ["source", "type", "weight", "contradicts"], id_col).select(
        *place, F.lit(None).cast("string").alias("text"), "source", "type", F.expr("try_cast(weight as double)").alias("weight"), F.expr("try_cast(contradicts as boolean)").alias("contradicts")
    )
    rest = labelled.where(F.startswith("schema_path", F.lit("node.evidence.")) & (F.col("schema_path") != "node.evidence.object"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("source", "string"), ("type", "string"), ("weight", "double"), ("contradicts", "boolean"))]
    return objects.unionByName(rest.select(*place, F.when(F.col("value_type") == "string", F.col("value")).alias("text"), *none))


def metadata_table(labelled: DataFrame, id_col: str = "tree_id") -> DataFrame:
    """The flat tables of metadata values together, keyed by schema path."""
    return labelled.where(F.startswith("schema_path", F.lit("node.metadata"))).select(
        id_col, F.col("row_path").alias("metadata_path"), F.col("parent_path").alias("node_path"), "schema_path", "value_type", "value"
    )
