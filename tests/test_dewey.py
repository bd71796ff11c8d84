import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.operators import dewey
from tests.conftest import rows

leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab.", max_size=3))
meta = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("kx", min_size=1, max_size=2), x, max_size=3)), max_leaves=6)
entry = st.one_of(st.none(), st.text("ev", max_size=3), st.fixed_dictionaries({"source": st.text("s", max_size=2)}))


def node(children):
    kids = st.one_of(st.none(), children, st.lists(st.one_of(st.none(), children), max_size=3), st.lists(children, max_size=2).map(json.dumps), children.map(json.dumps))
    return st.fixed_dictionaries({"level": st.integers(1, 3)}, optional={"children": kids, "evidence": st.one_of(entry, st.lists(entry, max_size=3)), "metadata": st.one_of(st.none(), st.dictionaries(st.text("m", min_size=1, max_size=2), meta, max_size=3))})


trees = st.recursive(node(st.fixed_dictionaries({"level": st.just(9)})), node, max_leaves=6)


def brute(n, path="0"):
    out = {("node", path)}
    ev = n.get("evidence")
    out |= {("evidence", f"{path}#{i}") for i, e in enumerate(ev if isinstance(ev, list) else [ev]) if e is not None}

    def walk(v, keys):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, [*keys, k])
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, [*keys, str(i)])
        elif v is not None:
            out.add(("metadata", f"{path}@{'.'.join(keys)}"))

    walk(n.get("metadata"), [])
    kids = n.get("children")
    kids = json.loads(kids) if isinstance(kids, str) else kids
    for i, c in enumerate(kids if isinstance(kids, list) else [kids]):
        if isinstance(c, dict):
            out |= brute(c, f"{path}.{i}")
    return out


@settings(max_examples=200, deadline=None)
@given(trees)
def test_labels_equal_a_plain_walk(tree):
    got = list(dewey.label_tree(json.dumps(tree), values=False))
    assert len(got) == len(set(got))
    assert set(got) == brute(tree)


@settings(max_examples=100, deadline=None)
@given(st.one_of(trees, meta))
def test_deep_reader_reads_what_json_reads(v):
    assert dewey._read_deep(json.dumps(v)) == v


def test_a_tree_of_any_depth_is_read():
    text = '{"children": [' * 30_000 + '{"level": 1}' + "]}" * 30_000
    got = list(dewey.label_tree(text, values=False))
    assert len(got) == 30_001


def test_rows_parents_and_defined_cases(spark):
    tree = {"children": {"evidence": "e", "metadata": {"a": [1, {"b": None, "c": True}]}}, "evidence": [None, {"source": "s"}]}
    data = [(1, json.dumps(tree), "x"), (1, json.dumps(tree), "y"), (2, None, "x"), (3, "[1]", "x"), (4, "{broken", "x"), (None, "{}", "x"), (5, "", "x")]
    df = spark.createDataFrame(data, "tree_id long, tree string, row_path string")
    got = rows(dewey.label_trees(df, values=False))
    assert got == sorted(
        [
            (1, "node", "0", ""),
            (1, "evidence", "0#1", "0"),
            (1, "node", "0.0", "0"),
            (1, "evidence", "0.0#0", "0.0"),
            (1, "metadata", "0.0@a.0", "0.0"),
            (1, "metadata", "0.0@a.1.c", "0.0"),
            (None, "node", "0", ""),
        ],
        key=repr,
    )
    full = dewey.label_trees(df)
    assert dewey.node_table(full).count() == 3
    assert rows(dewey.evidence_table(full).select("tree_id", "text", "source")) == sorted([(1, "e", None), (1, None, "s")], key=repr)
    assert {r.schema_path for r in dewey.metadata_table(full).collect()} == {"node.metadata.a.*", "node.metadata.a.*.c"}


def test_empty_table(spark):
    assert dewey.label_trees(spark.createDataFrame([], "tree_id long, tree string")).count() == 0


def test_colliding_paths_keep_both_values(spark):
    tree = json.dumps({"metadata": {"a.b": 1, "a": {"b": 2, "0": 3}, "c": [4]}})
    df = spark.createDataFrame([(1, tree), (1, tree)], "tree_id long, tree string")
    got = {(r.metadata_path, r.schema_path, r.value) for r in dewey.metadata_table(dewey.label_trees(df)).collect()}
    assert got == {("0@a.b", "node.metadata.a\\.b", "1"), ("0@a.b", "node.metadata.a.b", "2"), ("0@a.0", "node.metadata.a.0", "3"), ("0@c.0", "node.metadata.c.*", "4")}
    assert rows(dewey.label_trees(df, values=False).where("row_kind = 'metadata'").select("row_path")) == [("0@a.0",), ("0@a.b",), ("0@c.0",)]


def test_tables_are_found_from_the_data(spark):
    trees = [{"level": 1, "extra": "x", "evidence": ["e", {"source": "s", "own": 1}], "children": [{"level": 2}]}, {"evidence": {"source": "t"}, "metadata": {"k": [True]}}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(9, None), (8, "no json")], "tree_id long, tree string")
    got = dewey.tables(df)
    assert {k: v.columns[3:] for k, v in got.items()} == {"node": ["extra", "level"], "node.evidence.object": ["own", "source"], "node.evidence.string": ["value"], "node.metadata.k.*": ["value"]}
    assert rows(got["node"]) == [(0, "0", "", "x", "1"), (0, "0.0", "0", None, "2"), (1, "0", "", None, None)]
    assert rows(got["node.evidence.object"]) == [(0, "0#1", "0", "1", "s"), (1, "0#0", "0", None, "t")]
    assert dewey.tables(df.limit(0)) == {}
