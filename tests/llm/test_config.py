import json
import os
import tomllib

import pyarrow.parquet as pq
import pytest

from lodespark.llm import secrets
from lodespark.llm.config import walk

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def leaves(v, over=()):
    """Strings of a parsed value by path."""
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in leaves(y, (*over, k))]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in leaves(y, (*over, str(i)))]
    return [(over, v)] if isinstance(v, str) else []


def values(text, ext):
    return [(path, text[a:b]) for path, a, b, style in walk(text, ext).leaves if style == "quoted"]


@pytest.mark.parametrize("ext,load", [("json", json.loads), ("toml", tomllib.loads)])
def test_strings_stand_where_a_parser_finds_them(ext, load):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    n = 0
    for r in pq.read_table(f"{SF}/patches.parquet", columns=["file_path", "new_content"]).to_pylist():
        if r["new_content"] and r["file_path"].lower().endswith(ext):
            try:
                want = leaves(load(r["new_content"]))
            except ValueError:
                continue
            got = values(r["new_content"], ext)
            assert sorted(p for p, _ in got) == sorted(p for p, _ in want)
            assert sorted((p, v) for p, v in got if "\\" not in v and "\n" not in v) == sorted((p, v) for p, v in want if (p, v) in got)
            n += 1
    assert n


YAML = """
# top
a: &x 1
b:
  - name: "one: two"   # note
    list: [p, {q: r, 's t': "u"}]
  -   deep:
        k: 'it''s'
  - plain
seq:
- v1
- w: v2
  y: v3
block: |
  line # no comment
    more

after: !vault z
"quoted key": >-
  folded
long: "over
  lines"
empty:
last: value with blanks
"""


def test_yaml_paths():
    got = [(".".join(p), YAML[a:b], s) for p, a, b, s in walk(YAML, "yaml").leaves]
    assert got == [
        ("a", "1", "bare"), ("b.0.name", "one: two", "quoted"), ("b.0.list.0", "p", "bare"), ("b.0.list.1.q", "r", "bare"), ("b.0.list.1.s t", "u", "quoted"), ("b.1.deep.k", "it''s", "quoted"),
        ("b.2", "plain", "bare"), ("seq.0", "v1", "bare"), ("seq.1.w", "v2", "bare"), ("seq.1.y", "v3", "bare"), ("block", "  line # no comment\n    more\n\n", "block"), ("after", "z", "tagged"),
        ("quoted key", "  folded\n", "block"), ("long", "over\n  lines", "quoted"), ("last", "value with blanks", "bare"),
    ]
    assert [YAML[a:b] for a, b in walk(YAML, "yaml").comments] == ["# top", "# note"]


FOUND = [
    ("yaml", "db:\n  password: |\n    Tr0ub4dor&3x\n", "Tr0ub4dor&3x"),
    ("yaml", "password: &pw Tr0ub4dor&3x\nother: *pw\n", "Tr0ub4dor&3x"),
    ("toml", "[db]\npassword = '''\nTr0ub4dor&3x'''\n", "Tr0ub4dor&3x"),
    ("json", '{"db":{"password":{"note":"x","value":"Tr0ub4dor&3x"}}}', "Tr0ub4dor&3x"),
    ("json", '{"pass\\u0077ord": "Tr0ub4dor&3x"}', "Tr0ub4dor&3x"),
    ("xml", "<db><password>Tr0ub4dor&amp;3x</password></db>", "Tr0ub4dor&amp;3x"),
    ("xml", '<add key="api_key" value="Zk39dkEo20s"/>', "Zk39dkEo20s"),
    ("yaml", "passphrase: correct horse battery staple\n", "correct horse battery staple"),
    ("json", '{"password": "hunterhunter"}', "hunterhunter"),
    ("yaml", "password: swordfish\n", "swordfish"),
    ("toml", 'password = "x9!k"', "x9!k"),
    ("yaml", "api_keys:\n  - Zk39dkEo20s\n", "Zk39dkEo20s"),
    ("env", "export DB_PASSWORD=Tr0ub4dor3x # old\n", "Tr0ub4dor3x"),
    ("ini", "[db]\npwd: swordfish\n", "swordfish"),
    ("yaml", "args:\n  - '--pwd=dgICIBzpZE'\n", "dgICIBzpZE"),
    ("py", 'x = "sk_a1b2c3d4e5f6g7h8"', "sk_a1b2c3d4e5f6g7h8"),
    ("py", 'x = "hf_a1b2c3d4e5f6g7h8"', "hf_a1b2c3d4e5f6g7h8"),
    ("yaml", "password:\n" + "  note: n\n" * 2_100 + "  value: 'Tr0ub4dor&3x'\n", "Tr0ub4dor&3x"),
    ("json", '{\n<<<<<<< HEAD\n"a": 1,\n=======\n>>>>>>> b\n"password": "Tr0ub4dor&3x"', "Tr0ub4dor&3x"),
]


@pytest.mark.parametrize("ext,text,value", FOUND, ids=range(len(FOUND)))
def test_found_by_key_path(ext, text, value):
    assert [text[f.start : f.end].strip() for f in secrets.scan(text, ext)] == [value]


NOT_FOUND = [
    ("yaml", "password: ${DB_PASSWORD}\n"), ("yaml", "password: !vault abcDEF123\n"), ("yaml", "password: *pw\n"), ("yaml", "password: 'password must have 12 characters'\n"), ("json", '{"password": 12345678}'),
    ("json", '{"password": "required"}'), ("toml", 'password = "vault:db/main"'), ("yaml", "password:\n  from_env: PASSWORD\n"), ("json", '{"password": "", "version": "10.0.0-rc1"}'), ("yaml", "password: true\n"),
    ("json", '{"public_key": "Zk39dkEo20s", "token_count": "Zk39dkEo20s", "password": null}'), ("ini", "password = changeme\n"),
    ("json", '{\n-  "password":\n+  "version": "Zk39dkEo20s"\n}'),
]


@pytest.mark.parametrize("ext,text", NOT_FOUND, ids=range(len(NOT_FOUND)))
def test_not_found(ext, text):
    assert secrets.scan(text, ext) == []


@pytest.mark.parametrize("ext,load", [("json", json.loads), ("toml", tomllib.loads)])
def test_redacted_configuration_keeps_its_shape(ext, load):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    shape = lambda v: {k: shape(x) for k, x in v.items()} if isinstance(v, dict) else [shape(x) for x in v] if isinstance(v, list) else type(v).__name__
    texts = [t for e, t, _ in FOUND if e == ext]
    texts += [r["new_content"] for r in pq.read_table(f"{SF}/patches.parquet", columns=["file_path", "new_content"]).to_pylist() if r["new_content"] and r["file_path"].lower().endswith(ext)]
    for text in texts:
        try:
            before = shape(load(text))
        except ValueError:
            continue
        assert shape(load(secrets.redact(text, secrets.scan(text, ext)))) == before


def test_long_and_deep_texts_end():
    for ext in ("json", "yaml", "toml", "xml", "ini"):
        walk("[" * 20_000 + "]" * 20_000, ext)
        walk("a: {b: " * 5_000, ext)
        walk('x = "' + "\\" * 99_999, ext)
        walk("- " * 20_000, ext)
        walk("<a b='" * 5_000, ext)
        assert walk("", ext).leaves == []
