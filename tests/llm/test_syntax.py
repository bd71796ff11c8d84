import json
import os
import random
import tomllib

import pyarrow.parquet as pq
import pytest

from lodespark.llm.syntax import chunks, files, script, yaml_grammar
from lodespark.llm.syntax.grammars import check_file, lines
from tests.conftest import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

VALID_JS = r"""#!/usr/bin/env node
"use strict";
import def, { a as b, default as c } from "./m.js";
import * as ns from 'ns';
export * from "x"; export { b as d }; export default class extends def {}
const re = /[/({]\/`/g, t = `a ${x ? `n ${1 / 2}` : "}"} {`, n = 0x1F + 1_000n + .5e-3;
let { p, q: [r = 1, ...s], ...rest } = obj, [u, , v] = arr;
label: for (const k in o) { if (k) continue label; else break label }
for (let i = 0, j; i < 9; i++, j--) ; for await (const x of y) z(x)
async function* gen(a = 1, { b } = {}, ...c) { yield* other(); const r = await x; return r ** -1 }
class A extends (B, C) { static #p = 1; static { this.x = 1 } get x() { return this.#p } set x(v) {} async *m() {} [k] = 2; 'quoted'() {} static async = 1 }
x = a ? b : c => ({ c }), y = async ({ a }, [b]) => { await a }, z ||= w ?? (a && b);
if (a) ; else if (b) { } else { }
do x++; while (x < 5) var yy = new Foo, zz = new a.b.C(1)(2)?.[3]?.(4)?.d
switch (x) { case 1: case 2: { break } default: y }
try { throw new Error(`x`) } catch { } finally { }
a = b
++c
var get = 1, set = 2, of = 3, async = 4, let_ = { get, set, async, get x() { return 1 }, async *g() {}, [k]: 1, "s": 2, 3: 4, ...sp, if: 1, class: 2 };
;[a, b] = [b, a]; ({ a, b: c.d } = e);
export const fn = function named() { return new.target };
import("dyn").then((m) => m.default); import.meta.url
a = b / c / d; f(/=/.test(g)); x = y
/z/g.exec(w)
"""
BAD_JS = ["const a = ;", "let a = 1; let a = 2;", "function f( { }", "if (x { }", "a = 'x\n'", "return 1", "const x;", "for (;;", "class { m( }", "x = `a ${b", "1 = 2", "let a: number = 1", "interface A {}", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "{ \"a\": 1, \"b\": 2 }", "def f(x):\n    return x", "funtion f() {}", "var a = /x", "a ? b", "foo(a b)", "break;", "new", "x = {a: 1 b: 2}", "} {", "\u201cx\u201d", "a => { b", "f(...)", "try {}", "throw\nx", "'\\u12'", "3in", "async () => { for await (x) }", "import { a } from ;", "export { a", "a.1", "do x while", "++", "a++b"]
VALID_TS = r"""
import type { T } from "./t"; import fs = require("fs"); export type { T };
interface Row<K extends string = "a"> extends Base<K>, Other { readonly id: number; label?: string | null; [key: string]: unknown; (x: number): string; new (x: any): Row; m?<T>(a: T): void, get v(): number }
type U = | "a" | 'b' | 1 | -1 | `p${string}` | readonly string[] | [a: number, b?: string, ...rest: any[]];
type F = (this: Window, a?: number, ...r: string[]) => asserts a is number; type C = new () => object; type M = { readonly [K in keyof T as `x${K}`]-?: T[K] };
type Cond<T> = T extends (infer U extends string)[] ? U : T extends Promise<infer V> ? V : never; type Q = typeof x.y; type I = import("m").N<string>;
enum E { A = 1, B = "x", C } const enum K { Z } declare module "m" { export function f(): void; const y: number } namespace N.M { export const a = 1 }
abstract class A<T> extends B<T> implements I, J<T> { private readonly x: number = 1; static y?: string; z!: number; declare w: any; constructor(private a: number, public b = 2) { super() } abstract m(): void; protected async f<T>(this: A<T>, x: T): Promise<void> {} get v(): number { return 1 } [k: string]: any; override o() {} @dec() p = 1 }
function over(a: string): void; function over(a: number): void; function over(a: any) {}
const f = <T,>(x: T): x is string => true, g = async <T>(x: T): Promise<T> => x, h = x as unknown as string, i = y!, j = y satisfies Z, k = <any>z, l = new Map<string, Array<Array<number>>>(), m = fn<string>(1), n = a < b, o = (a < b) > c;
let v: { a: string; b(): void }, w: string | undefined = undefined, arr: Array<() => void> = []; let d!: number;
for (const x of xs as string[]) {} export default interface D {} declare const G: any; declare global { interface Window { a: 1 } } export as namespace Foo;
function isS(x: any): x is string { return typeof x === "string" } let t: unique symbol; let opt = a?.b!.c; type G2 = A<B<C<D>>>; @Comp({ a: 1 }) export class X {} let fnn: (a: number) => (b: string) => void; type Acc = T["a"][number];
"""


@pytest.mark.parametrize("literal, holds", [("/a/gi", True), ("/[(]{2}\\)(?:x|(?<n>y)+?)*$/u", True), ("/a{,2}]/", True), ("/(/", False), ("/a)/", False), ("/*a/", False), ("/a**/", False), ("/a/gg", False), ("/a/k", False), ("/(?a)/", False), ("/^a|b+$/", True), ("/(?=a)\\//", True)])
def test_patterns(literal, holds):
    assert script.pattern_holds(literal) == holds


def test_script_grammar():
    assert script.check(VALID_JS, ts=False)
    assert script.check(VALID_TS, ts=True)
    assert [t for t in BAD_JS if script.check(t, ts=False)] == []
    assert not script.check("interface A { x: ; }", ts=True) and not script.check("let a: = 1", ts=True)


@pytest.mark.parametrize(
    "lang, good, bad",
    [
        ("python", ["", "x = 1\n", "@d\ndef f():\n  return '''\n)'''\n", "if a:\n  b\n# c\nelse:\n  c\n", "x = [\n1,\n]\ny = f'{a[\"(\"]}'\r\nz = 2\r\n", "\ufeffx = 1"], ["def f(:\n", "x = (1", "  x = 1\n", "if a:\nb", "x = 'a", "else:\n  x\n", "print 'x'", "<<<<<<< a\n", "return 1", "}"]),
        ("json", ["1", '{"a": [1, {"b": null}], "c": "x,]"}', "[]", " {} ", '[1, 2]\r\n', '"x"'], ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", '{"a": NaN}', '{"a": 1} {}', '[1,,2]', '{"a": 1, 2}', '"a', "[1]]", '{"a": 01}']),
        ("toml", ["", 'a = 1\n[b]\nc = [\n 1, # [\n 2]\n', 'a = """x\n[y"""\nb = \'c\'\n', "[[x]]\na=1\n[[x]]\na=2\n"], ["a = ", "a = 1\na = 2\n", "[a\n", 'a = "x\n', "[b]\n[b]\n", "a b = 1", "x"]),
        ("yaml", ["", "a: 1\nb:\n- x\n- y: [1, {z: 'it''s'}]\n", "a: |\n  x: [\n  '\nb: \"q\n  r\"\n", "--- \n- a\n...\n---\nb: c\n", "# c\n? x\n: y\n"], ["a: b: c", "a: [1", "a: 'x", "a: 1\n b: 2\n  - c\n", "a:\n\t- b", "- a\nb: c", 'a: "x" y', "{a: 1"]),
        ("javascript", ["", "const a = 1;\n"], ["const a"]),
        ("typescript", ["let a: number\n"], ["let a: "]),
    ],
)
def test_files(lang, good, bad):
    assert [t for t in good if not check_file(lang, t)] == []
    assert [t for t in bad if check_file(lang, t)] == []
    if lang == "yaml":
        assert [t for t in good if not yaml_grammar.check_lines(t)] == []
        assert [t for t in bad if yaml_grammar.check_lines(t)] == []


SOURCES = {
    "python": 'x = """a\n( b\n"""\ndef f(a,\n      b):\n    return [a,\n  # ]\n  b]\ny = {\n"k": \'}\'}\nz = 1\n',
    "javascript": "const a = `x ${b}\n( y\n`;\n/* {\n ( */\nfunction f(a,\n b) {\n return [a / 2,\n /[(]/]\n}\nlet z = {\n a: '}' };\n",
    "toml": 'a = [\n 1,\n 2]\nb = """\n[ x\n"""\n[c]\nd = 1\n',
    "json": '{\n"a": [1,\n2],\n"b": {"c": "]"}\n}\n',
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_maps_compose_to_the_whole(lang):
    lines = SOURCES[lang].splitlines(True)
    start = chunks.LEXERS[lang][1][0]
    whole = chunks.summarise(lang, SOURCES[lang], start)
    assert chunks.is_whole(lang, whole)
    maps = [chunks.state_map(lang, x) for x in lines]
    rnd = random.Random(1)
    while len(maps) > 1:  # in any grouping
        i = rnd.randrange(len(maps) - 1)
        maps[i : i + 2] = [chunks.compose(maps[i], maps[i + 1])]
    assert maps[0][start] == whole


def test_long_files_equal_short_ones(spark):
    rnd = random.Random(2)
    data = []
    for i in range(60):
        ext, lang = rnd.choice([("py", "python"), ("mjs", "javascript"), ("JSON", "json"), ("toml", "toml"), ("yml", "yaml")])
        text = SOURCES.get(lang, "a: |\n  x\n  [\nb: 'q\n  r'\nc:\n- d\n- e: {f: [1,\n  2]}\n")
        if lang == "json":
            text = json.dumps([json.loads(text)] * 3, indent=1)
        elif lang == "python":
            text = text + "@dec\n# c\ndef g():\n    pass\n"
        if rnd.random() < 0.5:
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice(["", "(", "}", '"', "\n"]) + text[at + 1 :]
        data.append((f"p{i}", "r", f"x.{ext}", text, "lang?"))
    data += [("n", "r", "x.py", None, ""), ("m", None, "x.md", "(", ""), ("e", None, "y.py", "", ""), ("j", None, "y.json", "", ""), ("k", "r", None, "x", "")]
    df = spark.createDataFrame(data, "patch_id string, repo string, file_path string, new_content string, lang_name string")
    langs = spark.createDataFrame([("py", "python"), ("mjs", "javascript"), ("json", "json"), ("toml", "toml"), ("yml", "yaml"), ("rb", "ruby"), (None, None)], "ext string, lang_name string")
    short = rows(files.flags(df, langs))
    assert {r[0]: r[3] for r in short if r[0] in "ej"} == {"e": False, "j": True} and len(short) == 62
    for size in (20, 70):
        assert rows(files.flags(df, langs, size=size)) == short
    assert sum(r.invalid_files for r in files.rates(files.flags(df, langs)).collect()) == sum(r[3] for r in short)
    assert files.flags(df.limit(0), langs).count() == 0


def test_long_files_are_judged_as_whole_as_short_ones(spark):
    fill = "".join(f"f{i}({i});\n" for i in range(12))
    keys = "".join(f"k{i} = {i}\n" for i in range(12))
    texts = [
        ("js", 'if (x) /"/.test(y);\n' + fill, False),
        ("ts", fill + "if (x) /[(]/.test(y);\n" + fill, False),
        ("js", "let a = 1;\n" + fill + "let a = 2;\n", True),
        ("js", "var a = 1;\n" + fill + "const a = 2;\n" + fill, True),
        ("js", "class A {\n  x() {\n  }\n}\n" + fill + "let A = 2;\n", True),
        ("js", "var a = 1;\n" + fill + "var a = 2;\nfunction b() {}\n" + fill, False),
        ("js", "{ let a = 1; }\n" + fill + "let a = 2;\n", False),
        ("js", fill + "f(;\n" + fill, True),
        ("js", fill + "f('\n" + fill, True),
        ("toml", "a = 1\n" + keys + "a = 2\n", True),
        ("toml", "[t]\n" + keys + "[u]\n" + keys + "[t]\n", True),
        ("toml", "a.b = 1\n" + keys + "[a]\nc = 1\n", True),
        ("toml", "[[t]]\n" + keys + "[[t]]\n" + keys, False),
        ("toml", keys + "x = [\n", True),
    ]
    data = [(f"p{i}", "r", f"x.{ext}", text) for i, (ext, text, _) in enumerate(texts)]
    df = spark.createDataFrame(data, "patch_id string, repo string, file_path string, new_content string")
    langs = spark.createDataFrame([("js", "javascript"), ("ts", "typescript"), ("toml", "toml")], "ext string, lang_name string")
    for size in (20, 60, 10_000):
        assert {r.patch_id: r.invalid for r in files.flags(df, langs, size=size).collect()} == {f"p{i}": bad for i, (_, _, bad) in enumerate(texts)}


def test_imports_that_must_come_first(spark):
    fill = "".join(f"x{i} = {i}\n" for i in range(12))
    texts = [
        ('"""doc"""\n# c\nfrom __future__ import annotations\n' + fill, False), (fill + "from __future__ import annotations\n", True), ('"a"\n"b"\nfrom __future__ import annotations\n' + fill, True),
        ("from __future__ import annotations\nfrom __future__ import division\n" + fill, False), ("import os\nfrom __future__ import annotations\n", True), ("x = '''\nfrom __future__ import annotations\n'''\n", False),
    ]
    for text, bad in texts:
        assert [check_file("python", text, size) for size in (20, 60, 10_000)] == [not bad] * 3
    data = [(f"p{i}", "r", "x.py", text) for i, (text, _) in enumerate(texts)]
    df = spark.createDataFrame(data, "patch_id string, repo string, file_path string, new_content string")
    langs = spark.createDataFrame([("py", "python")], "ext string, lang_name string")
    assert {r.patch_id: r.invalid for r in files.flags(df, langs, size=30).collect()} == {f"p{i}": bad for i, (_, bad) in enumerate(texts)}


@pytest.mark.parametrize("lang, load", [("python", lambda t: compile(t, "t", "exec", dont_inherit=True)), ("json", json.loads), ("toml", tomllib.loads)])
def test_verdicts_do_not_depend_on_chunks_and_equal_a_parsers(lang, load):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    ext, rnd, n = {"python": ("py", "pyi"), "json": ("json",), "toml": ("toml",)}[lang], random.Random(3), 0
    for r in pq.read_table(f"{SF}/patches.parquet", columns=["file_path", "new_content"]).to_pylist():
        text = lines(r["new_content"] or "")
        if text and r["file_path"].lower().endswith(ext):
            at = rnd.randrange(len(text))
            for t in (text, text[:at], text[:at] + rnd.choice("()[]{}'\":,#") + text[at + 1 :]):
                try:
                    load(t)
                    want = True
                except (ValueError, SyntaxError):
                    want = False
                assert [check_file(lang, t, size) for size in (200, 1024, 1 << 18)] == [want] * 3
                n += 1
    assert n


def test_maps_are_reduced_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 3)
    good = "".join(f"def f{i}():\n    return [{i},\n  (1)]\n" for i in range(40))
    data = [("a", "r", "x.py", good), ("b", "r", "x.py", good + "x = (\n"), ("c", "r", "x.py", good.replace("[7,", "(7,"))]
    df = spark.createDataFrame(data, "patch_id string, repo string, file_path string, new_content string")
    langs = spark.createDataFrame([("py", "python")], "ext string, lang_name string")
    assert {r.patch_id: r.invalid for r in files.flags(df, langs, size=50).collect()} == {"a": False, "b": True, "c": True}
