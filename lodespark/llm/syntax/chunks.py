"""Lexer-state maps and bracket summaries of chunks of a file, and how they compose.

A chunk is a run of whole lines. What its text means depends on the lexer's state where it begins, so
it is represented by a map from each possible state to (state at the end, closers without opener,
openers without closer, fault). Maps compose associatively: chunks can be reduced in any grouping,
and the reduction tells for every chunk in which state and at which depth it begins.

``DEEP`` as an end state says that a chunk ends within a template's substitution, from where the
next chunk's brackets can't be told apart; such a file is read as one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import re

DEEP = "deep"
PAIRS = {")": "(", "]": "[", "}": "{"}
Marks = list[tuple[int, str]]
Lexer = Callable[[str, str], tuple[str, Marks, bool]]
#: end state, closers, openers, fault
Entry = tuple[str, str, str, bool]

_PY = re.compile(r"#[^\n]*|(?P<t>\"\"\"|''')|(?P<q>[\"'])|(?P<b>[\[\](){}])|\\\n|(?P<n>\n)", re.S)
_PY_STRING = {q: re.compile(rf"(?:\\.|[^\\\n{q}])*{q}", re.S) for q in "\"'"}
_JSON = re.compile(r"\"(?:\\.|[^\"\\\n])*(?P<open>\"?)|(?P<b>[\[\]{}])|(?P<c>,)|[^\"\[\]{},]+", re.S)
_TOML = re.compile(r"#[^\n]*|(?P<t>\"\"\"|''')|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|(?P<bad>[\"'])|(?P<b>[\[\]{}])|(?P<n>\n)|[^#\"'\[\]{}\n]+", re.S)
_JS = re.compile(
    r"""(?P<n>\n)|//[^\n]*|(?P<cm>/\*)|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<bad>["'])|(?P<tpl>`)|(?P<b>[\[\](){}])|(?P<d>/)|(?P<p>;)""",
    re.S | re.X,
)
_JS_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_JS_LAST = re.compile(r"([\w$]+|\+\+|--|\S)\s*\Z")
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_BEFORE_REGEX = set("return typeof case do else in of instanceof new void delete throw yield await".split())
_YAML_QUOTE = {'"': re.compile(r"(?:\\.|[^\"\\])*\"", re.S), "'": re.compile(r"(?:''|[^'])*'", re.S)}
_YAML = re.compile(r"(?P<n>\n)|(?P<c>(?<=[\s])\#[^\n]*|^\#[^\n]*)|(?P<q>[\"'])|(?P<b>[\[\]{}])|(?P<lit>[|>][+\-0-9]*[ \t]*(?:\#[^\n]*)?(?=\n|\Z))|(?P<sep>[:,?\-](?=\s|\Z)|,)|(?P<sp>[ \t]+)|(?P<o>.)", re.M | re.S)


def _end_of(quote: str, text: str, at: int, raw: bool = False) -> int:
    """Where a string that ends with ``quote`` ends; -1 if not in this text."""
    while True:
        end = text.find(quote, at)
        if end < 0 or raw:
            return end + len(quote) if end >= 0 else -1
        back = end
        while back > at and text[back - 1] == "\\":
            back -= 1
        if (end - back) % 2 == 0:
            return end + len(quote)
        at = end + 1


def python(text: str, state: str) -> tuple[str, Marks, bool]:
    """States: code, and the quotes of a string that runs over lines."""
    marks: Marks = []
    at = 0
    if state != "code":
        at = _end_of(state, text, 0)
        if at < 0:
            return state, marks, False
    while at < len(text):
        m = _PY.search(text, at)
        if not m:
            break
        at = m.end()
        if m["t"]:
            end = _end_of(m["t"], text, at)
            if end < 0:
                return m["t"], marks, False
            at = end
        elif m["q"]:
            s = _PY_STRING[m["q"]].match(text, at)
            if not s:
                return "code", marks, True
            at = s.end()
        elif m["b"]:
            marks.append((m.start(), m["b"]))
        elif m["n"]:
            marks.append((at, "\n"))
    return "code", marks, False


def json_(text: str, state: str) -> tuple[str, Marks, bool]:
    """One state: JSON strings end on their line."""
    marks: Marks = []
    fault = False
    for m in _JSON.finditer(text):
        if m["b"] or m["c"]:
            marks.append((m.start(), m[0]))
        elif m[0][0] == '"' and not m["open"]:
            fault = True
    return "code", marks, fault


def toml(text: str, state: str) -> tuple[str, Marks, bool]:
    """States: code, and the quotes of a string that runs over lines."""
    marks: Marks = []
    at = 0
    if state != "code":
        at = _end_of(state, text, 0, raw=state == "'''")
        if at < 0:
            return state, marks, False
    while at < len(text):
        m = _TOML.match(text, at)
        at = m.end()
        if m["t"]:
            end = _end_of(m["t"], text, at, raw=m["t"] == "'''")
            if end < 0:
                return m["t"], marks, False
            at = end
            while at < len(text) and text[at] == m["t"][0]:  # up to two quotes may end the text itself
                at += 1
        elif m["bad"]:
            return "code", marks, True
        elif m["b"]:
            marks.append((m.start(), m["b"]))
        elif m["n"]:
            marks.append((at, "\n"))
    return "code", marks, False


def _after(between: str, divides: bool) -> bool:
    """Whether a slash divides after this text without strings, brackets and comments."""
    m = _JS_LAST.search(between)
    if not m:
        return divides
    last = m[1]
    return last in ("++", "--") or (last[0].isalnum() or last[0] in "_$") and last not in _BEFORE_REGEX


def script(text: str, state: str) -> tuple[str, Marks, bool]:
    """States: code/r and code/d (a slash begins a pattern, or divides), comment/r, comment/d, template."""
    marks: Marks = []
    mode, _, before = state.partition("/")
    divides = before == "d"
    nest: list[str] = []  # templates and substitutions open in this chunk, with the braces within
    at = 0
    if mode == "comment":
        end = text.find("*/")
        if end < 0:
            return state, marks, False
        at = end + 2
    elif mode == "template":
        nest.append("`")
    while at < len(text):
        if nest and nest[-1] == "`":
            at = _JS_TEMPLATE.match(text, at).end()
            if text.startswith("`", at):
                nest.pop()
                divides = True
                at += 1
            elif text.startswith("${", at):
                nest.append("$")
                divides = False
                at += 2
            else:
                at = len(text)
            continue
        m = _JS.search(text, at)
        if not m:
            divides = _after(text[at:], divides)
            break
        if m.start() > at:  # what stands between two tokens of interest
            divides = _after(text[at : m.start()], divides)
        at = m.end()
        if m["n"]:
            if not nest:
                marks.append((at, "\n"))
        elif m["b"]:
            b = m["b"]
            if b == "{" and nest:
                nest.append("{")
            elif b == "}" and nest:
                if nest.pop() == "$":
                    continue
            if not nest or b not in "{}":
                marks.append((m.start(), b))
            divides = b in ")]"
        elif m["p"]:
            if not nest:
                marks.append((m.start(), ";"))
            divides = False
        elif m["s"]:
            divides = True
        elif m["tpl"]:
            nest.append("`")
        elif m["cm"]:
            end = text.find("*/", at)
            if end < 0:
                return (DEEP if nest else f"comment/{'d' if divides else 'r'}"), marks, False
            at = end + 2
        elif m["d"]:
            if divides:
                divides = False
            elif r := _JS_REGEX.match(text, m.start()):
                at = r.end()
                divides = True
            else:
                return "code/r", marks, True
        elif m["bad"]:
            return "code/r", marks, True
    if nest:
        return ("template" if nest == ["`"] else DEEP), marks, False
    return f"code/{'d' if divides else 'r'}", marks, False


def yaml_(text: str, state: str) -> tuple[str, Marks, bool]:
    """States: block, flow, and each with an open quote. A block scalar never runs over a chunk that begins at column 0."""
    marks: Marks = []
    mode, _, quote = state.partition(" ")
    depth = 1 if mode == "flow" else 0
    at, fresh = 0, True  # fresh: a value may begin here
    if quote:
        m = _YAML_QUOTE[quote].match(text)
        if not m:
            return state, marks, False
        at, fresh = m.end(), False
    while at < len(text):
        m = _YAML.match(text, at)
        at = m.end()
        if m["n"]:
            marks.append((at, "\n" if not depth else ""))
            fresh = True
        elif m["q"] and fresh:
            s = _YAML_QUOTE[m["q"]].match(text, at)
            if not s:
                return f"{'flow' if depth else 'block'} {m['q']}", marks, False
            at, fresh = s.end(), False
        elif m["b"] and (depth or fresh and m["b"] in "[{"):
            marks.append((m.start(), m["b"]))
            depth += 1 if m["b"] in "[{" else -1
            fresh = depth > 0 and m["b"] in "[{"
        elif m["lit"] and fresh and not depth:
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            indent = len(line) - len(line.lstrip(" "))
            while (s := re.compile(r"\n(?:[ \t]*(?=\n|\Z)|( *)[^\n]*)").match(text, at)) and (s[1] is None or len(s[1]) > indent):
                at = s.end()
        elif m["sep"]:
            fresh = True
        elif not (m["sp"] or m["c"]):
            fresh = False
    return ("flow" if depth else "block"), [x for x in marks if x[1]], False


LEXERS: dict[str, tuple[Lexer, tuple[str, ...]]] = {  # the first state is a file's own
    "python": (python, ("code", '"""', "'''")),
    "json": (json_, ("code",)),
    "toml": (toml, ("code", '"""', "'''")),
    "javascript": (script, ("code/r", "code/d", "comment/r", "comment/d", "template")),
    "typescript": (script, ("code/r", "code/d", "comment/r", "comment/d", "template")),
    "yaml": (yaml_, ("block", "flow", 'block "', "block '", 'flow "', "flow '")),
}


def entry_of(end: str, marks: Marks, fault: bool) -> Entry:
    """The map's entry of one run of the lexer."""
    closers, openers = "", []
    for _, b in marks:
        if b in "([{":
            openers.append(b)
        elif b in PAIRS:
            if openers:
                fault |= openers.pop() != PAIRS[b]
            else:
                closers += b
    return end, closers, "".join(openers), fault


def summarise(lang: str, text: str, state: str) -> Entry:
    """The map's entry of one state."""
    return entry_of(*LEXERS[lang][0](text, state))


def state_map(lang: str, text: str) -> dict[str, Entry]:
    """The whole map of a chunk."""
    return {s: summarise(lang, text, s) for s in LEXERS[lang][1]}


def then(a: Entry, b: Entry) -> Entry:
    """An entry followed by the next chunk's entry of the state in which it ends."""
    openers, closers, fault = a[2], a[1], a[3] or b[3]
    for c in b[1]:
        if openers:
            fault |= openers[-1] != PAIRS[c]
            openers = openers[:-1]
        else:
            closers += c
    return b[0], closers, openers + b[2], fault


def compose(a: dict[str, Entry], b: dict[str, Entry]) -> dict[str, Entry]:
    """The map of two chunks in a row."""
    return {s: then(e, b[e[0]]) if e[0] in b else (DEEP, "", "", e[3]) for s, e in a.items()}


def prefixes(start: str | Entry, maps: Iterable[dict[str, Entry]]) -> tuple[list[Entry], Entry]:
    """What holds where each of the chunks in a row begins, and at the end of the last."""
    so_far: Entry = (start, "", "", False) if isinstance(start, str) else start
    at = []
    for m in maps:
        at.append(so_far)
        so_far = then(so_far, m[so_far[0]]) if so_far[0] in m else (DEEP, "", "", so_far[3])
    return at, so_far


def is_whole(lang: str, e: Entry) -> bool:
    """Whether a file with this summary has every string ended and every bracket closed."""
    done = {"python": ("code",), "json": ("code",), "toml": ("code",), "yaml": ("block",)}.get(lang, ("code/r", "code/d"))
    return e[0] in done and not e[1] and not e[2] and not e[3]
