"""Configuration formats as key paths with the offsets of their values.

``walk`` reads JSON, YAML, TOML, XML and key-value files (ini, env, properties) and gives each scalar
with the keys over it, places in lists as numbers, and where its characters stand; and each comment.
Nothing is decoded but keys: offsets are those of the text, so a value can be overwritten in place.

The readers go on after what is no valid part of the format (conflict markers, cut ends, the two sides
of a diff): they take up again with the next line or token. They read texts of any length and depth in
one pass, with a stack of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Keys over a value, its first character, the one behind its last, and how it is written: quoted, bare, block (lines of their own), tagged or alias (no literal).
Leaf = tuple[tuple[str, ...], int, int, str]


@dataclass
class Walked:
    """What a text holds: its scalars, and its comments as (start, end)."""

    leaves: list[Leaf] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)


_TRIPLE = {'"': '"""', "'": "'''"}
_DQ = re.compile(r'"((?:\\.|[^"\\\n])*)("?)')
_SQ = re.compile(r"'((?:''|[^'\n])*)('?)")
_SPACE = re.compile(r"[ \t\r\n]+")
_WORD = re.compile(r"[^\s\[\]{},:=#\"']+")
_FLOW_PLAIN = re.compile(r"[^\s\[\]{},#\"'](?:[^\[\]{},:#\n]|:(?![\s,\[\]{}])|(?<=\S)#)*")


def _key(text: str) -> str:
    """A key as it reads, without quotes and escapes."""
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        try:
            return str(json.loads(text))
        except ValueError:
            return text[1:-1]
    return text[1:-1].replace("''", "'") if text[:1] == "'" and len(text) > 1 else text


def _quoted(text: str, at: int, multi: bool, raw: bool) -> tuple[int, int, int]:
    """Of the string that begins at ``at``: first character, the one behind the last, and where reading goes on."""
    q = text[at]
    if multi and text.startswith(_TRIPLE[q], at):
        end = at + 3
        while True:
            end = text.find(_TRIPLE[q], end)
            if end < 0:
                return at + 3, len(text), len(text)
            back = end
            while q == '"' and back > at + 3 and text[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            end += 1
        stop = end + 3
        while stop < len(text) and text[stop] == q and stop < end + 5:  # up to two quotes may end the text itself
            stop += 1
        return at + 3, stop - 3, stop
    if q == "'" and raw:
        end = text.find("'", at + 1)
        line = text.find("\n", at)
        if end < 0 or 0 <= line < end:
            end = line if line >= 0 else len(text)
            return at + 1, end, end
        return at + 1, end, end + 1
    m = (_DQ if q == '"' else _SQ).match(text, at)
    return m.start(1), m.end(1), m.end()


def _brackets(text: str, at: int, over: tuple[str, ...], out: Walked, lang: str, loose: bool = False) -> int:
    """Reads the array or object that begins at ``at`` with all that is within; where reading goes on. A ``loose`` text may lack its brackets, as a part of one does."""
    sep = "=" if lang == "toml" else ":"
    stack: list[list] = [["{", 0, None]] if loose else []  # [bracket, number of the item, key or None]
    path = lambda: (*over, *(str(s[1]) if s[0] == "[" else s[2] or "" for s in stack if s[0] == "[" or s[2] is not None or s is not stack[0] or not loose))

    def scalar(start: int, end: int, style: str, token: str, stop: int) -> None:
        top = stack[-1]
        if top[0] == "{":
            behind = _SPACE.match(text, stop)
            after = behind.end() if behind else stop
            if text[after : after + 1] == sep:
                top[2] = _key(token)
                return
            if lang == "toml" and text[after : after + 1] == ".":
                return
        out.leaves.append((path(), start, end, style))

    while at < len(text):
        c = text[at]
        if c in "[{":
            stack.append([c, 0, None])
            at += 1
        elif c in "]}":
            at += 1
            if loose and len(stack) == 1:
                stack[0][2] = None
                continue
            stack.pop()
            if not stack:
                return at
        elif c == ",":
            stack[-1][1] += 1
            stack[-1][2] = None
            at += 1
        elif c in "\"'":
            start, end, stop = _quoted(text, at, lang == "toml", lang == "toml")
            scalar(start, end, "quoted", text[at:stop], stop)
            at = stop
        elif c == "#" or text.startswith("//", at):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.comments.append((at, end))
            at = end
        elif m := _SPACE.match(text, at):
            at = m.end()
            if lang == "yaml" and text[at - 1] == "\n" and at < len(text) and text[at] not in "]}[{,\"'":
                return at  # a line at column 0 is not within brackets
        elif c == sep:
            at += 1
        elif m := (_FLOW_PLAIN if lang == "yaml" else _WORD).match(text, at):
            end = at + len(m[0].rstrip())
            style = "alias" if lang == "yaml" and c == "*" else "tagged" if lang == "yaml" and c == "!" else "bare"
            scalar(at, end, style, text[at:end], end)
            at = m.end()
        else:
            at += 1
    return at


def _json(text: str, out: Walked) -> None:
    _brackets(text, 0, (), out, "json", loose=True)


_ROW = re.compile(r"[^\n]*")
_TOML_HEADER = re.compile(r"[ \t]*\[\[?[ \t]*((?:\"[^\"\n]*\"|'[^'\n]*'|[^\]\n\"'])+)\]\]?[ \t]*(#[^\n]*|\r?)$", re.M)
_TOML_KEY = re.compile(r"[ \t]*((?:\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|[\w\-]+)(?:[ \t]*\.[ \t]*(?:\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|[\w\-]+))*)[ \t]*=[ \t]*")
_PARTS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|[^.\s\"']+")


def _toml(text: str, out: Walked) -> None:
    at, table = 0, ()
    while at < len(text):
        line = _ROW.match(text, at)
        if m := _TOML_HEADER.match(text, at):
            table = tuple(_key(p) for p in _PARTS.findall(m[1]))
            if m[2].startswith("#"):
                out.comments.append(m.span(2))
        elif m := _TOML_KEY.match(text, at):
            over = (*table, *(_key(p) for p in _PARTS.findall(m[1])))
            stop = _value(text, m.end(), over, out, "toml")
            end = text.find("\n", stop)
            at = len(text) if end < 0 else end + 1
            if stop < len(text) and (hash_ := text.find("#", stop, at)) >= 0:
                out.comments.append((hash_, at))
            continue
        elif line[0].lstrip().startswith("#"):
            out.comments.append(line.span())
        elif line[0].strip():
            out.leaves.append((table, line.start(), line.end(), "block"))  # no TOML; read as text
        at = line.end() + 1


_REST = re.compile(r"[^\n#]*")


def _value(text: str, at: int, over: tuple[str, ...], out: Walked, lang: str) -> int:
    """The value that begins at ``at``, on this line; where reading goes on."""
    c = text[at : at + 1]
    if c in ("[", "{"):
        return _brackets(text, at, over, out, lang)
    if c in ('"', "'"):
        start, end, stop = _quoted(text, at, lang == "toml", lang == "toml")
        out.leaves.append((over, start, end, "quoted"))
        return stop
    m = _REST.match(text, at)
    end = at + len(m[0].rstrip())
    if end > at:
        out.leaves.append((over, at, end, "bare"))
    return m.end()


_YAML_KEY = re.compile(r"(?P<k>\"(?:\\.|[^\"\\\n])*\"|'(?:''|[^'\n])*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^\n#:]*?(?:(?::(?=\S)|(?<=\S)#)[^\n#:]*?)*|[\-?:](?=\S)[^\n#:]*?)[ \t]*:(?=[ \t\r\n]|$)[ \t]*")
_DASH = re.compile(r"-(?=[ \t\r\n]|$)[ \t]*")
_PROPS = re.compile(r"(?:(?:&[^\s\[\]{},]+|(?P<tag>![^\s\[\]{},]*))[ \t]*)+")
_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*(?:#[^\n]*)?\r?$", re.M)
_PLAIN_ENDS = re.compile(r"[ \t]+#|\r?$", re.M)


def _yaml(text: str, out: Walked) -> None:
    """Blocks by indentation. ``stack``: (indentation, key or number) of what is open."""
    at = 0
    stack: list[list] = []
    while at < len(text):
        line = _ROW.match(text, at)
        body = line[0]
        indent = len(body) - len(body.lstrip(" "))
        nxt = line.end() + 1
        rest = body[indent:]
        if not rest.strip():
            at = nxt
            continue
        if rest.lstrip().startswith("#"):
            out.comments.append(line.span())
            at = nxt
            continue
        if not indent and rest[:3] in ("---", "...") and not rest[3:4].strip():
            stack.clear()
            at = line.start() + 4 if len(body) > 3 else nxt
            continue
        pos, col = line.start() + indent, indent
        while m := _DASH.match(text, pos):  # items that begin on this line
            while stack and (stack[-1][0] > col or stack[-1][0] == col and stack[-1][2] == "key" and len(stack) > 1 and stack[-2][0] == col and stack[-2][2] == "item"):
                stack.pop()
            if stack and stack[-1][0] == col and stack[-1][2] == "item":
                stack[-1][1] += 1
            else:
                stack.append([col, 0, "item"])
            pos, col = m.end(), col + len(m[0])
        if pos >= line.end():
            at = nxt
            continue
        k = _YAML_KEY.match(text, pos)
        if k and k.end() > line.end() + 1:
            k = None
        while stack and (stack[-1][0] > col or k and stack[-1][0] == col and stack[-1][2] in ("key", "item")):
            stack.pop()
        if not k and stack and stack[-1][2] == "key" and stack[-1][0] >= col and pos == line.start() + indent:
            stack.pop()
        if k:
            stack.append([col, _key(k["k"]), "key"])
            pos = min(k.end(), line.end())
        over = tuple(str(s[1]) for s in stack)
        tag = None
        if m := _PROPS.match(text, pos):
            tag, pos = m["tag"], m.end()
        c = text[pos : pos + 1]
        if pos >= line.end() or c in "\r\n":
            at = nxt
        elif c in "|>" and _BLOCK.match(text, pos):
            low = stack[-1][0] if stack else -1
            start = end = nxt
            while end < len(text):
                row = _ROW.match(text, end)
                if row[0].strip() and len(row[0]) - len(row[0].lstrip(" ")) <= low:
                    break
                end = row.end() + 1
            end = min(end, len(text))
            if end > start:
                out.leaves.append((over, start, end, "block"))
            at = end
        elif c == "#":
            out.comments.append((pos, line.end()))
            at = nxt
        elif c in "[{":
            stop = _brackets(text, pos, over, out, "yaml")
            end = text.find("\n", stop - 1 if text[stop - 1 : stop] == "\n" else stop)
            at = len(text) if end < 0 else end + 1
        elif c in "\"'":
            at = _yaml_quoted(text, pos, over, out, tag)
        else:
            end = _PLAIN_ENDS.search(text, pos).start()
            end = min(end, line.end())
            style = "alias" if c == "*" else "tagged" if tag and tag not in ("!!str", "!") else "bare"
            out.leaves.append((over, pos, end, style))
            if (hash_ := text.find(" #", end, line.end())) >= 0:
                out.comments.append((hash_ + 1, line.end()))
            at = nxt


_TO_END = re.compile(r"[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")
_YAML_LONG = {'"': re.compile(r'"((?:\\.|[^"\\])*)"', re.S), "'": re.compile(r"'((?:''|[^'])*)'", re.S)}


def _yaml_quoted(text: str, at: int, over: tuple[str, ...], out: Walked, tag: str | None) -> int:
    """A quoted scalar; one that its line leaves open goes on over lines if what follows its end closes the value."""
    start, end, stop = _quoted(text, at, False, False)
    if text[stop - 1] != text[at] or stop == start:
        m = _YAML_LONG[text[at]].match(text, at)
        if m and _TO_END.match(text, m.end()):
            start, end, stop = m.start(1), m.end(1), m.end()
    out.leaves.append((over, start, end, "tagged" if tag and tag not in ("!!str", "!") else "quoted"))
    line = text.find("\n", stop)
    line = len(text) if line < 0 else line
    if (hash_ := text.find(" #", stop, line)) >= 0:
        out.comments.append((hash_ + 1, line))
    return line + 1


_SECTION = re.compile(r"[ \t]*\[([^\]\n]+)\][ \t]*\r?$", re.M)
_PAIR = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+)?(?P<k>[\"']?[A-Za-z_][\w.\-]*[\"']?)[ \t]*(?:=|:(?=[ \t]))[ \t]*")


def _pairs(text: str, out: Walked) -> None:
    """Key-value lines, with sections."""
    at, section = 0, ()
    while at < len(text):
        line = _ROW.match(text, at)
        if line[0].lstrip()[:1] in ("#", ";", "!"):
            out.comments.append(line.span())
        elif m := _SECTION.match(text, at):
            section = (m[1].strip(),)
        elif m := _PAIR.match(text, at):
            over, pos = (*section, m["k"].strip("\"'")), m.end()
            if text[pos : pos + 1] in ('"', "'"):
                start, end, _ = _quoted(text, pos, False, False)
                out.leaves.append((over, start, end, "quoted"))
            else:
                end = min(_PLAIN_ENDS.search(text, pos).start(), line.end())
                if end > pos:
                    out.leaves.append((over, pos, end, "bare"))
                if end < line.end() and text[end : line.end()].lstrip().startswith("#"):
                    out.comments.append((end, line.end()))
        elif line[0].strip():
            out.leaves.append((section, line.start(), line.end(), "block"))
        at = line.end() + 1


_XML = re.compile(r"<!--(?P<c>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cd>.*?)(?:\]\]>|\Z)|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<lone>/)?>|<[?!][^>]*>|(?P<t>[^<]+)|<", re.S)
_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _xml(text: str, out: Walked) -> None:
    """Elements and attributes; text stands under its element, an element's attributes under it as well."""
    stack: list[str] = []
    for m in _XML.finditer(text):
        if m["c"] is not None:
            out.comments.append(m.span("c"))
        elif m["name"]:
            if m["end"]:
                while stack and stack.pop() != m["name"]:
                    pass
                continue
            attrs = list(_ATTR.finditer(text, m.start("attrs"), m.end("attrs")))
            named = next((a[2] or a[3] or "" for a in attrs if a[1].lower() in ("name", "key", "id")), None)
            stack.append(m["name"])
            for a in attrs:
                g = 2 if a[2] is not None else 3
                above = (*stack, named) if named and a[1].lower() in ("value", "default") else tuple(stack)
                out.leaves.append(((*above, a[1]), *a.span(g), "quoted"))
            if m["lone"]:
                stack.pop()
        elif (part := "t" if m["t"] is not None else "cd" if m["cd"] is not None else None) and m[part].strip():
            lead, s = len(m[part]) - len(m[part].lstrip()), m[part].strip()
            out.leaves.append((tuple(stack), m.start(part) + lead, m.start(part) + lead + len(s), "quoted"))


_BY_EXT: dict[str, Callable[[str, Walked], None]] = {
    **dict.fromkeys(("json", "json5", "jsonc"), _json), **dict.fromkeys(("yaml", "yml"), _yaml), "toml": _toml,
    **dict.fromkeys(("env", "ini", "cfg", "conf", "properties"), _pairs), **dict.fromkeys(("xml", "plist"), _xml),
}
FORMATS = frozenset(_BY_EXT)


def walk(text: str, ext: str) -> Walked:
    """The scalars and comments of a text of one of ``FORMATS``, in the order of the text within each."""
    out = Walked()
    _BY_EXT[ext](text, out)
    return out
