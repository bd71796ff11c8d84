"""Statements of a text, cut where the lexer's state and depth allow, and the grammar of each language for them."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator

from lodespark.llm.syntax import script
from lodespark.llm.syntax.chunks import LEXERS, PAIRS, Marks, entry_of, is_whole, prefixes
from lodespark.llm.syntax.yaml_grammar import KEY, check_lines

# Words that go on a statement begun before, and words that begin a declaration.
_PY_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_JS_BEGINS = re.compile(r"(?:function|class|const|let|var|import|export|interface|type|enum|namespace|declare|abstract|async\s+function)\b")


def lines(text: str) -> str:
    """One kind of line end, no byte order mark."""
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


#: Characters of a chunk of a file that is judged where it is read.
PIECE = 1 << 10
_COLUMN_0 = re.compile(r"(?<=\n)(?=[^\s#])")


def chunks_of(lang: str, text: str, size: int = PIECE) -> list[str]:
    """The text, its line ends made one kind, cut after lines; YAML only where a line begins at column 0."""
    text = lines(text)
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            end = len(text)
        elif lang == "yaml":
            m = _COLUMN_0.search(text, end)
            end = m.start() if m else len(text)
        else:
            end = text.find("\n", end) + 1 or len(text)
            while end < len(text) and text[end - 2] == "\\":
                end = text.find("\n", end) + 1 or len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


def starts(lang: str, text: str, state: str, openers: str, marks: Marks | None = None) -> list[int]:
    """Places in a chunk where a statement begins for certain; ``state`` and ``openers`` hold at its start."""
    if marks is None:
        marks = LEXERS[lang][0](text, state)[1]
    depth = len(openers)
    found: list[int] = []
    if lang == "json":
        for at, b in marks:
            depth += (b in "[{") - (b in "]}")
            if b == "," and depth == 1:
                found.append(at + 1)
        return found
    last, begins = "", state.startswith(("code", "block")) and state in ("code", "code/r", "code/d", "block")
    places = [(0, "\n"), *marks] if begins else marks
    decorated = False
    for at, b in places:
        if b in "([{":
            depth += 1
        elif b in PAIRS:
            depth -= 1
        if b != "\n":
            last = b
            continue
        if depth or at >= len(text) or text[at] in " \t\n#\f":
            continue
        if lang == "python":
            if text[at - 2 : at] == "\\\n" or _PY_GOES_ON.match(text, at):
                continue
            if not decorated:
                found.append(at)
            decorated = text[at] == "@"
        elif lang in ("javascript", "typescript"):
            if last == ";" and text[:at].rstrip().endswith(";") or last == "}" and text[:at].rstrip().endswith("}") and _JS_BEGINS.match(text, at):
                found.append(at)
        elif lang != "yaml" or KEY.match(text, at):
            found.append(at)
    return found


def cuts_apart(lang: str, text: str, first: bool) -> bool:
    """Whether statements of this chunk mean the same alone. In YAML they do in one block mapping, not across documents."""
    if lang != "yaml":
        return True
    if first:
        text = re.sub(r"\A(?:[ \t]*(?:#[^\n]*)?\n)*(?:---[ \t]*(?:#[^\n]*)?\n(?:[ \t]*(?:#[^\n]*)?\n)*)?", "", text)
        if not KEY.match(text):
            return False
    return not re.search(r"(?m)^(?:---|\.\.\.)(?:\s|$)", text)


def pieces(lang: str, text: str, state: str, openers: str, marks: Marks | None = None) -> Iterator[tuple[int, str]]:
    """The chunk cut at its starts: (0, what belongs to the statement begun before), then (1, statement) each."""
    at, first = 0, 0
    for s in starts(lang, text, state, openers, marks):
        if s > at or first:
            yield first, text[at:s]
        at, first = s, 1
    yield first, text[at:]


def check_python(stmt: str, first: bool = True, last: bool = True) -> bool:
    """Python 3, by the interpreter's own grammar."""
    try:
        compile(stmt, "stmt", "exec", dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True  # deeper than the interpreter reads; its brackets and strings are whole
    return True


def check_toml(stmt: str, first: bool = True, last: bool = True) -> bool:
    """One or more lines of TOML 1.0."""
    try:
        tomllib.loads(stmt)
    except (ValueError, RecursionError):
        return False
    return True


def _no_constant(name: str) -> None:
    raise ValueError(name)


def json_member(part: str, first: bool, last: bool, bracket: str | None) -> bool:
    """One member of the outermost array or object, with that one's brackets where it is the first or the last."""
    if bracket is None:
        text = part
    else:
        part = part if last else part.rstrip().removesuffix(",")
        text = part if first else bracket + part
        text = text if last else text + {"{": "}", "[": "]"}[bracket]
    try:
        got = json.loads(text, parse_constant=_no_constant)
    except ValueError:
        return False
    except RecursionError:
        return True
    return bracket is None or len(got) == 1 or (first and last)


GRAMMARS: dict[str, Callable[..., bool]] = {
    "python": check_python,
    "toml": check_toml,
    "javascript": lambda s, first=True, last=True: script.check(s, ts=False),
    "typescript": lambda s, first=True, last=True: script.check(s, ts=True),
    "yaml": lambda s, first=True, last=True: check_lines(s),
}


_FUTURE = re.compile(r"from\s+__future__\s+import\b")


def future_order(statements: list[str]) -> tuple[int | None, int | None]:
    """Places of the first statement that is no docstring or __future__ import, and of the last such import; None where there is none."""
    other = future = None
    said = False
    for i, p in enumerate(statements):
        if not (code := _PY_BLANK.sub("", p)):
            continue
        if _FUTURE.match(code):
            future = i
        elif other is None:
            if not said and _is_text(code):
                said = True
            else:
                other = i
    return other, future


_PY_BLANK = re.compile(r"\A(?:[ \t\f]*(?:#[^\n]*)?(?:\n|\Z))+")


def _is_text(code: str) -> bool:
    """Whether a statement is a string and nothing else."""
    if code[:1] not in "\"'rRuUbB":
        return False
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return len(body) == 1 and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)


def check_file(lang: str, text: str, size: int = PIECE) -> bool:
    """A whole file: maps of its chunks, statements cut by what the maps tell, each by the local grammar, and what they say of each other."""
    text = lines(text)
    lexer, states = LEXERS[lang]
    cut = chunks_of(lang, text, size)
    # a file begins in the first state; any later chunk may begin in each
    runs = [{s: lexer(c, s) for s in (states if i else states[:1])} for i, c in enumerate(cut)]
    at, end = prefixes(states[0], ({s: entry_of(*r) for s, r in run.items()} for run in runs))
    whole = is_whole(lang, end)
    check = GRAMMARS.get(lang)
    if lang in ("json", "toml") and not whole:
        return False
    if not whole or lang == "yaml" and not all(cuts_apart(lang, c, i == 0) for i, c in enumerate(cut)):
        return check(text)
    parts: list[str] = []
    for c, run, (state, _, openers, _) in zip(cut, runs, at, strict=True):
        for begins, p in pieces(lang, c, state, openers, run[state][1]):
            if begins or not parts:
                parts.append(p)
            else:
                parts[-1] += p
    if lang == "json":
        lead = text.lstrip(" \t\n\r")[:1]
        return all(json_member(p, i == 0, i == len(parts) - 1, lead if lead in ("{", "[") else None) for i, p in enumerate(parts))
    if lang in ("javascript", "typescript"):
        declared: dict[str, str] = {}
        for p in parts:
            own = script.names(p, lang == "typescript") if p.strip() else {}
            if own is None or script.clash(declared, own):
                return False
            declared |= own
        return True
    if not all(check(p) for p in _with_definitions(lang, parts)):
        return False
    if lang == "python" and "__future__" in text:
        other, future = future_order(parts)
        return other is None or future is None or future < other
    return lang != "toml" or check(text)  # keys defined twice


def _with_definitions(lang: str, parts: list[str]) -> list[str]:
    """A decorator whose definition began in the next chunk is one statement with it."""
    out: list[str] = []
    for p in parts:
        if lang == "python" and out and out[-1].startswith("@") and not _DEFINES.search(out[-1]):
            out[-1] += p
        else:
            out.append(p)
    return out


_DEFINES = re.compile(r"(?m)^(?:async[ \t]+def|def|class)\b")
