"""YAML: a grammar of block structure by lines, with flow collections and scalars within, the same on every worker."""

from __future__ import annotations

import re

_DQ = r'"(?:\\(?:[0abtnvfre "/\\N_LP\n\t]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|[^"\\])*"'
_SQ = r"'(?:''|[^'])*'"
_TOKEN = re.compile(
    rf"""(?P<s>{_DQ}|{_SQ})|(?P<b>[\[\]{{}},])|(?P<prop>[&*][^\s\[\]{{}},]+|!(?:<[^>\s]+>|[^\s\[\]{{}},]*))|(?P<colon>:(?=[\s,\[\]{{}}]|\Z))|(?P<q>\?(?=\s))
    |(?P<plain>(?:[^\s\-?:,\[\]{{}}\#&*!|>'"%@`]|[\-?:](?=[^\s,\[\]{{}}]))(?:[^\s:\#,\[\]{{}}]|:(?=[^\s,\[\]{{}}])|(?<=\S)\#|[ \t]+(?=[^\s\#:,\[\]{{}}]|:[^\s,\[\]{{}}]))*)|(?P<ws>\s+|(?<=\s)\#[^\n]*)""",
    re.X,
)
KEY = re.compile(rf"""(?P<k>{_DQ.replace('[^"\\\\]', '[^"\\\\\\n]')}|'(?:''|[^'\n])*'|(?:[^\s\-?:,\[\]{{}}\#&*!|>'"%@`]|[\-?:](?=\S))(?:[^\s:\#]|:(?=\S)|(?<=\S)\#|[ \t]+(?=[^\s\#:]|:\S))*)[ \t]*:(?=\s|\Z)""")
_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}\#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^\s:\#]|:(?=\S)|(?<=\S)\#|[ \t]+(?=[^\s\#:]|:\S))*[ \t]*(?:[ \t]\#.*)?$")
_PROPS = re.compile(r"(?:(?:&[^\s\[\]{},]+|!(?:<[^>\s]+>|[^\s\[\]{},]*))(?:[ \t]+|$))*")


class _Fault(Exception):
    pass


def check_lines(text: str) -> bool:
    """Block collections by indentation, flow collections by brackets, quoted, plain and block scalars."""
    try:
        _Blocks(text).stream()
    except _Fault:
        return False
    return True


class _Blocks:
    def __init__(self, text: str) -> None:
        if re.search(r"[^\t\n\r\x20-\x7e\x85\u00a0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", text):
            raise _Fault
        self.rows = text.split("\n")
        self.i = 0

    def peek(self) -> tuple[int, str] | None:
        """The next line with content: its indentation and text."""
        while self.i < len(self.rows):
            row = self.rows[self.i]
            body = row.lstrip(" ")
            if body.strip() and not body.lstrip("\t ").startswith("#"):
                return len(row) - len(body), body
            self.i += 1
        return None

    def stream(self) -> None:
        while (at := self.peek()) is not None:
            indent, body = at
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", self.rows[self.i]):
                rest = body[3:].strip()
                self.i += 1
                if rest and not rest.startswith("#"):
                    self.value(rest, -1, -1)
                continue
            if indent == 0 and body.startswith("%"):
                self.i += 1
                continue
            self.node(indent)
            after = self.peek()
            if after is not None and not re.match(r"(?:---|\.\.\.)(?:\s|$)", self.rows[self.i]):
                raise _Fault

    def node(self, indent: int) -> None:
        """A block node whose first line has this indentation."""
        _, body = self.peek() or (0, "")
        if body.startswith("\t"):
            raise _Fault
        if re.match(r"-(?:\s|$)", body):
            self.sequence(indent)
        elif re.match(r"\?(?:\s|$)", body) or KEY.match(body, _PROPS.match(body).end()):
            self.mapping(indent)
        else:
            self.i += 1
            self.value(body, indent - 1, indent)

    def sequence(self, indent: int) -> None:
        while (at := self.peek()) is not None and at[0] == indent and (m := re.match(r"-(?:[ \t]+|$)", at[1])):
            self.entry(indent, m.end(), at[1])
        if (at := self.peek()) is not None and at[0] > indent:
            raise _Fault

    def entry(self, indent: int, skip: int, body: str) -> None:
        rest = body[skip:]
        if not rest or rest.startswith("#"):
            self.i += 1
            if (at := self.peek()) is not None and at[0] > indent:
                self.node(at[0])
            return
        if re.match(r"-(?:\s|$)", rest) or KEY.match(rest, _PROPS.match(rest).end()):
            self.rows[self.i] = " " * (indent + skip) + rest  # a nested collection that begins on this line
            self.node(indent + skip)
            return
        self.i += 1
        self.value(rest, indent, indent + 1)

    def mapping(self, indent: int) -> None:
        asked = False  # a key of its own line, of which the value follows
        while (at := self.peek()) is not None and at[0] == indent:
            body = at[1]
            if m := re.match(r"[?:](?:[ \t]+|$)", body):
                if body[0] == ":" and not asked:
                    raise _Fault
                asked = body[0] == "?"
                self.entry(indent, m.end(), body)
                continue
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", body) and indent == 0:
                return
            m = KEY.match(body, _PROPS.match(body).end())
            if not m:
                raise _Fault
            rest = body[m.end() :].strip()
            self.i += 1
            if not rest or rest.startswith("#"):
                self.below(indent)
            else:
                self.value(rest, indent, indent + 1)
        if (at := self.peek()) is not None and at[0] > indent:
            raise _Fault

    def below(self, indent: int) -> None:
        at = self.peek()
        if at is None:
            return
        if at[0] > indent or at[0] == indent and re.match(r"-(?:\s|$)", at[1]):
            self.node(at[0])

    def value(self, rest: str, parent: int, least: int) -> None:
        """What stands on the line after a key or dash, with the lines it goes on over."""
        rest = rest[_PROPS.match(rest).end() :]
        if not rest or rest.startswith("#"):
            self.below(parent)
            return
        if rest[0] in "|>":
            if not re.fullmatch(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:[ \t]#.*)?", rest):
                raise _Fault
            while self.i < len(self.rows) and (not self.rows[self.i].strip() or len(self.rows[self.i]) - len(self.rows[self.i].lstrip(" ")) > parent):
                self.i += 1
            return
        if rest[0] == "*":
            if not re.fullmatch(r"\*[^\s\[\]{},]+[ \t]*(?:\#.*)?", rest):
                raise _Fault
            return
        if rest[0] in "\"'[{":
            self.bounded(rest, parent)
            return
        if not _PLAIN.fullmatch(rest):
            raise _Fault
        while " #" not in rest and (at := self.peek()) is not None and at[0] > parent and not re.match(r"(?:---|\.\.\.)(?:\s|$)", self.rows[self.i]):
            if not re.fullmatch(r"(?:[^\s:\#]|:(?=\S)|(?<=\S)\#|[ \t]+(?=[^\s\#:]|:\S))+[ \t]*(?:[ \t]\#.*)?", at[1]):
                raise _Fault
            rest = at[1]
            self.i += 1

    def bounded(self, rest: str, parent: int) -> None:
        """A quoted scalar or flow collection, over as many lines as it takes."""
        depth, text = [], rest
        at = 0
        state = "item"
        while True:
            m = _TOKEN.match(text, at)
            if not m:
                if self.i >= len(self.rows) or not re.match(r"[\"']|\s*$", text[at:]):
                    raise _Fault
                more = self.rows[self.i]
                if more.strip() and len(more) - len(more.lstrip(" ")) <= parent and text[at : at + 1] not in ("'", '"'):
                    raise _Fault  # only a quoted scalar may go on anywhere
                text = text[at:] + "\n" + more
                at = 0
                self.i += 1
                continue
            at = m.end()
            if m["b"] and m["b"] in "[{":
                if state == "done":
                    raise _Fault
                depth.append(m["b"])
                state = "item"
            elif m["b"] == ",":
                if not depth or state == "item":
                    raise _Fault
                state = "item"
            elif m["b"]:
                if not depth or depth.pop() != {"]": "[", "}": "{"}[m["b"]]:
                    raise _Fault
                state = "done"
            elif m["colon"]:
                state = "item2"
            elif m["s"] or m["plain"]:
                if state == "done":
                    raise _Fault
                state = "done"
            if not depth and state == "done":
                tail = text[at:].strip()
                if tail and not tail.startswith("#"):
                    raise _Fault
                return
