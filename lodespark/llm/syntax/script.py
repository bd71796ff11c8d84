"""A grammar of ECMAScript and TypeScript statements: does a text of whole statements parse?

One parser serves both languages; what only TypeScript has is behind ``self.ts``. It reads tokens as
the grammar asks for them, so that a slash is a division or begins a pattern by what may stand there,
and template literals nest. Nothing is built: parsing either passes or raises ``Invalid``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import regex as re


class Invalid(Exception):
    """The text is not valid in its language."""


# Fixed values of the language: reserved words, punctuators, operator binding.
RESERVED = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
_PUNCT = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(), key=len, reverse=True)
BINARY = {op: n for n, ops in enumerate(["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"], 1) for op in ops.split()}
ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "accessor", "async"}

_SKIP = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/|<!--[^\n]*)*", re.S)
_TOKEN = re.compile(
    r"""(?P<name>(?:[\p{ID_Start}$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\p{ID_Continue}$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*|0\d+)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\p{ID_Start}$_\d]))
    |(?P<str>"(?:\\(?:\r\n|.)|[^"\\\n\r])*"|'(?:\\(?:\r\n|.)|[^'\\\n\r])*')
    |(?P<tpl>`)
    |(?P<p>"""
    + "|".join(re.escape(p) for p in _PUNCT)
    + ")",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[\p{ID_Continue}$]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")


def pattern_holds(literal: str) -> bool:
    """Whether a pattern between slashes has its groups closed, something before each quantifier, and known flags."""
    body, _, flags = literal[1:].rpartition("/")
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
        return False
    depth = i = 0
    some = False  # whether there is something to repeat
    while i < len(body):
        c = body[i]
        if c == "\\":
            i, some = i + 2, True
            continue
        if c == "[":
            i += 1
            while body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            some = True
        elif c == "(":
            depth, some = depth + 1, False
            if body.startswith("(?", i):
                m = re.match(r"\(\?(?:[:=!]|<[=!]|<[\p{ID_Start}$_][\p{ID_Continue}$]*>|[ims]*(?:-[ims]*)?:)", body[i:])
                if not m:
                    return False
                i += len(m[0]) - 1
        elif c == ")":
            depth, some = depth - 1, True
            if depth < 0:
                return False
        elif c in "*+?":
            if not some:
                return False
            i += body.startswith("?", i + 1)
            some = False
        elif c in "|^":
            some = False
        elif c == "{" and (m := re.match(r"\{\d+(?:,\d*)?\}\??", body[i:])):
            if not some:
                return False
            i, some = i + len(m[0]) - 1, False
        else:
            some = True
        i += 1
    return depth == 0


class Parser:
    """Parses one text. ``kind``, ``text``: the token at hand; ``line``: whether a line ended before it."""

    def __init__(self, src: str, ts: bool) -> None:
        self.src, self.ts = src, ts
        self.end = 0
        self.kind = self.text = ""
        self.line = False
        self.start = 0
        self.in_function = self.in_async = self.in_generator = self.loops = self.switches = 0
        self.no_in = False
        self.labels: list[str] = []
        self.scopes: list[dict[str, str]] = [{}]
        self.ambient = False
        self.next()

    # tokens

    def fail(self, why: str = "") -> None:
        raise Invalid(f"{why or 'unexpected'} at {self.start}: {self.src[self.start : self.start + 20]!r}")

    def next(self) -> None:
        m = _SKIP.match(self.src, self.end)
        at = m.end()
        skipped = m[0]
        self.line = any(c in skipped for c in "\n\r  ")
        self.start = at
        if at >= len(self.src):
            self.kind, self.text, self.end = "eof", "", at
            return
        m = _TOKEN.match(self.src, at)
        if not m or self.src.startswith("/*", at):
            self.fail("no token")
        self.kind, self.text, self.end = m.lastgroup or "", m[0], m.end()
        if self.text == "?." and self.src[self.end : self.end + 1].isdigit():
            self.text, self.end = "?", at + 1
        if self.kind == "str" and _BAD_ESCAPE.search(self.text):
            self.fail("escape")

    def save(self) -> tuple:
        return self.end, self.kind, self.text, self.line, self.start

    def back(self, at: tuple) -> None:
        self.end, self.kind, self.text, self.line, self.start = at

    def attempt(self, f: Callable[[], bool]) -> bool:
        """Whether ``f`` passes and returns true; if not, the place is as before."""
        at, scopes = self.save(), [dict(s) for s in self.scopes[-1:]]
        state = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.no_in, len(self.scopes))
        try:
            if f():
                return True
        except Invalid:
            pass
        self.back(at)
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.no_in, depth = state
        del self.scopes[depth:]
        self.scopes[-1:] = scopes
        return False

    def at(self, *texts: str) -> bool:
        return self.kind in ("p", "name") and self.text in texts

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    def want(self, text: str) -> None:
        if not self.eat(text):
            self.fail(f"{text} expected")

    def want_close_angle(self) -> None:
        if self.kind == "p" and self.text.startswith(">"):
            self.end = self.start + 1
            self.text = ">"
            self.next()
        else:
            self.fail("> expected")

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "eof" or self.line:
            return
        self.fail("; expected")

    def identifier(self) -> str:
        name = self.text
        if self.kind != "name" or name in RESERVED or (name == "await" and self.in_async) or (name == "yield" and self.in_generator):
            self.fail("identifier expected")
        self.next()
        return name

    def declare(self, name: str, how: str) -> None:
        """Lexical names of one scope are distinct; variables and functions may repeat."""
        if self.ts or self.ambient:
            return
        scope = self.scopes[-1]
        old = scope.get(name)
        if old and "let" in (old, how):
            self.fail(f"{name} is declared twice")
        scope[name] = how

    # programs and statements

    def program(self) -> None:
        if self.src.startswith("#!"):
            self.end = (self.src + "\n").index("\n")
            self.next()
        while self.kind != "eof":
            self.statement(top=True)

    def block(self, scope: bool = True) -> None:
        self.want("{")
        if scope:
            self.scopes.append({})
        while not self.at("}"):
            if self.kind == "eof":
                self.fail("} expected")
            self.statement()
        if scope:
            self.scopes.pop()
        self.next()

    def statement(self, top: bool = False) -> None:
        t = self.text
        if self.kind == "p":
            if t == "{":
                self.block()
                return
            if t == ";":
                self.next()
                return
            if t == "@":
                self.decorators()
                if not self.at("class", "export", "abstract"):
                    self.fail("class expected")
                self.statement(top)
                return
        elif self.kind == "name":
            f = getattr(self, f"s_{t}", None)
            if f and t in ("var", "const", "if", "for", "while", "do", "return", "break", "continue", "throw", "try", "switch", "function", "class", "debugger", "with"):
                f()
                return
            if t == "let" and self.ahead_is_binding():
                self.s_var()
                return
            if t == "async" and self.ahead(lambda: self.at("function") and not self.line):
                self.next()
                self.function(statement=True, is_async=True)
                return
            if t == "import" and not self.ahead(lambda: self.at("(", ".")):
                if not top:
                    self.fail("import within a block")
                self.s_import()
                return
            if t == "export":
                if not top:
                    self.fail("export within a block")
                self.s_export()
                return
            if self.ts and self.ts_statement(top):
                return
            if t not in RESERVED and self.ahead(lambda: self.at(":")):
                self.labels.append(t)
                self.next()
                self.next()
                self.statement()
                self.labels.pop()
                return
        self.expression()
        self.semicolon()

    def ahead(self, test: Callable[[], bool]) -> bool:
        at = self.save()
        try:
            self.next()
            return test()
        except Invalid:
            return False
        finally:
            self.back(at)

    def ahead_is_binding(self) -> bool:
        return self.ahead(lambda: self.at("[", "{") or self.kind == "name" and (self.text not in RESERVED) and not self.at("in", "instanceof", "of"))

    def s_debugger(self) -> None:
        self.next()
        self.semicolon()

    def s_with(self) -> None:
        self.next()
        self.parenthesised()
        self.statement()

    def s_var(self, loop: bool = False) -> bool:
        """A declaration; returns whether it stands before ``of`` or ``in`` of a loop."""
        how = self.text
        self.next()
        if self.ts and how == "const" and self.at("enum"):
            self.ts_enum()
            return False
        first = True
        while True:
            pattern = self.at("[", "{")
            for name in self.binding():
                if how != "var" and name == "let":
                    self.fail("let as a name")
                self.declare(name, "var" if how == "var" else "let")
            if self.ts:
                self.eat("!")
                self.type_annotation()
            if loop and first and self.at("of", "in"):
                return True
            if self.eat("="):
                old, self.no_in = self.no_in, loop
                self.assignment()
                self.no_in = old
            elif (pattern or how == "const") and not self.ambient:
                self.fail("= expected")
            first = False
            if not self.eat(","):
                break
        if not loop:
            self.semicolon()
        return False

    s_const = s_var

    def binding(self) -> list[str]:
        names: list[str] = []
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                names += self.binding()
                self.default()
                if not self.at("]"):
                    self.want(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    names.append(self.identifier())
                else:
                    plain, name = self.kind == "name" and self.text not in RESERVED, self.text
                    self.property_name()
                    if self.eat(":"):
                        names += self.binding()
                    elif plain:
                        names.append(name)
                    else:
                        self.fail(": expected")
                    self.default()
                if not self.at("}"):
                    self.want(",")
        else:
            names.append(self.identifier())
        return names

    def default(self) -> None:
        if self.eat("="):
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old

    def parenthesised(self) -> None:
        self.want("(")
        self.expression()
        self.want(")")

    def s_if(self) -> None:
        self.next()
        self.parenthesised()
        self.body()
        if self.eat("else"):
            self.body()

    def body(self) -> None:
        """A statement that is no lexical declaration."""
        if self.at("const", "class") or self.at("let") and self.ahead(lambda: self.at("[")):
            self.fail("declaration without block")
        self.statement()

    def loop_body(self) -> None:
        self.loops += 1
        self.body()
        self.loops -= 1

    def s_for(self) -> None:
        self.next()
        if self.at("await"):
            self.next()
        self.want("(")
        self.scopes.append({})
        done = False
        if self.at("var", "const") or self.at("let") and self.ahead_is_binding():
            done = self.s_var(loop=True)
        elif not self.at(";"):
            old, self.no_in = self.no_in, True
            self.expression()
            self.no_in = old
            done = self.at("of", "in")
        if done:
            of = self.text == "of"
            self.next()
            self.assignment() if of else self.expression()
        else:
            self.want(";")
            if not self.at(";"):
                self.expression()
            self.want(";")
            if not self.at(")"):
                self.expression()
        self.want(")")
        self.loop_body()
        self.scopes.pop()

    def s_while(self) -> None:
        self.next()
        self.parenthesised()
        self.loop_body()

    def s_do(self) -> None:
        self.next()
        self.loop_body()
        self.want("while")
        self.parenthesised()
        self.eat(";")

    def s_return(self) -> None:
        if not self.in_function:
            self.fail("return outside a function")
        self.next()
        if not (self.at(";", "}") or self.kind == "eof" or self.line):
            self.expression()
        self.semicolon()

    def s_break(self) -> None:
        stays = self.text == "continue"
        self.next()
        if self.kind == "name" and self.text not in RESERVED and not self.line:
            if self.identifier() not in self.labels:
                self.fail("no such label")
        elif not self.loops and (stays or not self.switches):
            self.fail("outside a loop")
        self.semicolon()

    s_continue = s_break

    def s_throw(self) -> None:
        self.next()
        if self.line:
            self.fail("line ends after throw")
        self.expression()
        self.semicolon()

    def s_try(self) -> None:
        self.next()
        self.block()
        ended = False
        if self.eat("catch"):
            ended = True
            self.scopes.append({})
            if self.eat("("):
                self.binding()
                if self.ts:
                    self.type_annotation()
                self.want(")")
            self.block()
            self.scopes.pop()
        if self.eat("finally"):
            ended = True
            self.block()
        if not ended:
            self.fail("catch or finally expected")

    def s_switch(self) -> None:
        self.next()
        self.parenthesised()
        self.want("{")
        self.switches += 1
        self.scopes.append({})
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            elif self.at("default") and not default:
                default = True
                self.next()
            else:
                self.fail("case expected")
            self.want(":")
            while not self.at("case", "default", "}"):
                if self.kind == "eof":
                    self.fail("} expected")
                self.statement()
        self.scopes.pop()
        self.switches -= 1

    def s_function(self) -> None:
        self.function(statement=True)

    def s_class(self) -> None:
        self.klass(statement=True)

    def module_name(self) -> None:
        if self.kind not in ("name", "str"):
            self.fail("name expected")
        self.next()

    def from_module(self) -> None:
        self.want("from")
        if self.kind != "str":
            self.fail("module expected")
        self.next()
        if self.at("with", "assert") and not self.line:
            self.next()
            self.primary()

    def specifiers(self) -> None:
        self.want("{")
        while not self.eat("}"):
            if self.ts and self.at("type") and self.ahead(lambda: self.kind == "name" and not self.at("as")):
                self.next()
            self.module_name()
            if self.eat("as"):
                self.module_name()
            if not self.at("}"):
                self.want(",")

    def s_import(self) -> None:
        self.next()
        if self.kind == "str":
            self.next()
            self.semicolon()
            return
        if self.ts and self.at("type") and self.ahead(lambda: self.at("{", "*") or self.kind == "name" and not self.at("from")):
            self.next()
        if self.kind == "name":
            self.declare(self.identifier(), "let")
            if self.ts and self.eat("="):
                self.expression()
                self.semicolon()
                return
            if not self.eat(","):
                self.from_module()
                self.semicolon()
                return
        if self.eat("*"):
            self.want("as")
            self.identifier()
        else:
            self.specifiers()
        self.from_module()
        self.semicolon()

    def s_export(self) -> None:
        self.next()
        if self.eat("default"):
            if self.at("function"):
                self.function(statement=False)
            elif self.at("async") and self.ahead(lambda: self.at("function") and not self.line):
                self.next()
                self.function(statement=False, is_async=True)
            elif self.at("class", "@") or self.ts and self.at("abstract"):
                if self.at("@"):
                    self.decorators()
                self.eat("abstract")
                self.klass(statement=False)
            elif self.ts and self.at("interface"):
                self.ts_statement(True)
            else:
                self.assignment()
                self.semicolon()
        elif self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.from_module()
            self.semicolon()
        elif self.at("{") or self.ts and self.at("type") and self.ahead(lambda: self.at("{", "*")):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.module_name()
                self.from_module()
            else:
                self.specifiers()
                if self.at("from"):
                    self.from_module()
            self.semicolon()
        elif self.ts and self.eat("="):
            self.expression()
            self.semicolon()
        elif self.ts and self.eat("as"):
            self.want("namespace")
            self.identifier()
            self.semicolon()
        elif self.at("var", "let", "const", "function", "class", "async", "@", "import") or self.ts and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract"):
            self.statement(top=True)
        else:
            self.fail("declaration expected")

    # functions and classes

    def function(self, statement: bool, is_async: bool = False) -> None:
        self.want("function")
        generator = self.eat("*")
        if statement or self.kind == "name":
            name = self.text
            if self.kind != "name" or name in RESERVED:
                self.fail("name expected")
            self.next()
            if statement:
                self.declare(name, "function")
        self.callable(is_async, generator, bodiless=self.ts and statement)

    def callable(self, is_async: bool = False, generator: bool = False, bodiless: bool = False) -> None:
        """Parameters, return type and body."""
        if self.ts:
            self.type_parameters()
        old = self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in = 1, int(is_async), int(generator), 0, 0, [], False
        self.scopes.append({})
        self.parameters()
        if self.ts and self.eat(":"):
            self.type_(returns=True)
        if bodiless and not self.at("{"):
            self.semicolon()
        else:
            self.block(scope=False)
        self.scopes.pop()
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_in = old

    def parameters(self) -> None:
        self.want("(")
        while not self.eat(")"):
            if self.at("@"):
                self.decorators()
            if self.ts:
                while self.at("public", "private", "protected", "readonly", "override") and self.ahead(lambda: self.kind == "name" or self.at("{", "[")):
                    self.next()
            rest = self.eat("...")
            if self.ts and self.at("this"):
                self.next()
            else:
                for n in self.binding():
                    self.scopes[-1][n] = "var"
            if self.ts:
                self.eat("?")
                self.type_annotation()
            if not rest:
                self.default()
            if not self.at(")"):
                if rest:
                    self.fail("rest parameter is not the last")
                self.want(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.parenthesised()
            else:
                self.identifier()
                while self.eat("."):
                    self.module_name()
                if self.ts and self.at("<"):
                    self.attempt(lambda: self.type_arguments())
                if self.at("("):
                    self.arguments()

    def klass(self, statement: bool) -> None:
        self.want("class")
        if statement or self.kind == "name" and not self.at("extends", "implements"):
            name = self.identifier()
            if statement:
                self.declare(name, "let")
        if self.ts:
            self.type_parameters()
        if self.eat("extends"):
            self.left_hand()
            if self.ts and self.at("<"):
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.want("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        if self.at("@"):
            self.decorators()
        more = MODIFIERS if self.ts else {"static", "async", "accessor"}
        is_async = False
        while self.kind == "name" and self.text in more and self.ahead(lambda: self.kind in ("name", "str", "num") and not self.line or self.at("[", "#", "*", "{") and not self.line):
            if self.at("static") and self.ahead(lambda: self.at("{")):
                self.next()
                old = self.in_function
                self.in_function = 0
                self.block()
                self.in_function = old
                return
            is_async |= self.text == "async"
            self.next()
        generator = self.eat("*")
        if self.ts and self.at("[") and self.attempt(self.index_signature):
            self.semicolon()
            return
        if self.at("get", "set") and self.ahead(lambda: self.kind in ("name", "str", "num") or self.at("[", "#")):
            self.next()
        self.property_name(private=True)
        if self.ts and not self.eat("?"):
            self.eat("!")
        if self.at("(", "<"):
            self.callable(is_async, generator, bodiless=self.ts)
            return
        if generator:
            self.fail("( expected")
        if self.ts:
            self.type_annotation()
        if self.eat("="):
            old = self.in_function, self.in_async
            self.in_function, self.in_async = 0, 0
            self.assignment()
            self.in_function, self.in_async = old
        self.semicolon()

    def property_name(self, private: bool = False) -> None:
        if self.eat("["):
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.want("]")
        elif private and self.eat("#"):
            self.module_name()
        elif self.kind in ("name", "str", "num"):
            self.next()
        else:
            self.fail("property expected")

    # expressions; each returns whether it can be assigned to

    def expression(self) -> bool:
        target = self.assignment()
        while self.eat(","):
            self.assignment()
            target = False
        return target

    def assignment(self) -> bool:
        if self.at("yield") and self.in_generator:
            self.next()
            if not self.line:
                if self.eat("*"):
                    self.assignment()
                elif not (self.at(")", "]", "}", ",", ";", ":", "in", "of") or self.kind == "eof"):
                    self.assignment()
            return False
        if self.arrow():
            return False
        at = self.save()
        target = self.conditional()
        if self.kind == "p" and self.text in ASSIGN:
            simple = self.text != "="
            if not target or simple and self.src[at[4]] in "[{" and self.src[self.start - 1 : self.start] != ")" and target == "pattern":
                self.fail("can't be assigned to")
            self.next()
            self.assignment()
            return False
        return bool(target)

    def arrow(self) -> bool:
        """Parses an arrow function if one begins here."""
        if self.kind == "name" and self.text not in RESERVED:
            if self.text == "async" and self.ahead(lambda: not self.line and (self.at("(", "<") or self.kind == "name" and self.text not in RESERVED)):
                return self.attempt(lambda: self.arrow_head(True)) and self.arrow_body(True)
            if self.ahead(lambda: self.at("=>") and not self.line):
                self.identifier()
                self.next()
                return self.arrow_body(False)
            return False
        if self.at("(") or self.ts and self.at("<"):
            return self.attempt(lambda: self.arrow_head(False)) and self.arrow_body(False)
        return False

    def arrow_head(self, is_async: bool) -> bool:
        if is_async:
            self.next()
        if is_async and self.kind == "name":
            self.identifier()
        else:
            if self.ts:
                self.type_parameters()
            self.scopes.append({})
            self.parameters()
            self.scopes.pop()
            if self.ts and self.eat(":"):
                self.type_(returns=True)
        return not self.line and self.eat("=>")

    def arrow_body(self, is_async: bool) -> bool:
        old = self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels
        self.in_async, self.in_generator = int(is_async), 0
        if self.at("{"):
            self.in_function, self.loops, self.switches, self.labels = 1, 0, 0, []
            no_in, self.no_in = self.no_in, False
            self.block()
            self.no_in = no_in
        else:
            self.assignment()
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels = old
        return True

    def conditional(self) -> bool | str:
        target = self.binary(0)
        if self.eat("?"):
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.want(":")
            self.assignment()
            return False
        return target

    def binary(self, least: int) -> bool | str:
        private = self.at("#") and self.ahead(lambda: self.kind == "name")
        if private:
            self.next()
            self.next()
            if not self.at("in"):
                self.fail("in expected")
        target: bool | str = False if private else self.unary()
        while True:
            if self.ts and self.at("as", "satisfies") and not self.line:
                self.next()
                if not self.eat("const"):
                    self.type_()
                continue
            n = BINARY.get(self.text, 0) if self.kind in ("p", "name") else 0
            if not n or n <= least or self.text == "in" and self.no_in:
                return target
            power = self.text == "**"
            self.next()
            self.binary(n - 1 if power else n)
            target = False

    def unary(self) -> bool | str:
        if self.at("!", "~", "+", "-", "typeof", "void", "delete") or self.at("await") and (self.in_async or not self.in_function):
            if self.at("await") and not self.in_async and self.ahead(lambda: self.at(")", ";", ",", ".", "=", "]", "}") or self.kind == "eof"):
                return self.postfix()
            self.next()
            self.unary()
            if self.at("**"):
                self.fail("brackets are needed before **")
            return False
        if self.at("++", "--"):
            self.next()
            if not self.unary():
                self.fail("can't be changed")
            return False
        if self.ts and self.at("<"):
            self.next()
            if not self.eat("const"):
                self.type_()
            self.want_close_angle()
            self.unary()
            return False
        return self.postfix()

    def postfix(self) -> bool | str:
        target = self.left_hand()
        if self.at("++", "--") and not self.line:
            if not target:
                self.fail("can't be changed")
            self.next()
            return False
        return target

    def left_hand(self) -> bool | str:
        if self.at("new"):
            target = self.new()
        else:
            target = self.primary()
        return self.chain(target, calls=True)

    def new(self) -> bool:
        self.want("new")
        if self.eat("."):
            self.want("target")
            return False
        if self.at("new"):
            self.new()
        else:
            self.primary()
        self.chain(False, calls=False)
        if self.ts and self.at("<"):
            self.attempt(lambda: self.type_arguments() and self.at("("))
        if self.at("("):
            self.arguments()
        return False

    def chain(self, target: bool | str, calls: bool) -> bool | str:
        while True:
            if self.at("."):
                self.next()
                self.eat("#")
                self.module_name() if self.kind == "name" else self.fail("name expected")
                target = True
            elif self.at("?."):
                if not calls:
                    self.fail("?. after new")
                self.next()
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.full_expression("]")
                elif self.kind == "tpl":
                    self.fail("template after ?.")
                else:
                    self.eat("#")
                    if self.kind != "name":
                        self.fail("name expected")
                    self.next()
                target = False
            elif self.at("["):
                self.next()
                self.full_expression("]")
                target = True
            elif self.at("(") and calls:
                self.arguments()
                target = False
            elif self.kind == "tpl":
                self.template()
                target = False
            elif self.ts and self.at("!") and not self.line:
                self.next()
            elif self.ts and calls and self.at("<", "<<") and self.attempt(lambda: self.type_arguments() and (self.at("(") or self.kind == "tpl" or self.line or self.at(")", "]", ",", ";", ":", "}", "?.", "==", "===", "."))):
                target = False
            else:
                return target

    def full_expression(self, close: str) -> None:
        old, self.no_in = self.no_in, False
        self.expression()
        self.no_in = old
        self.want(close)

    def arguments(self) -> None:
        self.want("(")
        old, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.want(",")
        self.no_in = old

    def template(self) -> None:
        while True:
            self.end = _TEMPLATE.match(self.src, self.end).end()
            if self.src.startswith("`", self.end):
                self.end += 1
                self.next()
                return
            if not self.src.startswith("${", self.end):
                self.fail("template has no end")
            self.end += 2
            self.next()
            old, self.no_in = self.no_in, False
            self.expression()
            self.no_in = old
            if not self.at("}"):
                self.fail("} expected")

    def primary(self) -> bool | str:
        k, t = self.kind, self.text
        if k in ("num", "str"):
            self.next()
            return False
        if k == "tpl":
            self.template()
            return False
        if k == "name":
            if t in ("this", "null", "true", "false"):
                self.next()
                return False
            if t == "super":
                self.next()
                if not self.at("(", ".", "["):
                    self.fail("super alone")
                return False
            if t == "function":
                self.function(statement=False)
                return False
            if t == "class":
                self.klass(statement=False)
                return False
            if t == "async" and self.ahead(lambda: self.at("function") and not self.line):
                self.next()
                self.function(statement=False, is_async=True)
                return False
            if t == "import":
                self.next()
                if self.eat("."):
                    self.want("meta")
                elif self.at("("):
                    self.arguments()
                else:
                    self.fail()
                return False
            self.identifier()
            return True
        if t == "(":
            self.next()
            old, self.no_in = self.no_in, False
            target = self.expression()
            self.no_in = old
            self.want(")")
            return target
        if t == "[":
            self.next()
            old, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.at("]"):
                    self.want(",")
            self.no_in = old
            return "pattern"
        if t == "{":
            self.object()
            return "pattern"
        if t in ("/", "/="):
            m = _REGEX.match(self.src, self.start)
            if not m or not pattern_holds(m[0]):
                self.fail("pattern")
            self.end = m.end()
            self.next()
            return False
        if t == "@":
            self.decorators()
            self.klass(statement=False)
            return False
        self.fail()
        return False

    def object(self) -> None:
        self.want("{")
        old, self.no_in = self.no_in, False
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                starts = lambda: self.kind in ("name", "str", "num") or self.at("[", "*")
                is_async = self.at("async") and self.ahead(lambda: starts() and not self.line)
                if is_async:
                    self.next()
                generator = self.eat("*")
                if self.at("get", "set") and self.ahead(lambda: self.kind in ("name", "str", "num") or self.at("[")):
                    self.next()
                    self.property_name()
                    self.callable()
                else:
                    short = self.kind == "name" and self.text not in RESERVED
                    self.property_name()
                    if self.at("(") or self.ts and self.at("<"):
                        self.callable(is_async, generator)
                    elif is_async or generator:
                        self.fail("( expected")
                    elif self.eat(":"):
                        self.assignment()
                    elif not short:
                        self.fail(": expected")
                    elif self.eat("="):  # only as an assignment's pattern
                        self.assignment()
            if not self.at("}"):
                self.want(",")
        self.no_in = old

    # TypeScript

    def ts_statement(self, top: bool) -> bool:
        """Parses a statement that only TypeScript has, if one begins here."""
        t = self.text
        if t == "interface" and self.ahead(lambda: self.kind == "name" and not self.line):
            self.next()
            self.identifier()
            self.type_parameters()
            if self.eat("extends"):
                self.type_()
                while self.eat(","):
                    self.type_()
            self.type_members()
        elif t == "type" and self.ahead(lambda: self.kind == "name" and not self.line):
            self.next()
            self.identifier()
            self.type_parameters()
            self.want("=")
            self.type_()
            self.semicolon()
        elif t == "enum":
            self.ts_enum()
        elif t in ("namespace", "module", "global") and self.ahead(lambda: (self.kind in ("name", "str") or self.at("{") and t == "global") and not self.line):
            self.next()
            if self.kind == "str":
                self.next()
            elif not self.at("{"):
                self.identifier()
                while self.eat("."):
                    self.identifier()
            if self.at("{"):
                self.next()
                while not self.eat("}"):
                    if self.kind == "eof":
                        self.fail("} expected")
                    self.statement(top=True)
            else:
                self.semicolon()
        elif t == "declare" and self.ahead(lambda: self.kind == "name" and not self.line):
            self.next()
            old, self.ambient = self.ambient, True
            self.statement(top=True)
            self.ambient = old
        elif t == "abstract" and self.ahead(lambda: self.at("class") and not self.line):
            self.next()
            self.klass(statement=True)
        else:
            return False
        return True

    def ts_enum(self) -> None:
        self.want("enum")
        self.identifier()
        self.want("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.want(",")

    def type_annotation(self) -> None:
        if self.eat(":"):
            self.type_()

    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        while True:
            while self.at("const", "in", "out") and self.ahead(lambda: self.kind == "name" and not self.at("extends")):
                self.next()
            self.identifier()
            if self.eat("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if not self.eat(",") or self.kind == "p" and self.text.startswith(">"):
                break
        self.want_close_angle()

    def type_arguments(self) -> bool:
        if self.text == "<<":
            self.text, self.end = "<", self.start + 1
        self.want("<")
        self.type_()
        while self.eat(","):
            self.type_()
        self.want_close_angle()
        return True

    def type_(self, returns: bool = False) -> None:
        if returns:
            if self.at("asserts") and self.ahead(lambda: self.kind == "name" and not self.line and not self.at("is")):
                self.next()
            if self.kind == "name" and self.ahead(lambda: self.at("is") and not self.line):
                self.next()
                self.next()
        if self.at("abstract") and self.ahead(lambda: self.at("new")):
            self.next()
        if self.at("new") or self.at("<") or self.at("(") and self.attempt(self.function_type_head):
            if self.at("new", "<"):
                self.eat("new")
                self.type_parameters()
                self.function_type_head()
            self.type_(returns=True)
            return
        self.union()
        if self.at("extends") and not self.line:
            self.next()
            self.union()
            self.want("?")
            self.type_()
            self.want(":")
            self.type_()

    def function_type_head(self) -> bool:
        self.scopes.append({})
        self.parameters()
        self.scopes.pop()
        self.want("=>")
        return True

    def union(self) -> None:
        if self.at("|", "&"):
            self.next()
        self.type_operand()
        while self.at("|", "&"):
            self.next()
            if self.at("(") and self.attempt(self.function_type_head):
                self.type_(returns=True)
            else:
                self.type_operand()

    def type_operand(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and self.ahead(lambda: self.kind in ("name", "str") or self.at("(", "[", "{")):
            infer = self.at("infer")
            self.next()
            if infer:
                self.identifier()
                if self.at("extends"):
                    self.attempt(lambda: self.eat("extends") and (self.union(), not self.at("?"))[1])
                return
        k, t = self.kind, self.text
        if k in ("num", "str"):
            self.next()
        elif k == "tpl":
            while True:
                self.end = _TEMPLATE.match(self.src, self.end).end()
                if self.src.startswith("`", self.end):
                    self.end += 1
                    self.next()
                    break
                if not self.src.startswith("${", self.end):
                    self.fail("template has no end")
                self.end += 2
                self.next()
                self.type_()
                if not self.at("}"):
                    self.fail("} expected")
        elif t == "-" and k == "p":
            self.next()
            if self.kind != "num":
                self.fail("number expected")
            self.next()
        elif t == "(":
            self.next()
            self.type_()
            self.want(")")
        elif t == "[":
            self.next()
            while not self.eat("]"):
                self.eat("...")
                if self.kind == "name" and self.ahead(lambda: self.at(":") or self.at("?")) and self.attempt(lambda: (self.next(), self.eat("?"), self.eat(":"))[2]):
                    pass
                self.type_()
                self.eat("?")
                if not self.at("]"):
                    self.want(",")
        elif t == "{":
            if not self.attempt(self.mapped_type):
                self.type_members()
        elif t == "typeof":
            self.next()
            if self.at("import"):
                self.next()
                self.arguments()
            else:
                self.module_name()
            while self.eat("."):
                self.module_name()
            if self.at("<") and not self.line:
                self.type_arguments()
        elif t == "import":
            self.next()
            self.arguments()
            while self.eat("."):
                self.module_name()
            if self.at("<"):
                self.type_arguments()
        elif k == "name" and (t not in RESERVED or t in ("void", "null", "this", "true", "false")):
            self.next()
            while self.eat("."):
                self.module_name()
            if self.at("<", "<<") and not self.line:
                self.type_arguments()
        else:
            self.fail("type expected")
        while self.at("[") and not self.line:
            self.next()
            if not self.at("]"):
                self.type_()
            self.want("]")

    def mapped_type(self) -> bool:
        self.want("{")
        if self.at("+", "-"):
            self.next()
        self.eat("readonly")
        self.want("[")
        self.identifier()
        self.want("in")
        self.type_()
        if self.eat("as"):
            self.type_()
        self.want("]")
        if self.at("+", "-"):
            self.next()
        self.eat("?")
        self.type_annotation()
        self.eat(";")
        self.want("}")
        return True

    def index_signature(self) -> bool:
        self.want("[")
        self.identifier()
        self.want(":")
        self.type_()
        self.want("]")
        self.want(":")
        self.type_()
        return True

    def type_members(self) -> None:
        self.want("{")
        while not self.eat("}"):
            if self.kind == "eof":
                self.fail("} expected")
            while self.at("readonly", "get", "set", "static", "new") and self.ahead(lambda: self.kind in ("name", "str", "num") or self.at("[", "(")) and not self.ahead(lambda: self.at("(") and False):
                if self.at("get", "set", "readonly", "static") and self.ahead(lambda: self.at("(")):
                    break
                self.next()
            if self.at("[") and self.attempt(self.index_signature):
                pass
            else:
                if not self.at("(", "<"):
                    self.property_name()
                    self.eat("?")
                if self.at("(", "<"):
                    self.type_parameters()
                    self.scopes.append({})
                    self.parameters()
                    self.scopes.pop()
                    if self.eat(":"):
                        self.type_(returns=True)
                else:
                    self.type_annotation()
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.line):
                self.fail("; expected")


def names(text: str, ts: bool) -> dict[str, str] | None:
    """What a sequence of whole statements declares at its top; None if it is not valid ECMAScript (or TypeScript)."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        parser = Parser(text, ts)
        parser.program()
        return parser.scopes[0]
    except (Invalid, RecursionError):
        return None
    finally:
        sys.setrecursionlimit(limit)


def check(text: str, ts: bool) -> bool:
    """Whether the text, a sequence of whole statements, is valid."""
    return names(text, ts) is not None


def clash(a: dict[str, str], b: dict[str, str]) -> bool:
    """Whether a name that one declares lexically is declared by the other too."""
    return any("let" in (how, a[n]) for n, how in b.items() if n in a)
