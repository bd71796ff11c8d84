"""Credentials in source and configuration text: where their values stand, and the text without them.

A configuration (JSON, YAML, TOML, XML, key-value lines; also one that does not parse, or a diff of one)
is read into key paths with the offsets of their values, see ``config``. A value is a credential if its
key path names one and it has the shape of one, or if its own text shows one (keys of known issuers,
signed tokens, a password within a URL or connection string, an authorization scheme with its token, a
private key). Code, prose, comments and text within values have no key paths; there names and shapes
are found by patterns of assignments, command lines, headers and remarks. References to an environment
or vault, placeholders, hashes, ids and public keys are none. Redaction writes over the characters of
values only, one for one, so all else stays where it was and still parses.

A diff is read with the first column of its lines set aside.
"""

from __future__ import annotations

import re as plain_re  # faster than regex on plain runs
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.joins import spread
from lodespark.llm.config import FORMATS, walk

#: Extensions in which a value may stand without quotes.
BARE_FORMATS = {"yaml", "yml", "env", "ini", "cfg", "conf", "properties", "sh", "md", "txt", ""}
FIELDS = ("old_content", "new_content", "diff")

# Words that end a credential's name, and what must precede "key".
_ENDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "secrets", "token", "credential", "credentials", "apikey", "authtoken", "accesskey", "secretkey", "privatekey"}
_KEY_KINDS = {"api", "access", "secret", "signing", "private", "webhook", "encryption", "auth", "account", "master", "deploy", "service", "admin", "app", "application", "license", "ssh", "hmac", "jwt", "session", "storage", "subscription", "client", "server", "shared"}
_TAILS = {"set", "args", "arg", "value", "default", "current", "old", "new", "prod", "dev", "live", "text", "string", "plain", "b64", "base64"}
_NOTES = {"rotate", "rotated", "revoke", "revoked", "leaked", "expired", "stale", "old", "previous"}
_GENERIC = {"value", "default", "val", "data", "content", "literal", "current"}

#: Names whose value may be words; literals that tell how a password is got; and words of a sentence about passwords.
_PHRASES = {"password", "passwd", "pwd", "passphrase", "passcode"}
_NAME_LIKE = re.compile(r"[a-z]+(?:[_\-./][a-z]+)+|[A-Z]+(?:_[A-Z0-9]+)+|(?i:prompt|ask|input|interactive|hidden|masked|disabled|enabled|auto|generated?|random|default|plain(?:text)?|basic|file|hashed|encrypted|keychain|yes|no|on|off|text|field|hint)")
_SENTENCE = re.compile(r"(?i)\b(?:must|should|may|can(?:not)?|have|has|is|are|be|the|an?|your|this|that|for|to|from|of|in|with|at|by|or|and|not|no|please|enter|characters?|password|passphrase|required|wrong|invalid|incorrect|expired|missing)\b")
#: Words of which every credential's name has one; names that a name above them must explain, and notes of old ones in comments.
_TRIGGERS = ("pass", "pwd", "secret", "token", "cred", "key")
_MORE = ("value", "default", "val", "data", "content", "literal", "current", "rotate", "revoke", "leaked", "expired", "stale", "old", "previous")

_PLACEHOLDER = re.compile(
    r"""(?ix)
    (.)\1*                                                    # one character over and over
    | [x*.\-_#•?]+
    | (?:.*[^a-z])?(?:change[-_ ]?me|replace[-_ ]?me|placeholder|redacted|example|dummy|fix[-_ ]?me|not[-_ ]?set)(?:[^a-z].*)?
    | (?:.*[^a-z])?(?:your|insert)[-_ ].* | .*EXAMPLE(?:KEY)?.* | <[^>]*> | .*\.\.\.
    | none | null | nil | true | false | undefined | password | secret | token | test | string | str | optional | required | unset | empty
    | \$[A-Za-z_]*\b_?[A-Z_]{2,} | \$\(.* | %\(\w+\)s | %[A-Za-z_]+% | \{\{.* | \{[\w.]*\} | .*\$\{[^}]*\}.* | .*\{\{[^}]*\}\}.*
    | (?:vault|env|ssm|secretsmanager|keyring|file|ref|op|gcp|aws|arn|azure|sops|enc)(?:[:\[(]|://).*
    | !(?:vault|secret|env|ref|sub|getatt|include|encrypted)\b.* | (?:process\.env|os\.environ|os\.getenv|config|settings|secrets|env|self|args|opts)[.\[(].*
    | (?:sha|md)\d+[:\-].* | (?:urn|mailto):.*
    """
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_NAME = r"[A-Za-z_$][\w$.\-]*"
_STRING = r"""(?P<q>\"\"\"|'''|["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n])*?)(?P=q)"""
_WRAP = r"""(?:(?:[\w.]*(?:environ\.get|getenv|env\.get|config\.get|\benv))\(\s*["'][\w.\-]+["']\s*,\s*|[\w.]*\benv(?:iron)?(?:\.\w+|\[["']\w+["']\])\s*(?:\|\||\?\?|\bor\b)\s*|\(\s*|\{\s*["']?(?P<sub>value|default|val|literal)["']?\s*[:=]\s*)?"""
_ASSIGN = re.compile(rf"""(?P<k>{_NAME})["'`]?\]?(?:\s*:\s*[A-Za-z_][\w\[\]|,. <>]*?)?\s*(?:=>|:=|=|:)\s*{_WRAP}[rRbBuUfF]{{0,2}}{_STRING}""")
_KEY = re.compile(rf"""(?<![\w$.\-]){_NAME}(?=["'`]?\]?\s*[:=])""")
_DEFAULT = re.compile(rf"""(?:environ\.get|getenv)\(\s*["'](?P<k>[\w.\-]+)["']\s*,\s*{_STRING}""")
_PARTS = re.compile(r"""\s*[+\\]?\s*["'](?P<v>(?:\\.|[^"'\\\n])*)["']""")
_BARE = re.compile(
    r"""(?mx)^(?P<pre>[ \t]*(?P<mark>\#+|//+|;|/?\*+|<!--|--)?[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+)?)
    (?P<k>["']?[A-Za-z_][\w.\-]*["']?)[ \t]*(?:=|:(?=[ \t]))[ \t]*(?P<v>[^\s"'`\[\](){}|>&][^\s"'`]*)[ \t]*(?:\*/.*|-->.*|[ \t]\#.*)?\r?$"""
)
_SAID = re.compile(r"(?i)\b(?:old|former|previous|last|temporary|current)\s+(?P<k>[a-z]+(?:[ _-][a-z]+){0,2})\s+(?:was|is|were)\s+[\"'`]?(?P<v>[^\s\"'`]+)")
_FLAG = re.compile(r"""(?<![\w-])--?(?P<k>[A-Za-z][\w\-]*)(?:=|["']\s*,\s*["']|[ ](?!-))(?P<v>[^\s"'`]+)""")
_ARGUMENT = re.compile(r"--?(?P<k>[A-Za-z][\w\-]*)=")
_CAMEL = re.compile(r"[A-Z]?[a-z]+(?:[A-Z][a-z]{2,}|[A-Z]{2,})*")
_HEADER = re.compile(r"""["'`](?P<k>[A-Za-z][\w\-]*):[ ]*(?P<v>[^\s"'`]+)["'`]""")
_URL = re.compile(r"""[A-Za-z][\w+.\-]*://[^\s:/@"'`?#]*:(?P<v>[^\s/"'`<>]+?)@(?=[\w\[$.{-])""")
_CONN = re.compile(r"""(?i)\b(?P<k>pwd|password|accountkey|sharedaccesskey|sharedsecret)\s*=\s*(?P<v>[^;"'`\s]+)""")
_SCHEME = re.compile(r"(?i:\b(?:bearer|basic|token|apikey|digest))\s+(?P<v>[A-Za-z0-9+/._~\-]{16,}={0,2})")
_ISSUED = re.compile(
    r"""(?x)(?<![\w+/.\-])(?P<v>
      (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])
    | eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}
    | AIza[\w\-]{30,} | SG\.[\w\-]{16,}\.[\w\-]{16,}
    | (?:gh[pousr]|github_pat|glpat|gldt|xox[abeprs]|npm|pypi|hf|dop_v1|shpat|sk|pk|rk|whsec)[_\-](?=[\w\-]*\d)[\w\-]{16,}
    | (?!sha\d|md\d|run|rev|v\d)[a-z][a-z0-9]{1,5}(?:[_\-](?:live|test|prod|stage))?[_\-](?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{16,}
    )(?![\w])"""
)
_RUN = plain_re.compile(r"[\w\-.]{19,}")  # no issued key is shorter: two letters, a mark and 16 more
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:[A-Za-z0-9+/=\s:,\-]|\\[nr])*?)(?=-----END |[^A-Za-z0-9+/=\s:,\-\\]|\\[^nr]|$)")
_HUNK = re.compile(r"(?m)^(?:---|\+\+\+|@@|diff |index ).*$|^[ +\-\\]")
_KEY_LINE = re.compile(rf"""^[ \t]*(?:-[ \t]+)?["']?(?P<k>{_NAME})["']?[ \t]*[:=]""")


@dataclass(frozen=True)
class Found:
    """A credential's value: its characters from ``start`` to ``end``, the key path over it, and what it is."""

    start: int
    end: int
    path: str
    kind: str


@lru_cache(maxsize=100_000)
def names_credential(name: str) -> bool:
    """Whether a key's last words name a credential: db_pass and apiKey do; key_id, cache_key and token_count don't."""
    words = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2])]
    while words and (words[-1].isdigit() or words[-1] in _TAILS and len(words) > 1):
        words.pop()
    if not words:
        return False
    if words[-1] == "key" or words[-1] == "keys":
        return len(words) > 1 and words[-2] in _KEY_KINDS
    return words[-1] in _ENDS and not (len(words) > 1 and words[-2] in ("public", "next", "no"))


_PART = re.compile(r"[^\"'`\n]+")


def credential_shape(value: str, bare: bool = False) -> bool:
    """Whether a value under a credential's name can be one. Without quotes it must also show a digit or sign, or letters mixed as in no name."""
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.fullmatch(value):
        return False
    if re.match(r"[a-z][\w+.\-]*://", value):
        return False  # a password within a URL is found as such
    if re.fullmatch(r"[a-z]+(?:[_\-.][a-z]+)*|[A-Z]+(?:_[A-Z0-9]+)+|-?[\d.,:_]+", value):
        return False  # a name, or a number
    if bare:
        mixed = len(value) >= 8 and value.isalpha() and not value.islower() and not value.isupper() and not _CAMEL.fullmatch(value)
        return (mixed or bool(re.search(r"[\d!@#%&*?^+]", value))) and not re.search(r"[()\[\]{}<>]", value)
    return True


def _random(value: str) -> bool:
    return bool(re.search(r"\d", value) and re.search(r"[A-Za-z]", value)) and not _PLACEHOLDER.fullmatch(value)


class KeyPaths:
    """The keys over any place of code or prose by indentation, however far above; the lines are walked once, when first asked."""

    def __init__(self, view: str) -> None:
        self.view = view
        self.starts: list[int] = []

    def _walk(self) -> None:
        """For each line the line over it: the last before with less indentation."""
        self.over: list[int] = []
        self.key: list[str | None] = []
        stack: list[tuple[int, int]] = []  # indentation, line; both ascend
        before = 0
        for at, line in enumerate(self.view.split("\n")):
            self.starts.append(self.starts[-1] + before + 1 if at else 0)
            before = len(line)
            over, key = -1, None
            if line.strip():
                indent = len(line) - len(line.lstrip())
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                over = stack[-1][1] if stack else -1
                stack.append((indent, at))
                if m := _KEY_LINE.match(line):
                    key = m["k"]
            self.over.append(over)
            self.key.append(key)

    def at(self, place: int) -> tuple[str, ...]:
        if not self.starts:
            self._walk()
        line, path = self.over[bisect_right(self.starts, place) - 1], []
        while line >= 0:
            if self.key[line] is not None:
                path.append(self.key[line])
            line = self.over[line]
        return tuple(reversed(path))


def _plain(text: str) -> str:
    """A diff with headers and the first column of lines blanked; every character keeps its place."""
    return _HUNK.sub(lambda m: " " * len(m[0]), text)


def _joined(view: str, m: re.Match, stop: int) -> tuple[str, int]:
    """The value of an assignment with the further strings that follow it in brackets, and where the last one ends."""
    value, end = m["v"], m.end("v")
    at = m.end()
    if "(" in view[m.end("k") : m.start("q")] and "get" not in view[m.end("k") : m.start("q")]:
        while p := _PARTS.match(view, at, stop):
            value, end, at = value + p["v"], p.end("v"), p.end()
    return value, end


def scan(text: str | None, ext: str = "", diff: bool = False) -> list[Found]:
    """Credentials of a text in order, none within another. [] for null and empty texts; texts are scanned whole."""
    if not text:
        return []
    view = _plain(text) if diff else text
    found: list[Found] = []
    for m in _PEM.finditer(view):  # over the lines of any format, a diff's too
        body = re.sub(r"\\[nr]|\s", "", m["v"])
        if len(body) >= 16 or m.end() >= len(view) - 1:
            found.append(Found(m.start(), m.end("v"), "", "private key"))
    if ext in FORMATS:
        _in_config(view, ext, found)
    else:
        _in_text(view, 0, len(view), ext, found)
    out: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def _in_config(view: str, ext: str, found: list[Found]) -> None:
    """Each value by the keys over it, and what its own text and comments show."""
    held = walk(view, ext)
    for path, start, end, style in held.leaves:
        if m := _ARGUMENT.match(view, start, end):  # an option of a command line names its value itself
            path, start = (*path, m["k"]), m.end()
        keys = [k for k in path if not k.isdigit()]
        value = view[start:end]
        how = "block" if style == "block" or "\n" in value else style
        literal = style not in ("alias", "tagged") and not (style == "bare" and ext.startswith("json"))
        if literal and under_credential(keys) and value_shape(value.strip() if how == "block" else value, keys, how):
            lead = len(value) - len(value.lstrip())
            if "PRIVATE KEY-----" not in value:
                found.append(Found(start + lead, start + len(value.rstrip()), ".".join(path), "key path"))
                continue
        if end - start >= 6 and style != "alias":
            _in_text(view, start, end, ext, found)
    for start, end in held.comments:
        _in_text(view, start, end, ext, found)


def under_credential(keys: list[str]) -> bool:
    """Whether a key path names a credential: its last key does, or a general one (value, default) below one that does."""
    for i, k in enumerate(reversed(keys)):
        if names_credential(k):
            return True
        if k.lower() not in _GENERIC or i + 1 == len(keys):
            return False
    return False


def value_shape(value: str, keys: list[str], style: str) -> bool:
    """Whether the literal of a configuration can be a credential. Under a password's own name words will do, and blanks between them."""
    if style == "bare" and re.fullmatch(r"-?[\d.,:_]+|(?i:true|false|yes|no|on|off|null|~)", value):
        return False
    words = [w.lower() for w in _WORDS.findall(next((k for k in reversed(keys) if k.lower() not in _GENERIC), ""))]
    if words and words[-1] in _PHRASES and style != "block":
        return len(value) >= 4 and not _PLACEHOLDER.fullmatch(value) and not re.match(r"[a-z][\w+.\-]*://", value) and not _NAME_LIKE.fullmatch(value) and not (" " in value and _SENTENCE.search(value))
    return credential_shape(value, bare=style == "bare")


def _in_text(view: str, a: int, b: int, ext: str, found: list[Found]) -> None:
    """Assignments, command lines, headers and values of a shape of their own between two places of a text."""
    put = lambda s, e, k, kind: found.append(Found(s, e, k, kind))

    low = view[a:b].lower()
    named = any(w in low for w in _TRIGGERS)
    if named or any(w in low for w in _MORE[7:]):
        _by_name(view, a, b, ext, low, put)
    if "://" in low:
        for m in _URL.finditer(view, a, b):
            if not _PLACEHOLDER.fullmatch(m["v"]):
                put(m.start("v"), m.end("v"), "", "url")
    if named:
        for m in _CONN.finditer(view, a, b):
            if (view[max(m.start() - 1, 0)] == ";" or view[m.end() : m.end() + 1] == ";") and not _PLACEHOLDER.fullmatch(m["v"]):
                put(m.start("v"), m.end("v"), m["k"], "connection")
    if named or "bearer" in low or "basic" in low or "digest" in low:
        for m in _SCHEME.finditer(view, a, b):
            if _random(m["v"]):
                put(m.start("v"), m.end("v"), "", "scheme")
    for run in _RUN.finditer(view, a, b):
        for m in _ISSUED.finditer(view, run.start(), run.end() + 1):
            if not _PLACEHOLDER.fullmatch(m["v"]):
                put(m.start("v"), m.end("v"), "", "issued")


def _lines(view: str, a: int, b: int, low: str) -> list[tuple[int, int]]:
    """The lines between two places in which a name may stand that counts."""
    if len(low) != b - a:  # a letter whose small form is longer: places differ
        at, out = a, []
        while at < b:
            end = view.find("\n", at, b)
            end = b if end < 0 else end
            out.append((at, end))
            at = end + 1
        return out
    starts: set[int] = set()
    for w in (*_TRIGGERS, *_MORE):
        at = low.find(w)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            at = -1 if end < 0 else low.find(w, end)
    out = []
    for s in sorted(starts):
        end = low.find("\n", s)
        out.append((a + s, b if end < 0 else a + end))
    return out


def _by_name(view: str, a: int, b: int, ext: str, low: str, put: Callable[[int, int, str, str], None]) -> None:
    """Values that follow a name."""
    paths = KeyPaths(view)
    lines = _lines(view, a, b, low)
    for at in (k for s, e in lines for k in _KEY.finditer(view, s, min(e + 1, b))):
        key = at[0]
        sure = names_credential(key)
        if not sure and key.lower() not in _GENERIC or not (m := _ASSIGN.match(view, at.start(), b)):
            continue
        if not sure:
            over = paths.at(m.start())
            if not over or not names_credential(over[-1]):
                continue
            key = ".".join((*over, key))
        value, end = _joined(view, m, b)
        if credential_shape(value):
            put(m.start("v"), end, key, "assigned")
    for m in _DEFAULT.finditer(view, a, b):
        if names_credential(m["k"]) and credential_shape(m["v"]):
            put(m.start("v"), m.end("v"), m["k"], "default")
    for m in (x for s, e in lines if (x := _BARE.match(view, s, e))):
        key = m["k"].strip("\"'")
        if m["mark"] or ext in BARE_FORMATS:
            over = paths.at(m.start("k")) if key.lower() in _GENERIC else ()
            value = m["v"].rstrip(",;")
            noted = bool(m["mark"]) and key.lower() in _NOTES
            if (names_credential(key) or noted or over and names_credential(over[-1])) and credential_shape(value, bare=True):
                put(m.start("v"), m.start("v") + len(value), key, "bare")
    for rx, kind in ((_SAID, "said"), (_FLAG, "flag"), (_HEADER, "header")):
        for m in rx.finditer(view, a, b):
            value = m["v"].rstrip(".,;)")
            if names_credential(m["k"].replace(" ", "_")) and credential_shape(value, bare=True):
                put(m.start("v"), m.start("v") + len(value), m["k"], kind)


_COVER = re.compile(r"\\[nr]|-----[^-\n]*-----|[^\s\"'`]")
_COVER_PEM = re.compile(r"\\[nr]|-----BEGIN [^-\n]*-----|[A-Za-z0-9+/=]")


def redact(text: str | None, found: list[Found], diff: bool = False) -> str | None:
    """The text with an x over each character of the values; line breaks, quotes and a private key's header stay."""
    if text is None:
        return None
    view, out, at = _plain(text) if diff else text, [], 0
    for f in found:
        cover = _COVER_PEM if f.kind == "private key" else _COVER
        covered = cover.sub(lambda m: m[0] if len(m[0]) > 1 else "x", view[f.start : f.end])
        kept = [c if v == t else t for c, v, t in zip(covered, view[f.start : f.end], text[f.start : f.end], strict=True)]
        out += [text[at : f.start], "".join(kept)]
        at = f.end
    return "".join([*out, text[at:]])


def scan_patch(old: str | None, new: str | None, diff: str | None, ext: str) -> dict[str, list[Found]]:
    """Credentials of the three fields of a patch. A value that the contents show is one in the diff too, where its key may be cut off."""
    out = {"old_content": scan(old, ext), "new_content": scan(new, ext), "diff": scan(diff, ext, diff=True)}
    if diff:
        shown = {_PART.match(text, f.start, f.end)[0] for text, fs in ((old, out["old_content"]), (new, out["new_content"])) for f in fs if f.kind != "private key"}
        more = []
        for value in shown:
            at = diff.find(value)
            while at >= 0:
                end = at + len(value)
                alone = not (diff[at - 1 : at].isalnum() or diff[end : end + 1].isalnum())
                if len(value) >= 6 and alone and not any(f.start < end and at < f.end for f in out["diff"]):
                    more.append(Found(at, end, "", "shown"))
                at = diff.find(value, end)
        if more:
            out["diff"] = sorted([*out["diff"], *more], key=lambda f: f.start)
    return out


def find(patches: DataFrame) -> DataFrame:
    """patch_id, field_name, line_no, byte_start, byte_end, key_path, kind of every value; repeated rows repeat.

    Offsets count UTF-8 bytes of the field from 0, lines from 1. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, take, cols = batch.column(0), [], [[] for _ in range(6)]
            for i in range(batch.num_rows):
                texts = [batch.column(2 + k)[i].as_py() for k in range(len(FIELDS))]
                found = scan_patch(*texts, _ext(batch.column(1)[i].as_py()))
                for field, text in zip(FIELDS, texts, strict=True):
                    line = byte = seen = 0
                    for f in found[field]:
                        line += text.count("\n", seen, f.start)
                        byte += len(text[seen : f.start].encode())
                        seen = f.start
                        take.append(i)
                        for c, v in zip(cols, (field, line + 1, byte, byte + len(text[f.start : f.end].encode()), f.path, f.kind), strict=True):
                            c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["patch_id", "field_name", "line_no", "byte_start", "byte_end", "key_path", "kind"])

    rows = spread(patches.select("patch_id", "file_path", *FIELDS))
    return rows.mapInArrow(run, "patch_id string, field_name string, line_no long, byte_start long, byte_end long, key_path string, kind string")


def redacted(patches: DataFrame) -> DataFrame:
    """patch_id, file_path and the three fields with values blanked; null fields stay null, repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: list[list] = [[] for _ in FIELDS]
            for i in range(batch.num_rows):
                texts = [batch.column(2 + k)[i].as_py() for k in range(len(FIELDS))]
                found = scan_patch(*texts, _ext(batch.column(1)[i].as_py()))
                for c, field, text in zip(clean, FIELDS, texts, strict=True):
                    c.append(redact(text, found[field], field == "diff"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in clean)], names=["patch_id", "file_path", *FIELDS])

    return spread(patches.select("patch_id", "file_path", *FIELDS)).mapInArrow(run, "patch_id string, file_path string, old_content string, new_content string, diff string")


def _ext(path: str | None) -> str:
    name = re.split(r"[/\\]", path or "")[-1]
    return name.rpartition(".")[2].lower().strip() if "." in name else ""


def found_lines(patches: DataFrame) -> DataFrame:
    """patch_id, field_name, line_no of every line where a value starts, once."""
    return find(patches).select("patch_id", "field_name", F.col("line_no")).distinct()
