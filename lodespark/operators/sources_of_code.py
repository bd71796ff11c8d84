"""What source text shows: line scans in the JVM, and a table of modules, functions and calls from its syntax tree."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls that are risky by name, whole or as a last part.
RISKY = {
    "eval": "critical",
    "exec": "critical",
    "compile": "high",
    "os.system": "critical",
    "subprocess.call": "high",
    "pickle.loads": "critical",
    "yaml.load": "high",
    "yaml.unsafe_load": "critical",
}
SAFE_COMPILE = ("re.compile", "regex.compile")
# Lines that look like a secret, with severity; values that are none.
SECRET_LINES = {
    "hardcoded_password": ("high", r"(?i)(?:password|passwd|pwd)\s*=\s*[\"'][^\"']+[\"']"),
    "hardcoded_secret": ("high", r"(?i)(?:api_key|apikey|auth_token|access_token|secret_key|client_secret)\s*=\s*[\"'][^\"']+[\"']"),
    "hardcoded_connection": ("medium", r"(?i)(?:database_url|db_url|connection_string)\s*=\s*[\"'][^\"']+[\"']"),
}
NO_SECRET = ("", "local", "test", "example", "your_key_here", "config.get")
# What a patch must not bring in.
SECRET_PATTERNS = (
    r"(?i)(password|passwd|pwd)\s*=\s*['\"][^'\"]{4,}['\"]",
    r"(?i)(api[_-]?key|apikey|secret[_-]?key)\s*=\s*['\"][^'\"]{8,}['\"]",
    r"(?i)(bearer|token)\s+[A-Za-z0-9_\-]{20,}",
    r"\b(?:ghp|github_pat_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9_]{36,}\b",
    r"\b(?:sk|pk|priv)[_-]?[A-Za-z0-9]{20,}\b",
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
)
#: The value that a line assigns, and what reads one from elsewhere.
ASSIGNED = r"=\s*[\"']([^\"']+)[\"']"
READ = r"config\.get|os\.environ"


def secret_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """All columns and risk_type, severity of each line that looks like a secret, once for each kind.

    A value that is a known placeholder, or is read from a configuration or the environment, is none.
    Null lines have none.
    """
    text = F.col(line)
    value = F.lower(F.trim(F.regexp_extract(text, ASSIGNED, 1)))
    fine = F.regexp_extract(text, ASSIGNED, 1).isin("") | ~(value.isin(*NO_SECRET) | text.rlike(READ))
    kinds = [F.when(text.rlike(rx), F.struct(F.lit(k).alias("risk_type"), F.lit(sev).alias("severity"))) for k, (sev, rx) in SECRET_LINES.items()]
    hit = lines.where(fine).withColumn("_k", F.explode(F.array_compact(F.array(*kinds))))
    return hit.select(*lines.columns, "_k.*")


def patch_secrets(old: Column, new: Column) -> Column:
    """How often each of the six patterns occurs in a patch's old and new text, as an array; null texts count as empty."""
    both = F.concat(F.coalesce(old, F.lit("")), F.lit("\n"), F.coalesce(new, F.lit("")))
    return F.array(*(F.regexp_count(both, F.lit(rx)).cast("long") for rx in SECRET_PATTERNS))


def lines_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line of every line; null texts have none."""
    return rows.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line")).select(id_col, (F.col("p") + 1).alias("line_no"), "line")


def diff_counts(rows: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """id, added, removed: changed lines of a unified diff without its file headers."""
    parts = F.split(diff_col, "\n", -1)
    count = lambda sign: F.size(F.filter(parts, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return rows.where(F.col(diff_col).isNotNull()).select(id_col, count("+").alias("added"), count("-").alias("removed"))


def changed_lines(old: Column, new: Column) -> Column:
    """How many lines differ by place between two texts; a line that only one has differs."""
    pairs = F.zip_with(F.split(F.coalesce(old, F.lit("")), "\n", -1), F.split(F.coalesce(new, F.lit("")), "\n", -1), lambda a, b: ~a.eqNullSafe(b))
    return F.size(F.filter(pairs, lambda x: x)).cast("long")


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256; null for null."""
    return F.substring(F.sha2(text, 256), 1, 16)


def extension(path: Column) -> Column:
    """A path's extension in lower case; '' if it has none."""
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)


def slashes(path: Column) -> Column:
    """A path with forward slashes, none doubled, without ./ before it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+", "/"), r"^(\./)+", "")


def _name(node: ast.expr) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _risk(name: str) -> str | None:
    """The severity of the first pattern that a call's name ends with; compiling a regular expression is no risk."""
    hits = (s for p, s in RISKY.items() if (name == p or name.endswith("." + p)) and not (p == "compile" and any(safe in name for safe in SAFE_COMPILE)))
    return next(hits, None)


def facts(source: str) -> Iterator[tuple[str, str, int, float]]:
    """(kind, name, line, value) of a Python source: import, symbol, function (its risk score), call, risk, bare_except, long_function, no_docstring, fstring_sql. None if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, node.lineno, 0.0
        elif isinstance(node, ast.ImportFrom):
            yield "import", "." * node.level + (node.module or ""), node.lineno, 0.0
        elif isinstance(node, ast.Call):
            name = _name(node.func)
            if name:
                yield "call", name, node.lineno, 0.0
                if risk := _risk(name):
                    yield "risk", f"{risk}:{name}", node.lineno, 0.0
                if ("execute" in name or "cursor" in name) and any(isinstance(x, ast.JoinedStr) for x in node.args):
                    yield "fstring_sql", name, node.lineno, 0.0
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            yield "bare_except", "except", node.lineno, 0.0
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            length = (node.end_lineno or node.lineno) - node.lineno + 1
            documented = ast.get_docstring(node) is not None
            calls = [_name(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)]
            bare = sum(isinstance(x, ast.ExceptHandler) and x.type is None for x in ast.walk(node))
            n_args = len(node.args.args)
            score = 0.3 * sum(_risk(c) is not None for c in calls) + 0.1 * (not documented) + 0.1 * (length > 30) + 0.1 * (n_args > 5) + 0.2 * bare
            yield "function", node.name, node.lineno, round(min(score, 1.0), 2)
            if length > 50:
                yield "long_function", node.name, node.lineno, float(length)
            if not documented:
                yield "no_docstring", node.name, node.lineno, 0.0
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield "symbol", node.name, node.lineno, 5.0 if isinstance(node, ast.ClassDef) else 12.0


def python_facts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, name, line, value of every Python source that parses; one pass in Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cols = [], [[] for _ in range(4)]
            for i, text in enumerate(b.column(1)):
                for fact in facts(text.as_py()):
                    take.append(i)
                    for c, v in zip(cols, fact, strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "kind", "name", "line", "value"])

    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, kind string, name string, line int, value double").withColumnRenamed("id", id_col)
