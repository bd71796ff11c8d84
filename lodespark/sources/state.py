"""Stores of state: JSON documents with a silent fall-back, Parquet tables replaced as a whole, text files and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of text files and folders that a scan leaves out.
TEXT_EXTENSIONS = ("py", "md", "txt", "json", "yaml", "yml", "toml", "ini", "cfg", "js", "ts", "html", "css", "sh", "sql")
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build")


def load_json_state(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The documents at ``path`` by an explicit schema; what can't be read as JSON gives rows of nulls that are dropped, a missing path no rows."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")
    except Exception as missing:  # noqa: BLE001  only a path that is not there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def save_state(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces the table at ``path``. The rows must not be read from that same path."""
    df.write.mode("overwrite").format(fmt).save(path)


def export_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text in the column ``value``; nulls keep their keys."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def import_json(texts: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The inverse of export_json; texts that are no JSON are left out."""
    return texts.select(F.from_json("value", schema).alias("v")).where("v is not null").select("v.*")


def text_files(spark: SparkSession, root: str, max_bytes: int = 200_000) -> DataFrame:
    """path, content of text files below ``root``: of known extensions, up to ``max_bytes``, not in skipped folders.

    File sizes and paths are filtered before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1)
    inside = F.lit(True)
    for d in SKIPPED:
        inside = inside & ~F.contains(F.col("path"), F.lit(f"/{d}/"))
    return files.where((F.col("length") <= max_bytes) & ext.isin(*TEXT_EXTENSIONS) & inside).select("path", F.col("content").cast("string").alias("content"))


def fingerprints(spark: SparkSession, root: str, max_bytes: int = 200_000) -> DataFrame:
    """path, size, content_hash (16 hex digits of SHA-256) of text files."""
    t = text_files(spark, root, max_bytes)
    return t.select("path", F.octet_length("content").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def traceback_place(text: Column) -> Column:
    """struct(file, line, error) of a Python traceback's innermost frame; nulls where it has none."""
    frames = F.regexp_extract_all(text, F.lit(r'File "([^"]+)", line \d+'), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(r'File "[^"]+", line (\d+)'), F.lit(1))
    error = F.regexp_extract(text, r"(?m)^(\w+(?:Error|Exception|Warning|Exit|Interrupt))\b", 1)
    return F.struct(F.try_element_at(frames, F.lit(-1)).alias("file"), F.try_element_at(numbers, F.lit(-1)).cast("int").alias("line"), F.when(error != "", error).alias("error"))


def low_coverage(coverage: DataFrame, text: str, below: float = 70.0) -> DataFrame:
    """file, percent of the files of coverage reports (JSON) under ``below`` percent."""
    schema = "files map<string, struct<summary: struct<percent_covered: double>>>"
    f = coverage.select(F.explode(F.from_json(text, schema)["files"]).alias("file", "f"))
    return f.select("file", F.col("f.summary.percent_covered").alias("percent")).where(F.col("percent") < below)
