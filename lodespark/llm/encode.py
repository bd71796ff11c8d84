"""Encoding of a corpus with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.joins import spread
from lodespark.llm.bpe import default_path, encoder


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and ids (array of int) of every row, in one pass without a shuffle.

    Null and empty texts have an empty list. Repeated rows give repeated rows. Texts are encoded
    whole, whatever their length. ``path``: the rank file, which each executor reads for itself.
    """
    file, id_field = path or default_path(), docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n:  # small outputs: a few very long texts do not pile up
                ids, size, hi = [], 0, lo
                while hi < n and size < 1_000_000:
                    ids.append(enc.encode(batch.column(1)[hi].as_py()))
                    size += len(ids[-1])
                    hi += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                lo = hi

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"id {id_field.dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)
