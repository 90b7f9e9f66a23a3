"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidegrid.session import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but runs the plan only once and keeps
    column pruning for the reads that follow.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks.

    Task functions are shipped by value, so their module globals are new in every
    task. Only pure functions of the key may be kept here, within a bound.
    """
    holder = sys.modules.setdefault("tidegrid_llm_process_memo", types.ModuleType("tidegrid_llm_process_memo"))
    return holder.__dict__.setdefault(f"memo_{name}", {})


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start, held = 0, 0
        for i, value in enumerate(sizes):
            size = len(value.as_buffer()) if value.is_valid else 0
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (bytes methods touch ASCII only)."""
    return text.lower().split()


def words_in(batch: pa.RecordBatch, column: str = "text") -> tuple[pa.Array, np.ndarray]:
    """The words (UTF-8 bytes) of all texts, one text after the other, and how many each text has; as ``words_of`` finds them."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, counts = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at either end of a text makes an empty word.
    full = pc.greater(pc.binary_length(words), 0)
    empty = np.flatnonzero(~full.to_numpy(zero_copy_only=False))
    if len(empty):
        counts -= np.bincount(np.searchsorted(np.cumsum(counts), empty, side="right"), minlength=len(counts))
        words = words.filter(full)
    return words, counts
