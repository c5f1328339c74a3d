"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiegrid.plans.work import materialize, work_path

__all__ = ["arrow_rows", "materialize", "work_path", "id_type", "by_bytes", "map_texts", "release_others", "worker_object", "table", "text_bytes", "string_sha256"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts (its second column), of about ``most`` bytes each."""
    texts = text_bytes(batch.column(1))
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most or k == len(texts) - 1:
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, size = k + 1, 0


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within this, Python tasks get at most so many rows at a time: for rows that hold long lists. What runs in it has to be written in it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_HELD: dict = {}


def worker_object(name: str, token: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept in this Python worker while the same operator runs with the same token.

    One object is held at a time: workers outlive stages, and tables that a
    stage before has left would add up.
    """
    if _HELD.get("name") != name or _HELD["token"] is not token and _HELD["token"] != token:
        _HELD.clear()
        _HELD.update(name=name, token=token, made=build())
    return _HELD["made"]


def release_others(name: str | None) -> None:
    """Called where a task begins: drops what another operator has left in this worker."""
    if _HELD.get("name") != name:
        _HELD.clear()


def map_texts(
    docs: DataFrame,
    rows: Callable[[list[bytes]], list[pa.Array]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    holds: str | None = None,
) -> DataFrame:
    """One output row for each document: its id, then what ``rows`` makes of the texts.

    Only the two named columns are read, so other columns of ``docs`` can have
    any names. Texts pass in slices of some megabytes to bound a task's memory.
    ``holds`` names the worker object that ``rows`` uses, if any.
    """
    schema = f"{id_col} {id_type(docs, id_col)}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(holds)
        for batch in batches:
            for part, texts in by_bytes(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *rows(texts)], names=names)

    names = StructType.fromDDL(schema).names
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def string_sha256(text: str) -> str:
    from hashlib import sha256

    return sha256(text.encode()).hexdigest()
