"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., tuple | None], schema: str, arrow: pa.Schema, rows: int = 512) -> DataFrame:
    """``fn(*values)`` for each row's ``columns``, in Arrow batches.

    Only the named columns reach Python, so other columns of any name are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = [fn(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*got), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def chunks(items: Iterable, size: int) -> Iterator[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
