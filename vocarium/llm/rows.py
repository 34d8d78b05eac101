"""Reading the columns an operator needs, and walking Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 512

#: What the tasks of one operator keep in a worker for its next task, by module.
KEPT: dict[str, object] = {}


def make_room(module: str) -> None:
    """Let go of what other operators have kept in this worker."""
    for other in [name for name in KEPT if name != module]:
        del KEPT[other]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` with the text as UTF-8 bytes, null as empty; other columns play no part."""
    return df.select(F.col(key).cast("bigint").alias(key), utf8(text).alias(text))


def plain(df: DataFrame) -> DataFrame:
    """``df`` with numbers for names, so that expressions and odd or equal names can be sent to Python."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str,
             rows: int = 2048) -> DataFrame:
    """Run ``work`` on the rows of each partition as tuples; its tuples come back in batches.

    Rows become Python objects a slice of an Arrow batch at a time and results are sent every
    ``rows`` rows, so memory is bounded by a batch.
    """
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield from zip(*(column.to_pylist() for column in part.columns), strict=True)

        make_room(work.__module__)
        held: list[tuple] = []
        for row in work(source()):
            held.append(row)
            if len(held) >= rows:
                yield _batch(held, names, arrow)
                held = []
        if held:
            yield _batch(held, names, arrow)

    return plain(df).mapInArrow(run, schema)


def _batch(held: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, arrow.field(i).type) for i, values in enumerate(zip(*held, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def byte_alphabet() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes bytes: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
