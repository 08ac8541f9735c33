"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickmill.session import scratch_dir

# Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again.

    Cuts the lineage without depending on any executor's disk, and keeps a costly step from running twice.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name).rstrip('/')}/table"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of contract words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, columns: list[str], schema: str, task: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Run ``task`` once per partition over rows of ``columns``; it yields tuples in the order of ``schema``.

    Rows travel in Arrow batches. Output is flushed in blocks, so memory follows a batch and not a partition.
    """
    spark_schema = _schema(schema)
    names = [f.name for f in spark_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                held = [batch.column(i) for i in range(len(columns))]
                for k in range(batch.num_rows):
                    yield tuple(c[k].as_py() for c in held)

        def block(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in found], arrow.field(i).type) for i in range(len(names))], schema=arrow
            )

        found: list[tuple] = []
        for row in task(rows()):
            found.append(row)
            if len(found) >= 2000:
                yield block(found)
                found = []
        if found:
            yield block(found)

    return df.select(*columns).mapInArrow(run, spark_schema)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U64(30))
        x = x * _U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U64(27))
        x = x * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


class TokenHashes(dict):
    """Remembered CRC-32 of tokens; emptied when it holds ``most`` of them, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = zlib.crc32(token.encode())
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


# Rows of a few plain columns that may be sent to every task; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where a count shows that it has at most ``rows`` rows; else ``df`` as it is.

    Both ways give the same rows. Pass written tables, as the count reads them.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
