"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import fresh_path, map_in_arrow

#: Texts are handled in runs of about so many characters, so a task's memory does not grow with
#: the rows of an Arrow batch.
RUN_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no model may learn from; a null id counts as learnable."""
    digest = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(digest, F.lit(3)) == 1, F.lit(False))


def sample_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) per row, repeatable for rows read in the same order.

    The row's number takes part, so rows that share a key or have none are drawn one by one.
    """
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), key, F.lit(salt)), F.lit(1_000_003)) / 1_000_003


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Column with a row's own number, apart from any name in the tables.
ROW = "__row"


def with_row(df: DataFrame) -> DataFrame:
    """Rows numbered by their place in the scan, so that repeated and null ids stay apart."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


#: Column that holds all columns of a stored row, so that no helper column can clash with them.
DOC = "doc"


def with_stored_row(df: DataFrame, name: str) -> DataFrame:
    """``ROW`` and ``DOC`` of every row, written once, so that every later read sees the same numbers."""
    path = fresh_path(df.sparkSession, f"{name}-rows")
    numbered = df.select(F.monotonically_increasing_id().alias(ROW), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(DOC))
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def columns_of(rows: DataFrame, *names: str) -> DataFrame:
    """``ROW`` and the named columns of stored rows."""
    return rows.select(ROW, *[F.col(f"{DOC}.{n}").alias(n) for n in names])


def append_columns(
    df: DataFrame, outputs: str, start: Callable[[], Callable[[dict, int], list]],
    inputs: tuple[str, ...],
) -> DataFrame:
    """``df`` with Arrow-computed columns; a column of ``df`` that has an output's name is replaced.

    ``start`` runs once in each task and returns ``compute(columns, rows) -> list of arrays``,
    where ``columns`` maps each name of ``inputs`` to its Arrow array.
    """
    added = T.StructType.fromDDL(outputs)
    new = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in new]
    schema = T.StructType(kept + list(added.fields))
    needed = [f for f in df.schema if f.name in inputs and f.name.lower() in new]
    source = df.select(
        *[F.col(f"`{f.name}`") for f in kept],
        *[F.col(f"`{f.name}`").alias(f"__in_{f.name}") for f in needed],
    )
    replaced = {f.name for f in needed}
    names = [f.name for f in kept]
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in added]
    arrow_names = names + [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            columns = {
                c: batch.column(f"__in_{c}" if c in replaced else c) for c in inputs
            }
            made = compute(columns, batch.num_rows)
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow_names)

    return source.transform(map_in_arrow, run, schema)


def runs_of(lengths: list[int], limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths sum to about ``limit``; a longer element is a run of its own."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
