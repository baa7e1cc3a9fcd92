"""Helpers the operators share: row keys, lineage cuts, word arrays as columns, Arrow output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from juryframe.session import checkpoint_dir

#: Fixed class of ASCII white space, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: The widest Arrow batch sent to a Python worker.
ARROW_BYTES = "2m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the bytes of a batch that goes to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def fresh_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint folder and read it back: later steps start from these files."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """Words parted by ASCII white space; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrapped(docs: DataFrame, **named: Column) -> DataFrame:
    """`docs` as one column `row`, beside the given columns: no name of the caller's can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in named.items()])


def row_key(text: Column) -> Column:
    """Tells rows of equal id and different text apart; rows equal in both get equal results."""
    return F.xxhash64(text)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)
