"""A run journal read as a stream: attempts as they stand after every micro-batch, kept in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from juryframe.operators import journal as J

LINES = "journal string, number long, line string, ended boolean"


def read_lines(spark: SparkSession, path: str, schema: str = LINES, **options: str) -> DataFrame:
    """Journal lines that arrive as Parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def records(lines: DataFrame) -> DataFrame:
    """Typed records of complete lines. A line whose break isn't written yet is no record; its writer sends it again whole."""
    body = F.try_parse_json(F.col("line"))
    whole = lines.where("ended").select("journal", "number", body.alias("body")).where("body IS NOT NULL")
    return J.fields(whole.select("journal", "number", F.try_variant_get("body", "$.event", "string").alias("event"), "body"))


def keep_attempts(lines: DataFrame, table: str, checkpoint: str, *, host: Column | None = None, **trigger) -> StreamingQuery:
    """Start the stream: every micro-batch writes the attempts it changed under its own number.

    A batch that runs again after a failure replaces what it wrote, so restarts neither lose nor double a state. The
    state of an attempt is one row of aggregates, with the distinct keys delivered so far.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch}")

    folded = J.attempts(records(lines), host=host)
    return folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_attempts(spark: SparkSession, table: str) -> DataFrame:
    """The attempts of `keep_attempts` as they stand: of each, the row of the latest batch that changed it."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("journal", "attempt").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["journal", "attempt", "batch"]).drop("batch")
