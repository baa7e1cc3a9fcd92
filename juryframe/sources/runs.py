"""Saved runs: rows and their inventory as Parquet folders, with a manifest written last as the commit mark.

A run is whole only if its manifest is there and still agrees with what is read: a write that broke off has none, and a
folder that lost or gained a file disagrees. Counts and digests are sums over rows, so no id list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What can become of a unit (fixed values).
ANSWERED, FAILED, EXCLUDED = "answered", "failed", "excluded"
SCHEMA = "juryframe-run/1"
_MANIFEST = "schema string, rows long, rows_digest string, units long, units_digest string, note string"


def _sum_digest(*cols: Column) -> Column:
    """Order-free digest of rows."""
    return F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string")


def inventory(rows: DataFrame, units: DataFrame, *, id: str = "id", error: str = "error", excluded: DataFrame | None = None) -> DataFrame:
    """(id, outcome) of all units of a run: a row with an error failed, one without is answered; `excluded` names units never asked."""
    outcome = rows.select(F.col(id).alias("id"), F.when(F.col(error).isNotNull(), FAILED).otherwise(ANSWERED).alias("outcome"))
    if excluded is not None:
        outcome = outcome.unionByName(excluded.select(F.col(id).alias("id"), F.lit(EXCLUDED).alias("outcome")))
    return units.select(F.col(id).alias("id")).join(outcome, "id", "left")


def partition_problems(rows: DataFrame, held: DataFrame, *, id: str = "id", error: str = "error") -> DataFrame:
    """(id, problem) for each way in which rows and inventory do not part the units into answered, failed and excluded.

    Named in this order, one for each id: no id; listed more than once; no outcome; more than one row; a row that the
    inventory does not list; a listed unit without a row; an excluded unit with one; an outcome other than the row's.
    """
    seen = rows.groupBy(F.col(id).alias("row_id")).agg(F.count("*").alias("rows"), F.count_if(F.col(error).isNotNull()).alias("failed"))
    listed = held.groupBy(F.col("id").alias("unit_id")).agg(F.count("*").alias("times"), F.min("outcome").alias("outcome"))
    both = seen.join(listed, F.col("row_id").eqNullSafe(F.col("unit_id")), "full")
    key, count = F.coalesce("row_id", "unit_id"), F.coalesce("rows", F.lit(0))
    says = F.when(F.col("failed") > 0, FAILED).otherwise(ANSWERED)
    problem = (F.when(key.isNull(), "no id").when(F.col("times") > 1, "listed more than once").when(F.col("times").isNotNull() & F.col("outcome").isNull(), "no outcome")
               .when(count > 1, "more than one row").when(F.col("times").isNull(), "not in the inventory")
               .when((count == 0) & (F.col("outcome") != EXCLUDED), "no row").when((count > 0) & (F.col("outcome") == EXCLUDED), "excluded unit has a row")
               .when((count > 0) & (F.col("outcome") != says), "outcome differs from its row"))
    return both.select(key.alias("id"), problem.alias("problem")).where("problem IS NOT NULL")


def _figures(rows: DataFrame, held: DataFrame) -> tuple:
    ordered = sorted(rows.columns)
    return (*rows.agg(F.count("*"), _sum_digest(*[F.col(f"`{c}`") for c in ordered])).first(), *held.agg(F.count("*"), _sum_digest(F.col("id"), F.col("outcome"))).first())


def save(rows: DataFrame, held: DataFrame, path: str, *, note: str = "", id: str = "id", error: str = "error") -> str:
    """Write a run: rows, then the inventory, then the manifest. A run whose rows do not part its inventory is refused.

    The rows' columns must have types that can be hashed (no maps). An existing manifest is never overwritten.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    if _manifest(spark, path) is not None:
        raise ValueError(f"{path} holds a run")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    held.write.mode("overwrite").parquet(f"{path}/inventory")
    rows, held = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/inventory")
    _refuse(rows, held, id, error)
    spark.createDataFrame([(SCHEMA, *_figures(rows, held), note)], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def _manifest(spark: SparkSession, path: str):
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(_MANIFEST).json(f"{path}/manifest").limit(2).collect()
    except AnalysisException:
        return None
    return found[0] if len(found) == 1 and found[0]["schema"] == SCHEMA else None


def _refuse(rows: DataFrame, held: DataFrame, id: str, error: str) -> None:
    bad = partition_problems(rows, held, id=id, error=error).limit(5).collect()
    if bad:
        raise ValueError("rows do not part the inventory: " + "; ".join(f"{r['id']}: {r['problem']}" for r in bad))


def load(spark: SparkSession, path: str, *, id: str = "id", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows, inventory) of a saved run. One without a manifest, or that no longer agrees with it, is refused."""
    path = path.rstrip("/")
    kept = _manifest(spark, path)
    if kept is None:
        raise ValueError(f"{path} holds no whole run")
    rows, held = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/inventory")
    if _figures(rows, held) != (kept["rows"], kept["rows_digest"], kept["units"], kept["units_digest"]):
        raise ValueError(f"{path} does not agree with its manifest")
    _refuse(rows, held, id, error)
    return rows, held
