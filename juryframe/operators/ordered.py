"""Running totals in a fixed order without sending one whole key to one task.

A plain window puts all rows of a key in one task. Here each key is split into runs by a `bucket` expression that
never falls along the order. Runs are aggregated, the few run totals are accumulated, and a window inside each run
adds its part. One run is the largest group any task sees, so a key that holds a third of the table is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN_WIDTH = 100_000


def run_of(position: Column, width: int = RUN_WIDTH) -> Column:
    """Bucket of an ascending whole-number position."""
    return F.floor(position / F.lit(width)).cast("long")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums and maxima per key. With `inclusive=False` the current row is left out.

    Null keys are one key, and rows without a place come first in it; none is lost.
    """
    sums, maxes = sums or {}, maxes or {}
    tagged = df.withColumn("_run", bucket)
    for name, col in {**sums, **maxes}.items():
        tagged = tagged.withColumn(f"_in_{name}", col)
    totals = tagged.groupBy(*keys, "_run").agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes],
    )
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_run").alias("_k_run"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    same = F.col("_run").eqNullSafe(F.col("_k_run"))
    for i, k in enumerate(keys):
        same = same & tagged[k].eqNullSafe(carried[f"_k_{i}"])
    joined = tagged.join(carried, same)
    out = joined
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.sum(f"_in_{name}").over(inside), F.lit(0)) + F.col(f"_c_{name}"))
    for name in maxes:
        out = out.withColumn(name, F.greatest(F.max(f"_in_{name}").over(inside), F.col(f"_c_{name}")))
    spare = [c for c in out.columns if c == "_run" or c.startswith(("_in_", "_c_", "_k_"))]
    return out.drop(*spare)


def with_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """1-based position of each row inside its key."""
    return with_running(df, keys, order, bucket, sums={name: F.lit(1).cast("long")})
