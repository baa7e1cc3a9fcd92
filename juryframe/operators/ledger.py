"""Usage ledgers: scoped entries, repeats that conflict, and totals that keep what is unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Purposes of a call and the bucket each belongs to; any other is "other" (fixed values).
PURPOSES = {"judge": "judgment", "judge_batch": "judgment", "eval_completion": "completion"}
TOKENS = ("input", "output", "cache_read", "cache_write")
#: Buckets a total can be asked for, and those whose billing the ledger never sees whole (fixed values).
BUCKETS = ("outer", "judgment", "completion", "other", "auxiliary", "total")
UNSEEN = ("completion", "auxiliary", "total")
MONEY = "decimal(28,9)"


def entries(raw: DataFrame, *, scope: str = "scope", origin: str = "origin", id: str = "id", order: str = "order") -> DataFrame:
    """Ledger entries of raw calls: scope, origin, id, order, bucket, tokens, reported_cost, cost_unknown, estimated, payload.

    `raw` has purpose, stop_reason, the four token counts, cost, cost_unknown and estimated (each may be null). A call
    without an id is no entry. The cost is unknown if the call says so or gives none, or if it failed without any token;
    an estimate is assumed unless the call denies it. `payload` is a digest of all that repeats must agree on.
    """
    none_used = ~F.coalesce(sum(((F.coalesce(F.col(t), F.lit(0)) > 0).cast("int") for t in TOKENS), F.lit(0)) > 0, F.lit(False))
    unknown = F.coalesce(F.col("cost_unknown"), F.lit(False)) | F.col("cost").isNull() | (F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False)) & none_used)
    bucket = F.coalesce(F.create_map(*[F.lit(x) for p in PURPOSES.items() for x in p])[F.coalesce("purpose", F.lit(""))], F.lit("other"))
    told = ("purpose", "stop_reason", *TOKENS, "cost", "cost_unknown", "estimated")
    return raw.where(F.length(id) > 0).select(
        F.col(scope).alias("scope"), F.col(origin).alias("origin"), F.col(id).alias("id"), F.col(order).alias("order"),
        F.when(F.col(origin) == "outer", "outer").otherwise(bucket).alias("bucket"), *[F.col(t).cast("long").alias(t) for t in TOKENS],
        F.when(~unknown, F.col("cost").cast(MONEY)).alias("reported_cost"), unknown.alias("cost_unknown"), (~F.coalesce(~F.col("estimated"), F.lit(False))).alias("estimated"),
        F.sha2(F.to_json(F.struct(*told)), 256).alias("payload"))


def first_entries(rows: DataFrame) -> DataFrame:
    """One entry per scope, origin and id, the first by order, with repeats (how many more there were) and conflicts (how many of those differ).

    Repeats are folded by payload before they meet, so an id that is repeated very often gathers nowhere.
    """
    kept = [c for c in rows.columns if c not in ("scope", "origin", "id", "payload")]
    per = rows.groupBy("scope", "origin", "id", "payload").agg(F.min(F.struct(*kept)).alias("e"), F.count("*").alias("n"))
    one = per.groupBy("scope", "origin", "id").agg(F.min(F.struct(F.col("e.order").alias("order"), "payload", "e", "n")).alias("f"), F.sum("n").alias("all"))
    return one.select("scope", "origin", "id", "f.e.*", (F.col("all") - 1).alias("repeats"), (F.col("all") - F.col("f.n")).alias("conflicts"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Entries whose repeats differ from the first: scope, origin, id, conflicts."""
    return first_entries(rows).where("conflicts > 0").select("scope", "origin", "id", "conflicts")


def totals(unique: DataFrame, snapshots: DataFrame, *, overall: bool = True) -> DataFrame:
    """Totals of every scope and bucket, and of all scopes (scope null, `overall` true).

    entries, tokens, tokens_complete (every entry told every count), reported_subtotal (what is known), reported_cost
    (null as soon as any part is unknown), cost_unknown, estimated, coverage_unknown, complete (was the ledger of the
    scope collected whole). `snapshots` has scope and status: a scope without one, with one that isn't "complete", or
    with a conflict is incomplete, and then none of its costs is known. Completion calls are never journaled, so what
    contains them is known in part only. Merging totals of parts gives the totals of the whole.
    """
    states = snapshots.groupBy("scope").agg(F.bool_and(F.col("status") == "complete").alias("collected"))
    groups = F.array(F.lit("total"), F.when(F.col("bucket") == "outer", "outer").otherwise("auxiliary"), F.when(F.col("bucket") != "outer", F.col("bucket")))
    long = unique.withColumn("in_bucket", F.explode(F.array_compact(groups)))
    sums = lambda rows, *by: rows.groupBy(*by).agg(
        F.count("*").alias("entries"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS],
        F.bool_and(sum((F.col(t).isNull().cast("int") for t in TOKENS), F.lit(0)) == 0).alias("told"),
        F.coalesce(F.sum("reported_cost"), F.lit(0).cast(MONEY)).cast(MONEY).alias("reported_subtotal"), F.bool_or("cost_unknown").alias("unknown"), F.bool_or("estimated").alias("estimated"),
        F.sum("conflicts").alias("bad"))
    named = sums(long, "scope", "in_bucket")
    per_scope = unique.groupBy("scope").agg(F.sum("conflicts").alias("scope_bad"), F.bool_or("cost_unknown").alias("scope_unknown"))
    scopes = per_scope.join(states.withColumnRenamed("scope", "state_scope"), F.col("scope").eqNullSafe(F.col("state_scope")), "full")
    scopes = scopes.select(F.coalesce("scope", "state_scope").alias("scope"), (F.coalesce("collected", F.lit(False)) & (F.coalesce("scope_bad", F.lit(0)) == 0)).alias("complete"),
                           F.coalesce("scope_unknown", F.lit(False)).alias("scope_unknown"))
    grid = scopes.withColumn("in_bucket", F.explode(F.array(*map(F.lit, BUCKETS)))).withColumn("overall", F.lit(False))
    parts = named.withColumn("overall", F.lit(False))
    if overall:
        every = scopes.agg(F.bool_and("complete").alias("complete"), F.bool_or("scope_unknown").alias("scope_unknown")).where("complete IS NOT NULL")
        every = every.select(F.lit(None).cast(grid.schema["scope"].dataType).alias("scope"), "complete", "scope_unknown").withColumn("in_bucket", F.explode(F.array(*map(F.lit, BUCKETS)))).withColumn("overall", F.lit(True))
        grid = grid.unionByName(every)
        # sums of the scopes' sums: nothing is scanned twice
        again = named.groupBy("in_bucket").agg(F.sum("entries").alias("entries"), *[F.sum(t).alias(t) for t in TOKENS], F.bool_and("told").alias("told"),
                                               F.sum("reported_subtotal").cast(MONEY).alias("reported_subtotal"), F.bool_or("unknown").alias("unknown"), F.bool_or("estimated").alias("estimated"), F.sum("bad").alias("bad"))
        parts = parts.unionByName(again.withColumn("scope", F.lit(None).cast(grid.schema["scope"].dataType)).withColumn("overall", F.lit(True)))
    parts = parts.select(F.col("scope").alias("p_scope"), F.col("in_bucket").alias("p_bucket"), F.col("overall").alias("p_overall"), "entries", *TOKENS, "told", "reported_subtotal", "unknown", "estimated")
    out = grid.join(parts, F.col("scope").eqNullSafe(F.col("p_scope")) & (F.col("in_bucket") == F.col("p_bucket")) & (F.col("overall") == F.col("p_overall")), "left")
    unseen = ~F.col("complete") | F.col("in_bucket").isin(*UNSEEN)
    lacking = F.coalesce("unknown", F.lit(False)) | ~F.col("complete") | F.col("scope_unknown") | unseen
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("scope", "overall", F.col("in_bucket").alias("bucket"), zero("entries").alias("entries"), *[zero(t).alias(t) for t in TOKENS],
                      (F.coalesce("told", F.lit(True)) & ~unseen).alias("tokens_complete"), F.coalesce("reported_subtotal", F.lit(0).cast(MONEY)).cast(MONEY).alias("reported_subtotal"),
                      F.when(~lacking, F.coalesce("reported_subtotal", F.lit(0).cast(MONEY)).cast(MONEY)).alias("reported_cost"), lacking.alias("cost_unknown"),
                      F.coalesce("estimated", F.lit(False)).alias("estimated"), unseen.alias("coverage_unknown"), "complete")

