"""A review inbox: items with frozen identities, decisions in batches, drift, what is still open, and refusals.

The journal of accepted batches is the only source of a verdict. Each state here is a plain aggregate over it, so an
item with very many decisions is folded before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Verdicts of a decision, and reasons for which one no longer counts, by precedence (fixed values).
CONFIRMED, OVERTURNED, UNRESOLVED, PENDING = "confirmed", "overturned", "unresolved", "pending"
VERDICTS = (CONFIRMED, OVERTURNED, UNRESOLVED)
STALE = ("stale_rubric", "stale_policy", "stale_source", "missing_evidence", "stale_evidence")


def state(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """`items` (item, unit, claim, file, fingerprint) with verdict, decisions, last_kind, cited and view.

    `decisions` has batch, place, item, verdict, kind (of reviewer), cited (array of files). The last one by batch and
    place counts; an item without any is pending. `view` is a digest of what a reviewer saw: the frozen item, how many
    decisions it had, and the last. Decisions on unknown items change nothing: see `strangers`.
    """
    # the few fields that count are folded, not the history
    per = decisions.groupBy(F.col("item").alias("d_item")).agg(F.count("*").alias("decisions"), F.max(F.struct("batch", "place", "verdict", "kind", "cited")).alias("last"))
    rows = items.join(per, F.col("item") == F.col("d_item"), "left").drop("d_item").withColumn("decisions", F.coalesce("decisions", F.lit(0)))
    head = F.concat_ws(":", F.col("last.batch").cast("string"), F.col("last.place").cast("string"), F.col("last.verdict"))
    view = F.sha2(F.concat_ws("|", "fingerprint", F.col("decisions").cast("string"), head), 256)
    return rows.select(*[F.col(f"`{c}`") for c in items.columns], F.coalesce("last.verdict", F.lit(PENDING)).alias("verdict"), "decisions", F.col("last.kind").alias("last_kind"), F.col("last.cited").alias("cited"), view.alias("view"))


def strangers(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that make a journal invalid: on items that aren't there, or with no known verdict."""
    known = items.select(F.col("item").alias("k_item"), F.lit(True).alias("known")).distinct()
    out = decisions.join(known, F.col("item") == F.col("k_item"), "left").withColumn("problem", F.when(F.col("known").isNull(), "unknown item").when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict"))
    return out.where("problem IS NOT NULL").select("batch", "place", "item", "problem")


def drifted(rows: DataFrame, changed: DataFrame, *, rubric: bool = False, policy: bool = False, blocked: DataFrame | None = None) -> DataFrame:
    """`rows` of `state` with `stale`: the first reason of STALE, or null.

    `changed` lists files that are no longer what they were, `blocked` items that lack evidence. An item is stale by
    source if its own file changed, and by evidence if its last decision cites a changed file.
    """
    files = changed.select(F.col("file").alias("c_file")).distinct()
    out = rows.join(files, F.col("file") == F.col("c_file"), "left")
    cites = rows.select("item", F.explode("cited").alias("c")).join(files, F.col("c") == F.col("c_file")).select(F.col("item").alias("e_item")).distinct().withColumn("evidence", F.lit(True))
    out = out.join(cites, F.col("item") == F.col("e_item"), "left")
    lacking = F.lit(False)
    if blocked is not None:
        out = out.join(blocked.select(F.col("item").alias("b_item"), F.lit(True).alias("lacks")).distinct(), F.col("item") == F.col("b_item"), "left")
        lacking = F.coalesce("lacks", F.lit(False))
    reason = (F.when(F.lit(rubric), STALE[0]).when(F.lit(policy), STALE[1]).when(F.col("c_file").isNotNull(), STALE[2]).when(lacking, STALE[3]).when(F.col("evidence"), STALE[4]))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], reason.alias("stale"))


def queue(rows: DataFrame) -> DataFrame:
    """Open items of `drifted` with priority (0 pending, 1 decided on evidence that changed, 2 the rest) and `askable`.

    Open is what is pending, unresolved or stale. Only items that aren't stale, or whose evidence alone is, can be asked.
    A batch of questions is `queue(...).where("askable").orderBy("priority", "item").limit(n)`.
    """
    stale = F.col("stale").isNotNull()
    priority = F.when(F.col("verdict") == PENDING, 0).when(F.col("stale") == STALE[4], 1).otherwise(2)
    return rows.where(F.col("verdict").isin(PENDING, UNRESOLVED) | stale).withColumn("priority", priority).withColumn("askable", ~stale | (F.col("stale") == STALE[4]))


def approved_units(rows: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Units all of whose items are confirmed and not stale, less those named `incomplete`."""
    per = rows.groupBy("unit").agg(F.bool_and((F.col("verdict") == CONFIRMED) & F.col("stale").isNull()).alias("ok")).where("ok").select("unit")
    return per if incomplete is None else per.join(incomplete.select("unit").distinct(), "unit", "left_anti")


def summary(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: items, pending, unresolved, confirmed, overturned, stale, changed files, approved units, complete, settled.

    Complete: nothing is pending or unresolved. Settled: besides, nothing is stale and no file changed. An inbox without
    items is complete.
    """
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    one = rows.agg(F.count("*").alias("items"), of(PENDING), of(UNRESOLVED), of(CONFIRMED), of(OVERTURNED), F.count("stale").alias("stale"))
    files = changed.agg(F.count_distinct("file").alias("changed"))
    out = one.crossJoin(files).crossJoin(approved_units(rows).agg(F.count("*").alias("approved_units")))  # one row each
    complete = (F.col("pending") == 0) & (F.col("unresolved") == 0)
    return out.withColumn("complete", complete).withColumn("settled", complete & (F.col("stale") == 0) & (F.col("changed") == 0))


def judged_batch(rows: DataFrame, batch: DataFrame, changed: DataFrame) -> DataFrame:
    """Each decision of one batch with `refusal`, the first reason against it, or null. A batch is appended only if none has one.

    `batch` has place, item, fingerprint, view, verdict, kind, cited. In this order: invalid_decision (no item);
    duplicate_item (the batch has an earlier decision on it); unknown_item; the item's stale reason, other than by
    evidence; protected_decision (an agent after a human); fingerprint_mismatch; superseded (another view);
    invalid_decision (no known verdict); invalid_evidence (a verdict that cites nothing); stale_source (it cites a
    changed file).
    """
    first = batch.where("item IS NOT NULL").groupBy(F.col("item").alias("f_item")).agg(F.min("place").alias("first"))
    held = rows.select(F.col("item").alias("h_item"), F.col("fingerprint").alias("h_fingerprint"), F.col("view").alias("h_view"), "stale", "last_kind")
    files = changed.select(F.col("file").alias("c_file")).distinct()
    # by what is cited, not by place: decisions on different items may share a place
    cites = batch.select("cited").distinct().select("cited", F.explode("cited").alias("c")).join(files, F.col("c") == F.col("c_file")).select(F.col("cited").alias("b_cited")).distinct().withColumn("bad_cite", F.lit(True))
    out = batch.join(first, F.col("item") == F.col("f_item"), "left").join(held, F.col("item") == F.col("h_item"), "left").join(cites, F.col("cited") == F.col("b_cited"), "left")
    refusal = (F.when(F.col("item").isNull(), "invalid_decision").when(F.col("place") > F.col("first"), "duplicate_item").when(F.col("h_item").isNull(), "unknown_item")
               .when(F.coalesce(F.col("stale") != STALE[4], F.lit(False)), F.col("stale")).when((F.col("kind") == "agent") & (F.col("last_kind") == "human"), "protected_decision")
               .when(~F.col("fingerprint").eqNullSafe(F.col("h_fingerprint")), "fingerprint_mismatch").when(~F.col("view").eqNullSafe(F.col("h_view")), "superseded")
               .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "invalid_decision")
               .when((F.col("verdict") != UNRESOLVED) & (F.coalesce(F.size("cited"), F.lit(0)) <= 0), "invalid_evidence").when(F.col("bad_cite"), "stale_source"))
    return out.select(*[F.col(f"`{c}`") for c in batch.columns], refusal.alias("refusal"))


def identity(*parts: Column) -> Column:
    """Fingerprint of what an item froze."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
