"""Run journals: lines parsed back into records, records folded into attempts.

A journal is append-only text: one JSON object a line, with an `event` name. Every fold here is a plain aggregate, so
the same function serves a table and a stream, combines before it shuffles, and holds no journal in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Events of a run and what they tell (fixed values): an attempt is opened, its batch got an id, an item was delivered,
#: the host broke a rule of coverage, the attempt ended. The last three carry no state of an attempt.
ATTEMPT, BATCH, ITEM, COVERAGE, END = "attempt", "batch", "item", "coverage", "end"
STATELESS = ("attach", "resume", "finish")
FIELDS = {"attempt": "bigint", "label": "string", "keys": "array<string>", "key": "string", "batch_id": "string", "host": "string", "status": "string",
          "problem": "string", "message": "string", "cost": "double", "cost_known": "boolean"}


def replayed(lines: DataFrame, *, journal: str = "journal", number: str = "number", line: str = "line", ended: str = "ended", last: DataFrame | None = None) -> DataFrame:
    """journal, number, event, body (VARIANT), problem, one row per line.

    `ended` says whether the line break was written. An open line at the end of its journal is "torn": it was never
    durable, so it is no record. An open line before others, and a line that is no JSON, is "corrupt"; an object
    without a text `event`, or anything else that is JSON, is "not an event". `last` (journal, number) names the final line of
    each journal; it is counted from `lines` where it isn't given.
    """
    if last is None:
        last = lines.groupBy(F.col(journal).alias("last_journal")).agg(F.max(number).alias("last_number"))
    else:
        last = last.toDF("last_journal", "last_number")
    rows = lines.select(F.col(journal).alias("journal"), F.col(number).alias("number"), F.col(line).alias("line"), F.col(ended).alias("ended"), F.try_parse_json(F.col(line)).alias("body"))
    rows = rows.join(last, F.col("journal").eqNullSafe(F.col("last_journal")))
    event = F.try_variant_get("body", "$.event", "string")
    named = (F.schema_of_variant("body").startswith("OBJECT")) & (F.schema_of_variant(F.try_variant_get("body", "$.event", "variant")) == "STRING")
    problem = (F.when(~F.col("ended") & (F.col("number") == F.col("last_number")), "torn").when(~F.col("ended") | F.col("body").isNull(), "corrupt")
               .when(~F.coalesce(named, F.lit(False)), "not an event"))
    return rows.select("journal", "number", F.when(problem.isNull(), event).alias("event"), F.when(problem.isNull(), F.col("body")).alias("body"), problem.alias("problem"))


def fields(records: DataFrame) -> DataFrame:
    """Records with the fields of run events as typed columns; a field of another type is null."""
    return records.select("journal", "number", "event", *[F.try_variant_get("body", f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()])


def attempts(records: DataFrame, *, host: Column | None = None) -> DataFrame:
    """One row per journal and attempt number, from `fields` of a table or of a stream.

    Planned keys come from the record that opened the attempt, the batch from its first record with a batch id, the end
    from its last. `delivered` counts planned keys with an item, `unplanned` keys outside the plan. `problem` is the
    first reason to refuse the journal: the number was never opened, was opened twice, was used before it was opened,
    plans a key twice, has an item outside the plan, or has an unknown event.

    `status` is how the attempt stands: as its end says; without an end, "no_batch_id" if the host gave none,
    "submit_unknown" if that was never recorded, "stale" if another host (than `host`) submitted it, else "open".
    """
    of = lambda kind, value: F.when(F.col("event") == kind, value)
    kinds = (ATTEMPT, BATCH, ITEM, COVERAGE, END, *STATELESS)
    opened = F.min(of(ATTEMPT, F.struct("number", "label", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))))
    batch = F.min(F.when((F.col("event") == BATCH) & F.col("batch_id").isNotNull(), F.struct("number", "batch_id", "host")))
    end = F.max(of(END, F.struct("number", "status", "problem", "cost", "cost_known")))
    used = F.min(F.when(F.col("event") != ATTEMPT, F.col("number")))
    per = records.where(F.col("attempt").isNotNull() & ~F.coalesce(F.col("event").isin("resume", "finish"), F.lit(False))).groupBy("journal", "attempt").agg(
        opened.alias("o"), batch.alias("b"), end.alias("e"), used.alias("used"), F.collect_set(of(ITEM, F.col("key"))).alias("items"),
        F.count(of(ATTEMPT, F.lit(1))).alias("opened"), F.count(of(BATCH, F.lit(1))).alias("batches"), F.count(of(COVERAGE, F.lit(1))).alias("coverage_errors"),
        F.count_if(~F.col("event").isin(*kinds)).alias("unknown"), F.count("*").alias("records"))
    keys = F.coalesce("o.keys", F.array().cast("array<string>"))
    unplanned = F.size(F.array_except("items", keys)).cast("long")
    problem = (F.when(F.col("opened") == 0, "never opened").when(F.col("opened") > 1, "opened twice").when(F.col("used") < F.col("o.number"), "used before it was opened")
               .when(F.size(F.array_distinct(keys)) < F.size(keys), "a key is planned twice").when(unplanned > 0, "unplanned item").when(F.col("unknown") > 0, "unknown event"))
    elsewhere = ~F.col("b.host").eqNullSafe(host) if host is not None else F.lit(False)
    status = (F.when(F.col("e").isNotNull(), F.col("e.status")).when(F.col("b").isNull(), F.when(F.col("batches") > 0, "no_batch_id").otherwise("submit_unknown"))
              .when(elsewhere, "stale").otherwise("open"))
    return per.select("journal", "attempt", F.col("o.label").alias("label"), F.size(keys).cast("long").alias("planned"), F.size(F.array_intersect("items", keys)).cast("long").alias("delivered"),
                      unplanned.alias("unplanned"), "coverage_errors", F.col("b.batch_id").alias("batch_id"), F.col("b.host").alias("host"), status.alias("status"),
                      F.col("e.cost").alias("cost"), F.coalesce("e.cost_known", F.lit(False)).alias("cost_known"), "records", problem.alias("problem"))


def delivered(records: DataFrame) -> DataFrame:
    """The last item of each key of a journal: a later attempt supersedes earlier ones, a later record earlier ones of its attempt.

    journal, key, attempt, number, message (of that item), attempts (that delivered the key).
    """
    items = records.where((F.col("event") == ITEM) & F.col("key").isNotNull() & F.col("attempt").isNotNull())
    per = items.groupBy("journal", "key", "attempt").agg(F.max(F.struct("number", "message")).alias("m"))  # combined before keys are
    best = per.groupBy("journal", "key").agg(F.max(F.struct("attempt", F.col("m.number").alias("number"), F.col("m.message").alias("message"))).alias("b"), F.count("*").alias("attempts"))
    return best.select("journal", "key", "b.attempt", "b.number", "b.message", "attempts")


def undelivered(records: DataFrame) -> DataFrame:
    """Planned keys that no attempt delivered: journal, key, attempts (that planned it). This is what a resumed run asks again."""
    planned = records.where(F.col("event") == ATTEMPT).select("journal", F.explode(F.array_distinct("keys")).alias("key")).groupBy("journal", "key").agg(F.count("*").alias("attempts"))
    return planned.join(delivered(records).select("journal", "key"), ["journal", "key"], "left_anti")
