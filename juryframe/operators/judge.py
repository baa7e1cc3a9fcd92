"""Judging: providers, one run with a retry, adoption of delivered results, rows and receipts.

No model ships with this package. `TableJudge` takes results from a table, as a host or a batch service leaves them;
`BatchJudge` calls a function of the caller on batches of states inside Spark tasks. A task that is repeated before its
results are written calls that function again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as TY

from juryframe.functions import answers as A
from juryframe.rubric import Rubric
from juryframe.session import written

ROUTE = ("model", "selected_model", "primary_model", "fallback", "response_model", "cache", "questions",
         "cached_questions")
ITEM = TY.StructType([
    TY.StructField("ok", TY.BooleanType()), TY.StructField("error", TY.StringType()),
    TY.StructField("answers", TY.StringType()), TY.StructField("model", TY.StringType()),
    TY.StructField("selected_model", TY.StringType()), TY.StructField("primary_model", TY.StringType()),
    TY.StructField("fallback", TY.BooleanType()), TY.StructField("response_model", TY.StringType()),
    TY.StructField("cache", TY.StringType()), TY.StructField("questions", TY.IntegerType()),
    TY.StructField("cached_questions", TY.IntegerType()),
])
TOO_LARGE = "max_tokens_exceeded"
NOT_DELIVERED = "no result delivered"
TWICE = "delivered more than once"


class TableJudge:
    """Results that a table holds: key, attempt, item. A key without a row in an attempt was not delivered by it.

    An attempt that delivered a key more than once gave no single answer: the item becomes a failure.
    """

    #: Asking again gives the same answers, so nothing has to be written between attempts.
    repeatable = True

    def __init__(self, items: DataFrame):
        self.items = items

    def answer(self, df: DataFrame, rubric: Rubric, attempt: int, wanted: Column, name: str) -> DataFrame:
        given = single_items(self.items.where(F.col("attempt") == attempt)).select(F.col("key").alias("_key"), F.col("item").alias(name))
        joined = df.join(given, F.col("id") == F.col("_key"), "left").drop("_key")
        return joined.withColumn(name, F.when(wanted, F.col(name)))

    def both(self, df: DataFrame) -> DataFrame:
        """`df` with the items of both attempts, `item` and `_second`, from one pass over the table."""
        per = []
        for n, name in ((1, "item"), (2, "_second")):
            at = F.col("attempt") == n
            per += [F.count_if(at).alias(f"_n{n}"), F.first(F.when(at, F.col("item")), ignorenulls=True).alias(name)]
        given = self.items.where(F.col("attempt").isin(1, 2)).groupBy(F.col("key").alias("_key")).agg(*per)
        given = given.select("_key", _single(F.col("_n1"), F.col("item")).alias("item"), _single(F.col("_n2"), F.col("_second")).alias("_second"))
        return df.join(given, F.col("id") == F.col("_key"), "left").drop("_key")


class BatchJudge:
    """`fn(list of (id, state)) -> {id: item dict}` called per Arrow batch. An id it leaves out is not delivered."""

    repeatable = False

    def __init__(self, fn: Callable[[list[tuple[str, str]]], dict[str, dict]]):
        self.fn = fn

    def answer(self, df: DataFrame, rubric: Rubric, attempt: int, wanted: Column, name: str) -> DataFrame:
        fn, fields = self.fn, [f.name for f in ITEM]
        schema = TY.StructType([*df.schema.fields, TY.StructField(name, ITEM)])

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ask = [(i, s) for i, s, w in zip(batch["id"], batch["state"], batch["_wanted"]) if w]
                got = fn(ask) if ask else {}
                items = [{f: got[i].get(f) for f in fields} if w and i in got else None
                         for i, w in zip(batch["id"], batch["_wanted"])]
                out = batch.drop(columns="_wanted")
                out[name] = pd.Series(items, index=batch.index, dtype=object)
                yield out

        return df.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).mapInPandas(call, schema)


def with_good(df: DataFrame, item: str, rubric: Rubric, slots: Column | None, name: str) -> DataFrame:
    """`df` with `good` of an item; its parts are columns of their own on the way."""
    steps = A.Steps(df)
    answers = steps({"a": F.try_parse_json(F.col(item)["answers"])})["a"]
    ok = good(F.col(item), rubric, slots, answers, steps)
    return steps.df.withColumn(name, ok).select(*[F.col(f"`{c}`") for c in df.columns], name)


def good(item: Column, rubric: Rubric, slots: Column | None = None, answers: Column | None = None, keep=A._same) -> Column:
    """A delivered item whose required answers all decode. `slots` is the unit array of a grouped state."""
    answers = F.try_parse_json(item["answers"]) if answers is None else answers
    if slots is None:
        valid = A.all_valid(answers, rubric, keep=keep)
    else:
        valid = F.forall(F.sequence(F.lit(0), F.size(slots) - 1), lambda s: A.all_valid(answers, rubric, s))
    return F.coalesce(item.isNotNull() & item["ok"] & valid, F.lit(False))


def oversize(item: Column) -> Column:
    return F.coalesce(F.contains(item["error"], F.lit(TOO_LARGE)), F.lit(False))


def run(states: DataFrame, rubric: Rubric, judge, *, grouped: bool = False, qhash: str | None = None, width: int = 8) -> DataFrame:
    """Judge every state, once more those that are neither good nor too large, and return one row per unit.

    Rows are written once. The items of a judge that isn't `repeatable` are written after each attempt too, so no state
    is sent again when a consumer reads the rows twice, and only states that need it go through the second attempt.
    `states` needs id, pos, state_sha256, `state` for a BatchJudge and `slots` (array of unit ids) for grouped states;
    `width` is the largest number of slots of a state.
    """
    rubric.check_columns()
    slots = F.col("slots") if grouped else None
    asked = rubric.slotted(width) if grouped else rubric
    table = hasattr(judge, "both")
    one = judge.both(states) if table else judge.answer(states, asked, 1, F.lit(True), "item")
    one = one if getattr(judge, "repeatable", False) else written(one)
    one = with_good(one, "item", rubric, slots, "_ok").withColumn("_again", ~(F.col("_ok") | oversize(F.col("item")))).drop("_ok")
    if not getattr(judge, "repeatable", False):
        two = written(judge.answer(one.where("_again").drop("item"), asked, 2, F.lit(True), "item"))
        out = one.where("NOT _again").withColumn("attempt", F.lit(1)).unionByName(two.withColumn("attempt", F.lit(2)))
    else:
        both = one if table else judge.answer(one, asked, 2, F.col("_again"), "_second")
        out = both.withColumn("item", F.when(F.col("_again"), F.col("_second")).otherwise(F.col("item"))).withColumn("attempt", F.when(F.col("_again"), 2).otherwise(1)).drop("_second")
    return written(to_rows(out.drop("_again"), rubric, grouped=grouped, qhash=qhash))


def to_rows(items: DataFrame, rubric: Rubric, *, grouped: bool = False, qhash: str | None = None) -> DataFrame:
    """Flat result rows from states with their `item` (null when nothing was delivered)."""
    item = F.col("item")
    items = with_good(items, "item", rubric, F.col("slots"), "_good") if grouped else items
    steps = A.Steps(items)
    answers = steps({"a": F.try_parse_json(item["answers"])})["a"]
    if not grouped:
        decoded = {qid: A.decode(answers, qid, question, None, steps) for qid, question in rubric.items()}
        valid = answers.isNotNull()
        for got in decoded.values():
            valid = valid & got.valid
        steps.df = steps.df.withColumn("_good", F.coalesce(item.isNotNull() & item["ok"] & valid, F.lit(False)))
    is_good = F.col("_good")
    base = F.coalesce(item["error"], F.lit("invalid judge answer"))
    failure = (F.when(item.isNull(), NOT_DELIVERED)
               .when(~is_good & oversize(item), F.concat(
                   F.lit("oversize: max_tokens_exceeded; shrink or split this state ("), base, F.lit(")")))
               .when(~is_good, base))
    steps.df = steps.df.withColumn("error", failure)
    keep = [c for c in ("pos", "attempt", "batch_id", "judged_at") if c in items.columns]
    if grouped:
        steps.df = steps.df.select("*", F.posexplode("slots").alias("_slot", "_unit"))
        decoded = {qid: A.decode(answers, qid, question, F.col("_slot"), steps) for qid, question in rubric.items()}
        ident = [F.col("_unit").alias("id"), F.col("id").alias("group"),
                 F.concat(F.lit("s"), F.col("_slot").cast("string")).alias("slot")]
    else:
        ident = [F.col("id")]
    route = [item[name].alias(name) for name in ROUTE]
    columns = []
    for got in decoded.values():
        columns += [F.when(F.col("error").isNull(), col).alias(name) for name, col in got.columns.items()]
    rows = steps.df.select(*ident, *keep, F.lit(qhash or rubric.digest()).alias("qhash"), "state_sha256",
                     F.lit("single").alias("assembly"), *route, "error", *columns)
    return rows.withColumn("provenance_unknown", A.provenance_unknown())


def single_items(items: DataFrame) -> DataFrame:
    """(key, item) with one row per key; a key delivered more than once is a failure, whatever its items say."""
    per = items.groupBy("key").agg(F.count("*").alias("n"), F.any_value("item").alias("one"))
    return per.select("key", _single(F.col("n"), F.col("one")).alias("item"))


def _single(n: Column, one: Column) -> Column:
    nothing = F.lit(None)
    twice = F.struct(F.lit(False).alias("ok"), F.lit(TWICE).alias("error"), *[nothing.cast(f.dataType).alias(f.name) for f in ITEM.fields[2:]]).cast(ITEM)
    return F.when(n > 1, twice).otherwise(one.cast(ITEM))


def adopt(states: DataFrame, items: DataFrame, rubric: Rubric, *, grouped: bool = False) -> DataFrame:
    """Bind delivered results (key, item) to submitted states. A state without a result becomes an error row.

    A result for a key that nobody submitted, and a key delivered twice, stop the job: `refused_results` lists them.
    """
    given = items.groupBy("key").agg(F.count("*").alias("_n"), F.any_value("item").alias("item"))
    joined = states.join(given, F.col("id") == F.col("key"), "full")
    bad = F.when(F.col("id").isNull(), "no state was submitted for ").when(F.col("_n") > 1, "delivered more than once: ")
    # a filter stays in the plan whatever columns a consumer asks for
    joined = joined.where(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("key"))).cast("boolean")).otherwise(F.lit(True)))
    return to_rows(joined.drop("key", "_n"), rubric, grouped=grouped)


def one_item_per_key(answers: DataFrame, failures: DataFrame) -> DataFrame:
    """(key, item) from a table of answers and a table of failures; a key in both becomes a failure.

    A key that is answered twice stays so, for `adopt` and `refused_results` to find; of several failures the least counts.
    """
    a = answers.select("key", F.col("answers").alias("a"))
    f = failures.groupBy("key").agg(F.min("error").alias("e"))
    both = a.join(f, "key", "full_outer")
    error = F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), "both an answer and a failure were reported").otherwise(F.col("e"))
    nothing = F.lit(None)
    item = F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), F.col("a")).alias("answers"),
                    *[nothing.cast(f.dataType).alias(f.name) for f in ITEM.fields[3:]])
    return both.select("key", item.cast(ITEM).alias("item"))


def refused_results(states: DataFrame, items: DataFrame) -> DataFrame:
    """Results nobody asked for, and keys delivered more than once."""
    counts = items.groupBy("key").agg(F.count("*").alias("n"))
    joined = counts.join(states.select(F.col("id").alias("key"), F.lit(True).alias("planned")), "key", "left")
    reason = F.when(F.col("planned").isNull(), "unexpected key").when(F.col("n") > 1, "duplicate key")
    return joined.select("key", "n", reason.alias("problem")).where(F.col("problem").isNotNull())


def receipt(rows: DataFrame, rubric: Rubric, *, excluded: DataFrame | None = None, cost: float | None = None,
            coverage_errors: list[str] | None = None) -> DataFrame:
    """One row that accounts for a run: counts, models, cache, completeness. Counts, not id lists."""
    answered = F.col("error").isNull()
    counts_known = F.coalesce(F.col("questions").isNotNull() & F.col("cached_questions").between(0, F.col("questions")),
                              F.lit(False))
    # One pass over rows; the model table is tiny because models are few.
    by_model = rows.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(answered).alias("ok"), F.count_if(answered & F.col("provenance_unknown")).alias("pu"),
        F.count_if(F.col("provenance_unknown")).alias("pu_all"), F.count_if(F.col("error") == NOT_DELIVERED).alias("lost"),
        *[F.count_if(F.col("cache") == k).alias(k) for k in ("hit", "partial", "miss")],
        F.sum(F.when(counts_known, F.col("questions")).otherwise(0)).alias("q"),
        F.sum(F.when(counts_known, F.col("cached_questions")).otherwise(0)).alias("cq"),
        F.count_if(~counts_known).alias("qu"), F.count_if(answered & (F.col("fallback"))).alias("fb"))
    m = F.col("model")
    total = by_model.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"),
        F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("lost"), F.lit(0)).alias("unresolved"),
        F.count_if(m.isNotNull() & (F.col("ok") > 0)).alias("served_models"),
        F.coalesce(F.sum(F.when(m.isNull(), F.col("ok"))), F.lit(0)).alias("served_unknown"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(f"cache_{k}") for k in ("hit", "partial", "miss")],
        F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("q"), F.lit(0)).alias("questions"),
        F.coalesce(F.sum("cq"), F.lit(0)).alias("cached_questions"),
        F.coalesce(F.sum("qu"), F.lit(0)).alias("question_counts_unknown"),
        F.coalesce(F.sum("fb"), F.lit(0)).alias("fallback_rows"),
        F.coalesce(F.sum("pu"), F.lit(0)).alias("provenance_unknown_answered"),
        (F.coalesce(F.sum("pu_all"), F.lit(0)) == 0).alias("provenance_complete"))
    total = total.withColumn("cache_unknown", F.col("_n") - F.col("cache_hit") - F.col("cache_partial") - F.col("cache_miss"))
    n_excluded = F.lit(0).cast("bigint")
    if excluded is not None:
        total = total.crossJoin(F.broadcast(excluded.agg(F.count("*").alias("excluded"))))  # one row
        n_excluded = F.col("excluded")
    return (total.drop("_n").withColumn("excluded", n_excluded)
            .withColumn("coverage_errors", F.array(*[F.lit(e) for e in coverage_errors or []]).cast("array<string>"))
            .withColumn("complete", (F.col("errors") == 0) & (n_excluded == 0) & F.lit(not coverage_errors))
            .withColumn("comparable", (F.col("served_models") == 1) & (F.col("served_unknown") == 0))
            .withColumn("qhash", F.lit(rubric.digest())).withColumn("cost", F.lit(cost).cast("double"))
            .withColumn("cost_known", F.lit(cost is not None)))


def conclude(rows: DataFrame, rubric: Rubric, **about) -> tuple[DataFrame, DataFrame]:
    """(rows with coverage_complete, receipt). The rows are written once, so no model is asked twice."""
    kept = written(rows)
    note = receipt(kept, rubric, **about)
    flag = note.select(F.col("complete").alias("coverage_complete"))
    return kept.crossJoin(F.broadcast(flag)), note  # one row


def latest_outcomes(planned: DataFrame, delivered: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key's outcome from the latest attempt that planned it, even when that attempt delivered nothing.

    planned(attempt, key, failure), delivered(attempt, key, item). An attempt that delivered a key more than once has no
    single item for it: the issue says so. Repeated keys count once. Aggregates combine on the map side.
    """
    last = planned.groupBy("key").agg(F.max(F.struct("attempt", "failure")).alias("p"))
    one = delivered.groupBy("attempt", "key").agg(F.count("*").alias("_n"), F.any_value("item").alias("item"))
    got = last.select("key", F.col("p.attempt").alias("attempt"), F.col("p.failure").alias("failure")).join(one, ["attempt", "key"], "left")
    out = keys.distinct().join(got, "key", "left")
    issue = (F.when(F.col("attempt").isNull(), "not submitted before the interruption").when(F.col("_n") > 1, TWICE)
             .when(F.col("item").isNull(), F.coalesce("failure", F.lit(NOT_DELIVERED))))
    return out.select("key", "attempt", F.when(F.col("_n") == 1, F.col("item")).alias("item"), issue.alias("issue"))
