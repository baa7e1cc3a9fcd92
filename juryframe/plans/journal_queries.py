"""Queries over journals made of the event table, and over saved runs, with the SQL each is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from juryframe.operators import journal as J
from juryframe.operators.ordered import run_of, with_running
from juryframe.plans.registry import query
from juryframe.session import checkpoint_dir
from juryframe.sources import runs as R
from juryframe.sources.tables import table

#: Each user's events as a journal: sign-ups open attempts, views are batches, clicks items, errors coverage errors, purchases ends.
KINDS = {"signup": "attempt", "view": "batch", "click": "item", "error": "coverage", "purchase": "end"}
E = f"""e AS (SELECT event_id AS number, user_id::VARCHAR AS journal, value, json_extract_string(props, '$.k')::INT AS k,
  CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS event,
  sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS n FROM events),
r AS (SELECT journal, number, event, k, CASE WHEN event = 'attempt' THEN n ELSE n - k % 2 END AS attempt, CASE WHEN event = 'attempt' THEN [i::VARCHAR FOR i IN generate_series(k % 5, 99, 5)] END AS keys,
  CASE WHEN event = 'item' THEN k::VARCHAR END AS key, CASE WHEN event = 'batch' AND value >= 10 THEN 'b' || number END AS batch_id, CASE WHEN event = 'batch' THEN 'h' || (k % 2) END AS host,
  CASE WHEN event = 'end' THEN CASE WHEN value < 20 THEN 'failed' ELSE 'done' END END AS status, CASE WHEN event = 'end' THEN value END AS cost, k % 3 = 0 AS cost_known, 'm' || k AS message FROM e)"""


def journal_lines(spark: SparkSession, folder: str, damage: bool = False) -> DataFrame:
    """journal, number, line, ended: the events of each user as lines of a journal; with `damage`, some cut or without an event."""
    e = table(spark, folder, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    rows = e.select(F.col("user_id").cast("string").alias("journal"), F.col("event_id").alias("number"), "value", k.alias("k"), kind.alias("event"))
    rows = with_running(rows, ["journal"], [F.col("number")], run_of(F.col("number")), sums={"n": (F.col("event") == "attempt").cast("long")})
    of = lambda name, value: F.when(F.col("event") == name, value)
    text = F.col("k").cast("string")
    parts = {
        "event": F.col("event"), "attempt": F.when(F.col("event") == "attempt", F.col("n")).otherwise(F.col("n") - F.col("k") % 2),
        "keys": of("attempt", F.transform(F.sequence(F.col("k") % 5, F.lit(99), F.lit(5)), lambda i: i.cast("string"))), "key": of("item", text),
        "batch_id": of("batch", F.when(F.col("value") >= 10, F.concat(F.lit("b"), F.col("number").cast("string")))), "host": of("batch", F.concat(F.lit("h"), (F.col("k") % 2).cast("string"))),
        "status": of("end", F.when(F.col("value") < 20, "failed").otherwise("done")), "cost": of("end", F.col("value")), "cost_known": F.col("k") % 3 == 0, "message": F.concat(F.lit("m"), text)}
    line = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    if damage:
        line = F.when(F.col("k") == 7, F.substring(line, 1, 12)).when(F.col("k") == 8, F.replace(line, F.lit('"event":'), F.lit('"kind":'))).when(F.col("k") == 9, F.lit("[1, 2]")).otherwise(line)
    return rows.select("journal", "number", line.alias("line"), (~F.lit(damage) | (F.col("k") % 4 > 0)).alias("ended"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return J.fields(J.replayed(journal_lines(spark, folder)).where("problem IS NULL"))


@query("journal_replay", f"""
WITH {E}, l AS (SELECT *, max(number) OVER (PARTITION BY journal) AS last FROM r)
SELECT journal, number, CASE WHEN p IS NULL THEN event END AS event, p AS problem FROM (SELECT *, CASE WHEN k % 4 = 0 AND number = last THEN 'torn' WHEN k % 4 = 0 OR k = 7 THEN 'corrupt' WHEN k IN (8, 9) THEN 'not an event' END AS p FROM l)""")
def journal_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of damaged journals: records, torn tails, corrupt lines and lines that are no events."""
    return J.replayed(journal_lines(spark, folder, damage=True)).select("journal", "number", "event", "problem")


@query("attempt_state", f"""
WITH {E}, o AS (SELECT journal, attempt, keys, number FROM r WHERE event = 'attempt'),
i AS (SELECT DISTINCT r.journal, r.attempt, key FROM r WHERE event = 'item'),
d AS (SELECT i.journal, i.attempt, count(*) FILTER (coalesce(list_contains(o.keys, key), false)) AS delivered, count(*) FILTER (NOT coalesce(list_contains(o.keys, key), false)) AS unplanned FROM i LEFT JOIN o USING (journal, attempt) GROUP BY ALL),
a AS (SELECT journal, attempt, count(*) AS records, count(*) FILTER (event = 'coverage') AS coverage_errors, count(*) FILTER (event = 'batch') AS batches, count(*) FILTER (event = 'attempt') AS opened,
  arg_min(batch_id, number) FILTER (batch_id IS NOT NULL) AS batch_id, arg_min(host, number) FILTER (batch_id IS NOT NULL) AS host, min(number) FILTER (event <> 'attempt') AS used,
  arg_max(status, number) FILTER (event = 'end') AS ended, arg_max(cost, number) FILTER (event = 'end') AS cost, arg_max(cost_known, number) FILTER (event = 'end') AS cost_known FROM r GROUP BY ALL)
SELECT a.journal, a.attempt, coalesce(len(o.keys), 0)::BIGINT AS planned, coalesce(delivered, 0) AS delivered, coalesce(unplanned, 0) AS unplanned, coverage_errors, batch_id, host,
  CASE WHEN ended IS NOT NULL THEN ended WHEN batch_id IS NULL THEN CASE WHEN batches > 0 THEN 'no_batch_id' ELSE 'submit_unknown' END WHEN host <> 'h0' THEN 'stale' ELSE 'open' END AS status,
  cost, coalesce(cost_known, false) AS cost_known, records,
  CASE WHEN opened = 0 THEN 'never opened' WHEN used < o.number THEN 'used before it was opened' WHEN unplanned > 0 THEN 'unplanned item' END AS problem
FROM a LEFT JOIN o USING (journal, attempt) LEFT JOIN d USING (journal, attempt)""")
def attempt_state(spark: SparkSession, folder: str) -> DataFrame:
    """How each attempt of each journal stands, and why a journal must be refused."""
    return J.attempts(records(spark, folder), host=F.lit("h0")).drop("label")


@query("delivered_items", f"""
WITH {E}, i AS (SELECT journal, key, attempt, number, message FROM r WHERE event = 'item')
SELECT journal, key, max(attempt) AS attempt, arg_max(number, (attempt, number)) AS number, arg_max(message, (attempt, number)) AS message, count(DISTINCT attempt) AS attempts FROM i GROUP BY journal, key""")
def delivered_items(spark: SparkSession, folder: str) -> DataFrame:
    """The item that counts for each key of a journal, after attempts that supersede each other."""
    return J.delivered(records(spark, folder))


@query("undelivered_keys", f"""
WITH {E}, p AS (SELECT journal, unnest(keys) AS key FROM r WHERE event = 'attempt')
SELECT journal, key, count(*) AS attempts FROM p WHERE (journal, key) NOT IN (SELECT (journal, key) FROM r WHERE event = 'item') GROUP BY ALL""")
def undelivered_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Planned keys that a resumed run has to ask again."""
    return J.undelivered(records(spark, folder))


def labelled_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, units, excluded): documents with text are units, labels their answers; a unit without a label failed, one in no language is excluded."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels").withColumnRenamed("doc_id", "labelled")
    joined = docs.join(labels, docs["doc_id"] == labels["labelled"], "left")
    rows = joined.where("lang <> 'de'").select(F.col("doc_id").alias("id"), "quality", "toxic", F.when(F.col("labelled").isNull(), "no label").alias("error"))
    return rows, docs.select(F.col("doc_id").alias("id")), docs.where("lang = 'de'").select(F.col("doc_id").alias("id"))


@query("saved_run", """
SELECT d.doc_id AS id, CASE WHEN lang = 'de' THEN 'excluded' WHEN l.doc_id IS NULL THEN 'failed' ELSE 'answered' END AS outcome,
  CASE WHEN lang <> 'de' THEN quality END AS quality, CASE WHEN lang <> 'de' THEN toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def saved_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run of labels written with its inventory and manifest, and read back whole."""
    rows, units, excluded = labelled_run(spark, folder)
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    rows, held = R.load(spark, R.save(rows, R.inventory(rows, units, excluded=excluded), path, note="labels"))
    return held.join(rows, "id", "left").select("id", "outcome", "quality", "toxic")


@query("run_partition", """
WITH d AS (SELECT doc_id, lang, n_chars FROM documents), h AS (SELECT doc_id AS id, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN lang = 'de' THEN 'excluded' WHEN n_chars % 2 = 0 THEN 'answered' ELSE 'failed' END AS outcome FROM d UNION ALL SELECT doc_id, 'answered' FROM d WHERE n_chars % 11 = 0),
r AS (SELECT doc_id AS id, toxic = 1 AS failed FROM labels UNION ALL SELECT doc_id, false FROM labels WHERE toxic = 1 UNION ALL SELECT -1 - doc_id, true FROM labels WHERE quality = 0),
s AS (SELECT id, count(*) AS n, bool_or(failed) AS failed FROM r GROUP BY id), l AS (SELECT id, count(*) AS times, min(outcome) AS outcome FROM h GROUP BY id),
b AS (SELECT coalesce(s.id, l.id) AS id, coalesce(n, 0) AS n, failed, times, outcome FROM s FULL JOIN l ON s.id = l.id)
SELECT id, problem FROM (SELECT id, CASE WHEN times > 1 THEN 'listed more than once' WHEN times IS NOT NULL AND outcome IS NULL THEN 'no outcome' WHEN n > 1 THEN 'more than one row' WHEN times IS NULL THEN 'not in the inventory'
  WHEN n = 0 AND outcome <> 'excluded' THEN 'no row' WHEN n > 0 AND outcome = 'excluded' THEN 'excluded unit has a row' WHEN n > 0 AND outcome <> CASE WHEN failed THEN 'failed' ELSE 'answered' END THEN 'outcome differs from its row' END AS problem FROM b) WHERE problem IS NOT NULL""")
def run_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Labels held against an inventory of documents that does not fit them: every way a partition can fail."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    n = F.col("n_chars")
    outcome = F.when(n % 7 == 0, None).when(F.col("lang") == "de", R.EXCLUDED).when(n % 2 == 0, R.ANSWERED).otherwise(R.FAILED)
    held = docs.select(F.col("doc_id").alias("id"), outcome.alias("outcome")).unionByName(docs.where(n % 11 == 0).select(F.col("doc_id").alias("id"), F.lit(R.ANSWERED).alias("outcome")))
    row = lambda rows, id, error: rows.select(id.alias("id"), error.alias("error"))
    rows = row(labels, F.col("doc_id"), F.when(F.col("toxic") == 1, "toxic")).unionByName(row(labels.where("toxic = 1"), F.col("doc_id"), F.lit(None).cast("string")))
    rows = rows.unionByName(row(labels.where("quality = 0"), -1 - F.col("doc_id"), F.lit("poor")))
    return R.partition_problems(rows, held)
