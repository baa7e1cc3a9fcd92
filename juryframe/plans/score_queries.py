"""Queries over scores, intervals and usage ledgers made of the given tables, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from juryframe.operators import ledger as L, scoring as S
from juryframe.plans.registry import query
from juryframe.sources.tables import table

#: Labels as the key, verdicts read off the texts: a document with a digit is flagged, a short one cleared, a few aren't mentioned or fail.
KEY = """k AS (SELECT d.source AS "case", d.doc_id AS item, CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE toxic = 1 END AS flag, length(text) AS n, text FROM labels l JOIN documents d USING (doc_id)),
v AS (SELECT *, CASE WHEN n % 19 = 0 OR n IS NULL THEN NULL WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN 'not_mentioned' WHEN regexp_matches(text, '[0-9]') OR n % 3 = 0 THEN 'flagged' ELSE 'cleared' END AS label FROM k)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text", F.length("text").alias("n"))
    flag = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), None).otherwise(F.col("toxic") == 1)
    return table(spark, folder, "labels").join(docs, "doc_id").select(F.col("source").alias("case"), F.col("doc_id").alias("item"), flag.alias("flag"), "n", "text", "quality", "toxic")


@query("item_scores", f"""
WITH {KEY}, a AS (SELECT * FROM v), g AS (SELECT "case", false AS overall, flag, label FROM a UNION ALL SELECT NULL, true, flag, label FROM a),
c AS (SELECT "case", overall, count(*) FILTER (label = 'flagged' AND flag) AS tp, count(*) FILTER (label = 'flagged' AND NOT flag) AS fp, count(*) FILTER (label = 'flagged' AND flag IS NULL) AS unresolved_flags,
  count(*) FILTER (flag AND label IS DISTINCT FROM 'flagged') AS fn, count(*) AS planned_items, count(*) FILTER (flag AND label = 'flagged' OR NOT flag AND label = 'cleared') AS correct,
  count(*) FILTER (flag IS NULL OR label IS NULL) AS unresolved, count(*) FILTER (flag IS NULL) AS key_unresolved, count(*) FILTER (label = 'not_mentioned') AS omitted FROM g GROUP BY ALL)
SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp + unresolved_flags > 0 THEN tp / (tp + fp + unresolved_flags) END AS precision, correct / planned_items AS accuracy FROM c""")
def item_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on toxicity against the labels, for each source and over all."""
    rows, n = labelled(spark, folder), F.col("n")
    said = F.when(n % 11 == 0, S.NOT_MENTIONED).when(F.col("text").rlike("[0-9]") | (n % 3 == 0), S.FLAGGED).otherwise(S.CLEARED)
    verdicts = rows.where(~(n % 7 == 0)).select("case", "item", said.alias("label"))
    # some verdicts come twice and agree
    verdicts = verdicts.unionByName(verdicts.where("label = 'flagged'"))
    return S.item_scores(rows, verdicts, rows.where(n % 19 == 0))


FACETS = """f AS (SELECT "case", item, n, ['supported', 'refuted', 'underdetermined'][n % 3 + 1] AS factual, ['yes', 'no', 'unknown'][n % 5 % 3 + 1] AS introduced,
  CASE WHEN flag THEN ['fix_now', 'defer'] WHEN n % 2 = 0 THEN ['fix_now'] WHEN flag IS NULL THEN ['investigate'] ELSE ['no_action', 'defer'] END AS actions, CASE WHEN n % 4 > 0 THEN 'd' || n % 40 END AS defect FROM k WHERE n IS NOT NULL),
s AS (SELECT *, n % 23 = 0 AS rejected, CASE WHEN n % 23 = 0 OR n % 17 = 0 THEN NULL ELSE ['supported', 'refuted', 'underdetermined', 'omitted'][CASE WHEN n % 4 < 3 THEN n % 3 + 1 ELSE n % 5 % 4 + 1 END] END AS said_factual,
  CASE WHEN n % 23 = 0 OR n % 17 = 0 OR n % 13 = 0 THEN NULL ELSE ['fix_now', 'fix_now', 'defer', 'no_action', 'investigate', 'omitted'][n % 6 + 1] END AS said_action,
  CASE WHEN n % 23 = 0 OR n % 17 = 0 OR n % 9 = 0 THEN NULL ELSE ['yes', 'no', 'unknown', 'omitted'][CASE WHEN n % 7 < 5 THEN n % 5 % 3 + 1 ELSE 4 END] END AS said_introduced FROM f)"""


def facets(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """(key, verdicts, errors, unattributed) of three facets, from labels and the lengths of texts."""
    n = F.col("n")
    pick = lambda labels, i: F.get(F.array(*map(F.lit, labels)), i.cast("int"))
    texts = lambda *x: F.array(*map(F.lit, x))
    rows = labelled(spark, folder).where(n.isNotNull())
    actions = F.when(F.col("flag"), texts("fix_now", "defer")).when(n % 2 == 0, texts("fix_now")).when(F.col("flag").isNull(), texts("investigate")).otherwise(texts("no_action", "defer"))
    key = rows.select("case", "item", pick(S.FACETS["factual"], n % 3).alias("factual"), pick(S.FACETS["introduced"], n % 5 % 3).alias("introduced"), actions.alias("actions"),
                      F.when(n % 4 > 0, F.concat(F.lit("d"), (n % 40).cast("string"))).alias("defect"))
    verdicts = rows.select("case", "item", pick(S.FACETS["factual"], F.when(n % 4 < 3, n % 3).otherwise(n % 5 % 4)).alias("factual"),
                           F.when(n % 13 == 0, "no such label").otherwise(pick(("fix_now", *S.FACETS["action"]), n % 6)).alias("action"), pick(S.FACETS["introduced"], F.when(n % 7 < 5, n % 5 % 3).otherwise(3)).alias("introduced"))
    errors = rows.where(n % 17 == 0).select("case", "item", F.lit(None).cast("string").alias("facet")).unionByName(rows.where(n % 9 == 0).select("case", "item", F.lit("introduced").alias("facet")))
    return key, verdicts, errors, rows.where(n % 23 == 0).select("case", "item")


@query("facet_scores", f"""
WITH {KEY}, {FACETS}, l AS (SELECT "case", rejected, 'factual' AS facet, said_factual AS said, factual = said_factual AS hit, factual = 'underdetermined' AS open, 'underdetermined' AS unsure FROM s
  UNION ALL SELECT "case", rejected, 'action', said_action, list_contains(actions, said_action), list_contains(actions, 'investigate'), 'investigate' FROM s
  UNION ALL SELECT "case", rejected, 'introduced', said_introduced, introduced = said_introduced, introduced = 'unknown', 'unknown' FROM s),
c AS (SELECT "case", facet, count(*) AS planned, count(*) FILTER (hit AND said <> 'omitted') AS correct, count(*) FILTER (said <> 'omitted') AS covered, count(*) FILTER (said = 'omitted') AS omitted,
  count(*) FILTER (said IS NULL AND NOT rejected) AS extraction_errors, count(*) FILTER (said IS NULL AND rejected) AS unattributed, count(*) FILTER (said IS NULL) AS unresolved,
  count(*) FILTER (said = unsure) AS asserted_uncertain, count(*) FILTER (open) AS key_uncertain FROM l GROUP BY ALL)
SELECT *, correct / planned AS accuracy, covered / planned AS coverage FROM c""")
def facet_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three facets of each labelled document scored on denominators of the key."""
    return S.facet_scores(*facets(spark, folder))


@query("repair_scores", f"""
WITH {KEY}, {FACETS}, p AS (SELECT "case", CASE WHEN defect IS NULL THEN 'i' || item ELSE defect END AS g, defect IS NOT NULL AS named, coalesce(said_action = 'fix_now', false) AS selects,
  coalesce(list_contains(actions, 'fix_now') AND factual = 'supported' AND said_factual = 'supported' AND introduced = said_introduced AND said_introduced IN ('yes', 'no'), false) AS warranted,
  list_contains(actions, 'fix_now') AND defect IS NOT NULL AS wanted FROM s),
g AS (SELECT "case", g, named, bool_or(selects) AS selected, coalesce(bool_and(warranted) FILTER (selects), false) AS fine, count(*) FILTER (selects AND NOT warranted) AS unsupported, bool_or(wanted) AS wanted FROM p GROUP BY ALL),
c AS (SELECT "case", count(*) FILTER (wanted) AS planned_defects, count(*) FILTER (selected) AS predicted_defects, count(*) FILTER (selected AND fine AND named) AS tp,
  count(*) FILTER (selected AND NOT (fine AND named)) AS fp, count(*) FILTER (wanted AND NOT (selected AND fine AND named)) AS fn, sum(unsupported)::BIGINT AS unsupported FROM g GROUP BY "case")
SELECT *, CASE WHEN planned_defects > 0 THEN tp / planned_defects END AS recall, CASE WHEN predicted_defects > 0 THEN tp / predicted_defects END AS precision FROM c""")
def repair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Defects that verdicts would fix now: warranted, unwarranted and missed, for each source."""
    return S.repair_scores(*facets(spark, folder))


@query("control_summary", """
WITH r AS (SELECT l_linestatus || l_returnflag AS "case", l_linenumber >= 4 AS final_attempt, CASE WHEN l_discount > 0.02 THEN l_tax < 0.04 END AS correct FROM lineitem),
b AS (SELECT 'overall' AS block, NULL AS "case", correct FROM r UNION ALL SELECT 'final_attempt', NULL, correct FROM r WHERE final_attempt UNION ALL SELECT 'case', "case", correct FROM r)
SELECT block, "case", count(*) AS n, count(correct) AS scored, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 3) AS accuracy FROM b GROUP BY ALL""")
def control_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as control runs: overall, final attempts, and each case; unscored ones stay in the count."""
    lines = table(spark, folder, "lineitem")
    runs = lines.select(F.concat("l_linestatus", "l_returnflag").alias("case"), (F.col("l_linenumber") >= 4).alias("final_attempt"), F.when(F.col("l_discount") > 0.02, F.col("l_tax") < 0.04).alias("correct"))
    return S.control_summary(runs)


#: Two arms (by line status) of runs over cases (suppliers) in groups (return flags); a case of few runs may lack an arm or a value.
MEANS = """r AS (SELECT l_returnflag AS "group", l_linestatus AS arm, l_suppkey AS "case", l_discount AS discount, CASE WHEN l_tax > 0.01 THEN l_tax END AS tax, l_quantity / 50 AS share FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
a AS (SELECT "group", arm, "case", round(avg(discount), 12) AS discount, round(avg(tax), 12) AS tax, round(avg(share), 12) AS share FROM r GROUP BY "group", arm, "case"),
m AS (SELECT "group", arm, "case", 'discount' AS metric, discount AS value FROM a UNION ALL SELECT "group", arm, "case", 'tax', tax FROM a UNION ALL SELECT "group", arm, "case", 'share', share FROM a)"""
INTERVALS = f"""{MEANS}, d AS (SELECT coalesce(a."group", b."group") AS "group", coalesce(a.metric, b.metric) AS metric, round(b.value - a.value, 9) AS d FROM (SELECT * FROM m WHERE arm = 'F') a FULL JOIN (SELECT * FROM m WHERE arm = 'O') b ON a."group" = b."group" AND a.metric = b.metric AND a."case" = b."case"),
s AS (SELECT "group", metric, count(d) AS n, count(*) - count(d) AS unpaired, avg(d) AS mean, var_samp(d) AS var FROM d GROUP BY ALL),
t AS (SELECT *, CASE WHEN n > 31 THEN 1.96::DOUBLE WHEN n >= 2 THEN [{", ".join(f"{x}::DOUBLE" for x in S.T_95)}][n - 1] END AS t FROM s),
i AS (SELECT "group", metric, n, unpaired, round(mean, 9) AS mean_delta, CASE WHEN n >= 2 THEN n - 1 END AS df, t AS t_critical, round(mean - t * sqrt(var / n), 9) AS low, round(mean + t * sqrt(var / n), 9) AS high FROM t)"""


def arm_intervals(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"))
    runs = lines.select(F.col("l_returnflag").alias("group"), F.col("l_linestatus").alias("arm"), F.col("l_suppkey").alias("supplier"), F.col("l_discount").alias("discount"),
                        F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("tax"), (F.col("l_quantity") / 50).alias("share"))
    means = S.case_means(runs, ["discount", "tax", "share"], case="supplier", by=["group", "arm"], digits=12)
    return S.paired_intervals(means.where("arm = 'F'"), means.where("arm = 'O'"), by=["group", "metric"], digits=9)


@query("paired_intervals", f"WITH {INTERVALS} SELECT * FROM i")
def paired_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Mean differences of two arms over suppliers as cases, with t intervals, for each group and metric."""
    return arm_intervals(spark, folder)


@query("threshold_choice", f"""
WITH {INTERVALS}, w AS (SELECT "group", max(n) FILTER (metric = 'discount') AS cn, max(low) FILTER (metric = 'discount') AS cl, max(high) FILTER (metric = 'discount') AS ch,
  max(n) FILTER (metric = 'share') AS vn, max(low) FILTER (metric = 'share') AS vl, max(high) FILTER (metric = 'share') AS vh, max(n) FILTER (metric = 'tax') AS un, max(low) FILTER (metric = 'tax') AS ul, max(high) FILTER (metric = 'tax') AS uh FROM i GROUP BY "group")
SELECT "group", CASE WHEN cl IS NULL OR vl IS NULL OR ul IS NULL OR least(cn, vn, un) < 5 THEN 'inconclusive' WHEN ul > 0.01 OR ch < 0 OR vh < -0.05 THEN 'contradicts_candidate' WHEN cl >= -0.01 AND vl >= -0.05 AND uh <= 0.01 THEN 'supports_candidate' ELSE 'inconclusive' END AS verdict,
  CASE WHEN cl IS NULL OR vl IS NULL OR ul IS NULL THEN 'a metric has no interval' WHEN least(cn, vn, un) < 5 THEN 'too few cases' WHEN ul > 0.01 THEN 'unsafe rises beyond chance' WHEN ch < 0 OR vh < -0.05 THEN 'correctness or coverage falls beyond chance'
  WHEN NOT (cl >= -0.01 AND vl >= -0.05 AND uh <= 0.01) THEN 'the intervals do not clear the rule' END AS reason FROM w""")
def threshold_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of a declared rule on the intervals of each group."""
    roles = {"correctness": "discount", "coverage": "share", "unsafe": "tax"}
    return S.threshold_choice(arm_intervals(spark, folder), roles, by=["group"], min_cases=5, correctness_min_delta=-0.01, coverage_max_regression=0.05, unsafe_max_increase=0.01)


#: Events as calls: a user is a scope, sign-ups are outer calls, the rest auxiliary ones; ids repeat, and some repeats differ.
CALLS = """u AS (SELECT event_id, user_id::VARCHAR AS scope, CASE WHEN event_type = 'signup' THEN 'outer' ELSE 'auxiliary' END AS origin, json_extract_string(props, '$.k')::BIGINT AS k, event_type, value FROM events),
e AS (SELECT event_id, scope, origin, k, CASE WHEN origin = 'outer' THEN 'outer' WHEN event_type IN ('click', 'view') THEN 'judgment' WHEN event_type = 'purchase' THEN 'completion' ELSE 'other' END AS bucket,
  CASE WHEN k % 10 > 0 THEN k * 10 END AS input, k AS output, CASE WHEN event_type <> 'purchase' THEN k // 2 END AS cache_read, 0::BIGINT AS cache_write, event_type, k % 17 = 0 AS lost,
  CASE WHEN k % 13 > 0 THEN (k * 3 + CASE WHEN value > 30 AND k % 29 = 0 THEN 1 ELSE 0 END) / 100 END AS cost FROM u WHERE k % 31 > 0),
x AS (SELECT *, lost OR cost IS NULL OR event_type = 'error' AND k = 0 AS cost_unknown, hash(event_type, cost, k) AS payload FROM e),
f AS (SELECT *, first_value(payload) OVER w AS head, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY scope, origin, k ORDER BY event_id)),
q AS (SELECT scope, origin, k, count(*) FILTER (payload <> head) AS conflicts FROM f GROUP BY ALL), y AS (SELECT f.*, conflicts FROM f JOIN q USING (scope, origin, k) WHERE r = 1)"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    k, kind = F.col("k"), F.col("event_type")
    rows = e.withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "long"))
    purpose = F.when(kind == "click", "judge").when(kind == "view", "judge_batch").when(kind == "purchase", "eval_completion").when(kind == "error", "retry")
    cost = F.when(k % 13 > 0, (k * 3 + F.when((F.col("value") > 30) & (k % 29 == 0), 1).otherwise(0)) / 100)
    return rows.select(F.col("user_id").cast("string").alias("scope"), F.when(kind == "signup", "outer").otherwise("auxiliary").alias("origin"), F.when(k % 31 > 0, k.cast("string")).alias("id"), F.col("event_id").alias("order"),
                       purpose.alias("purpose"), F.when(kind == "error", "error").otherwise("stop").alias("stop_reason"), F.when(k % 10 > 0, k * 10).alias("input"), k.alias("output"),
                       F.when(kind != "purchase", F.floor(k / 2)).alias("cache_read"), F.lit(0).cast("long").alias("cache_write"), cost.alias("cost"), (k % 17 == 0).alias("cost_unknown"), F.lit(None).cast("boolean").alias("estimated"))


@query("usage_conflicts", f"WITH {CALLS} SELECT scope, origin, k::VARCHAR AS id, conflicts FROM y WHERE conflicts > 0")
def usage_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one scope, origin and id whose repeats differ from the first."""
    return L.conflicts(L.entries(calls(spark, folder)))


@query("usage_rollup", f"""
WITH {CALLS}, n AS (SELECT *, false AS overall FROM y UNION ALL SELECT * REPLACE (NULL AS scope), true FROM y),
b AS (SELECT *, unnest(['total', CASE WHEN bucket = 'outer' THEN 'outer' ELSE 'auxiliary' END, CASE WHEN bucket <> 'outer' THEN bucket END]) AS b FROM n),
s AS (SELECT scope, overall, b, count(*) AS entries, coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, coalesce(sum(cache_read), 0)::BIGINT AS cache_read, coalesce(sum(cache_write), 0)::BIGINT AS cache_write,
  bool_and(input IS NOT NULL AND cache_read IS NOT NULL) AS told, coalesce(sum(CASE WHEN NOT cost_unknown THEN cost::DECIMAL(28, 9) END), 0) AS known, bool_or(cost_unknown) AS unknown FROM b WHERE b IS NOT NULL GROUP BY ALL),
c AS (SELECT user_id::VARCHAR AS scope, bool_and(value < 60) AS collected FROM events GROUP BY 1), h AS (SELECT scope, sum(conflicts) AS bad, bool_or(cost_unknown) AS unknown FROM y GROUP BY scope),
z AS (SELECT scope, false AS overall, collected AND coalesce(bad, 0) = 0 AS complete, coalesce(unknown, false) AS scope_unknown FROM c FULL JOIN h USING (scope)),
a AS (SELECT * FROM z UNION ALL SELECT NULL, true, bool_and(complete), bool_or(scope_unknown) FROM z), g AS (SELECT a.*, unnest(['outer', 'judgment', 'completion', 'other', 'auxiliary', 'total']) AS bucket FROM a),
o AS (SELECT g.*, s.* EXCLUDE (scope, overall, b), NOT complete OR bucket IN ('completion', 'auxiliary', 'total') AS coverage_unknown FROM g LEFT JOIN s ON g.scope IS NOT DISTINCT FROM s.scope AND g.overall = s.overall AND g.bucket = s.b)
SELECT scope, overall, bucket, coalesce(entries, 0) AS entries, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(cache_read, 0) AS cache_read, coalesce(cache_write, 0) AS cache_write, coalesce(told, true) AND NOT coverage_unknown AS tokens_complete,
  coalesce(known, 0)::DOUBLE AS reported_subtotal, CASE WHEN NOT (coalesce(unknown, false) OR NOT complete OR scope_unknown OR coverage_unknown) THEN coalesce(known, 0)::DOUBLE END AS reported_cost,
  coalesce(unknown, false) OR NOT complete OR scope_unknown OR coverage_unknown AS cost_unknown, coalesce(entries, 0) > 0 AS estimated, coverage_unknown, complete FROM o""")
def usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and costs of each user and bucket and of all users, with what is unknown kept apart from zero."""
    states = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("scope")).agg(F.when(F.max("value") < 60, "complete").otherwise("incomplete").alias("status"))
    out = L.totals(L.first_entries(L.entries(calls(spark, folder))), states)
    return out.withColumns({c: F.col(c).cast("double") for c in ("reported_subtotal", "reported_cost")})
