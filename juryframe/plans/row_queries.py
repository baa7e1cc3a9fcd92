"""Queries of judging and row-set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from juryframe.functions import answers as A, digest as D, text as T
from juryframe.operators import judge as J, rows as R, shape as S, units as U
from juryframe.plans import sqltext as Q
from juryframe.plans.common import POLICY, RUBRIC, WHOLE, answer_json, doc_states, item_of, judged, of_documents, opinions, results
from juryframe.plans.registry import query
from juryframe.rubric import EDGES
from juryframe.sources.tables import document_lines, document_units, table

c = A.c
QH = RUBRIC.digest()
ROWS = Q.judged(Q.doc_states())
ANSWERS = ', '.join(f'"{n}"' for n in RUBRIC.answer_columns if not n.endswith(".legend"))
ROUTE = "model, selected_model, primary_model, fallback, cache, questions, cached_questions, provenance_unknown"
KNOWN = [n for n in RUBRIC.answer_columns if not n.endswith(".legend")]


@query("judged_rows", f"SELECT id, attempt, state_sha256, error, {ROUTE}, {ANSWERS} FROM {ROWS}")
def judged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Flat result rows of every document after at most one retry."""
    rows = judged(spark, folder)
    return rows.select("id", "attempt", "state_sha256", "error", *[x.strip() for x in ROUTE.split(",")], *[c(n) for n in KNOWN])


_UNITS = f"""SELECT CAST(u.doc_id AS VARCHAR) AS id, u.doc_id AS pos, g.state_sha256, u.r % 3 AS slot, g.head FROM u JOIN g ON g.source = u.source AND g.k = u.r // 3"""
_GROUPED = Q.judged(_UNITS, head="head", own="pos").replace("SELECT st.id, st.pos,", "SELECT st.id, st.slot, st.pos,").replace("SELECT id, pos, state_sha256, attempt, (gone", "SELECT id, slot, pos, state_sha256, attempt, (gone").replace("SELECT id, pos, attempt,", "SELECT id, pos, 's' || slot AS slot, attempt,")


@query("grouped_rows", f"""
WITH u AS (SELECT doc_id, source, text AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE {Q.nonblank('text')}),
g AS (SELECT source, r // 3 AS k, min(doc_id) AS head, sha256('{{"group":' || {Q.json_string('source')} || ',"units":{{' || string_agg('"s' || (r % 3) || '":' || {Q.json_string('t')}, ',' ORDER BY r) || '}}}}') AS state_sha256
  FROM u GROUP BY source, r // 3)
SELECT id, slot, error, {ANSWERS} FROM {_GROUPED}""")
def grouped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of grouped states: one per unit, all in error when the group's delivery failed or any slot does not decode."""
    made, _ = S.group(document_units(spark, folder), by="file", k=3, cap=WHOLE)
    states = made.select("id", "pos", "slots", "state_sha256")
    heads = opinions(spark, folder).select("head", "attempt", F.struct("*").alias("o"))
    own = opinions(spark, folder, faults=False).select(F.col("head").alias("unit"), F.col("attempt").alias("own_attempt"), F.struct("*").alias("a"))
    slots = states.select("id", F.col("pos").alias("head"), F.posexplode("slots").alias("slot", "unit")).withColumn("unit", F.col("unit").cast("bigint"))
    joined = slots.join(heads, "head").join(own, (slots["unit"] == own["unit"]) & (F.col("attempt") == F.col("own_attempt")))
    answer = answer_json(F.col("a").withField("broken", F.col("o.broken")), F.concat(F.lit("s"), F.col("slot").cast("string")))
    per = joined.groupBy(F.col("id").alias("key"), "attempt").agg(F.any_value("o").alias("o"), F.concat_ws(",", F.array_sort(F.collect_list(answer))).alias("answers"))  # three slots at most
    judge = J.TableJudge(per.select("key", "attempt", item_of(F.col("o"), F.col("answers")).alias("item")))
    rows = J.run(states, RUBRIC, judge, grouped=True, width=3)
    return rows.select("id", "slot", "error", *[c(n) for n in KNOWN])


@query("batch_judge_rows", f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, length(text) % 101 * 100 AS v0, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, ' ', '')) AS s FROM documents WHERE {Q.nonblank('text')}),
w AS (SELECT *, (10000 - v0) * (e % 101) // 100 AS v1 FROM t)
SELECT id, NULL AS error, CASE WHEN v0 >= v1 AND v0 >= 10000 - v0 - v1 THEN 'keep' WHEN v1 >= 10000 - v0 - v1 THEN 'revise' ELSE 'drop' END AS verdict, (s * 7 % 10001) / 10000 AS safe FROM w""")
def batch_judge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text judged by a Python function that is called on batches inside the tasks; here it goes by length, letters and spaces."""
    import json

    def ask(batch: list[tuple[str, str]]) -> dict[str, dict]:
        out = {}
        for key, text in batch:
            a = len(text) % 101 * 100
            b = (10000 - a) * (text.count("e") % 101) // 100
            w = {"keep": a, "revise": b, "drop": 10000 - a - b}
            out[key] = {"ok": True, "answers": json.dumps({
                "verdict": {"choice": max(w, key=w.get), "probabilities": {n: v / 10000 for n, v in w.items()}, "confidence": max(w.values()) / 10000},
                "safe": {"bool": text.count(" ") * 7 % 10001 / 10000}, "quality": {"score": 1.0, "confidence": 1.0, "probabilities": None}})}
        return out

    states = doc_states(spark, folder).select("id", "pos", "state_sha256", "state")
    return J.run(states, RUBRIC, J.BatchJudge(ask)).select("id", "error", "verdict", "safe")


@query("run_receipt", f"""
SELECT count(*) AS units, count(*) FILTER (error IS NULL) AS ok, count(error) AS errors, count(*) FILTER (error = 'no result delivered') AS unresolved,
  CAST(2 AS BIGINT) AS served_models, count(*) FILTER (error IS NULL AND model IS NULL) AS served_unknown, count(*) FILTER (cache = 'hit') AS cache_hit,
  count(*) FILTER (cache IS NULL) AS cache_unknown, CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions, CAST(coalesce(sum(cached_questions), 0) AS BIGINT) AS cached_questions,
  count(*) FILTER (questions IS NULL) AS question_counts_unknown, count(*) FILTER (error IS NULL AND fallback) AS fallback_rows,
  (SELECT count(*) FROM documents) - count(*) AS excluded, false AS complete, false AS comparable, false AS provenance_complete, '{QH}' AS qhash FROM {ROWS}""")
def run_receipt(spark: SparkSession, folder: str) -> DataFrame:
    """One row that accounts for every unit of a run."""
    rows = judged(spark, folder)
    blank = document_units(spark, folder).where(~T.nonblank(F.col("text")))
    note = J.receipt(rows, RUBRIC, excluded=blank)
    return note.select("units", "ok", "errors", "unresolved", "served_models", "served_unknown", "cache_hit", "cache_unknown", "questions", "cached_questions",
                       "question_counts_unknown", "fallback_rows", "excluded", "complete", "comparable", "provenance_complete", "qhash")


@query("adopted_rows", f"""
SELECT id, CASE WHEN pos % 5 = 0 AND pos % 7 = 0 THEN 'host failure' WHEN pos % 5 = 0 THEN 'no result delivered'
    WHEN pos % 7 = 0 THEN 'both an answer and a failure were reported' END AS error,
  CASE WHEN pos % 5 <> 0 AND pos % 7 <> 0 THEN verdict END AS verdict, CASE WHEN pos % 5 <> 0 AND pos % 7 <> 0 THEN safe END AS safe, true AS provenance_unknown
FROM {Q.judged(Q.doc_states(), faults=False)}""")
def adopted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Results a host already holds, bound to the submitted states."""
    states = doc_states(spark, folder).select("id", "pos", "state_sha256")
    held = opinions(spark, folder, faults=False).where("attempt = 1").select("head", F.concat(F.lit("{"), answer_json(F.struct("*")), F.lit("}")).alias("answers"))
    given = states.where(F.col("pos") % 5 != 0).join(held, F.col("pos") == F.col("head")).select(F.col("id").alias("key"), "answers")
    failed = states.where(F.col("pos") % 7 == 0).select(F.col("id").alias("key"), F.lit("host failure").alias("error"))
    return J.adopt(states, J.one_item_per_key(given, failed), RUBRIC).select("id", "error", "verdict", "safe", "provenance_unknown")


@query("refused_results", f"""
SELECT CAST(doc_id + 500000000 AS VARCHAR) AS key, CAST(1 AS BIGINT) AS n, 'unexpected key' AS problem FROM documents WHERE doc_id % 10 = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'duplicate key' FROM documents WHERE doc_id % 10 = 2 AND {Q.nonblank('text')}
UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'unexpected key' FROM documents WHERE doc_id % 10 = 2 AND NOT {Q.nonblank('text')}
UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'unexpected key' FROM documents WHERE doc_id % 10 NOT IN (1, 2) AND NOT {Q.nonblank('text')}""")
def refused_results(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered keys nobody planned and keys delivered twice."""
    docs = document_units(spark, folder)
    items = docs.select(F.explode(F.when(F.col("pos") % 10 == 1, F.array((F.col("pos") + 500000000).cast("string")))
                                  .when(F.col("pos") % 10 == 2, F.array("id", "id")).otherwise(F.array("id"))).alias("key"))
    return J.refused_results(doc_states(spark, folder), items)


@query("latest_outcomes", """
WITH p AS (SELECT o_custkey AS key, CAST(o_orderkey AS BIGINT) AS attempt, CASE o_orderstatus WHEN 'F' THEN 'timeout' WHEN 'P' THEN 'cancelled' END AS failure, o_orderkey % 3 <> 0 AS sent FROM orders),
l AS (SELECT p.* FROM p JOIN (SELECT key, max(attempt) AS attempt FROM p GROUP BY key) m USING (key, attempt))
SELECT c_custkey AS key, attempt, CASE WHEN attempt IS NULL THEN 'not submitted before the interruption' WHEN NOT sent THEN coalesce(failure, 'no result delivered') END AS issue
FROM customer LEFT JOIN l ON key = c_custkey""")
def latest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's outcome from the last order that planned it, delivered or not."""
    o = table(spark, folder, "orders")
    planned = o.select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("key"),
                       F.when(F.col("o_orderstatus") == "F", "timeout").when(F.col("o_orderstatus") == "P", "cancelled").alias("failure"))
    delivered = o.where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("key"), F.lit(1).alias("item"))
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    return J.latest_outcomes(planned, delivered, keys).select("key", "attempt", "issue")


TOP = 'greatest("verdict.keep", "verdict.revise", "verdict.drop")'
SECOND = 'list_reverse_sort(["verdict.keep", "verdict.revise", "verdict.drop"])[2]'
VAR = '("quality.dist"[1] * (m * m) + "quality.dist"[2] * ((1 - m) * (1 - m)) + "quality.dist"[3] * ((2 - m) * (2 - m)))'


@query("answer_measures", f"""
SELECT id, {TOP} AS top_probability, round({TOP} - {SECOND}, 9) AS margin, round(1 - abs(2 * safe - 1), 9) AS ambiguity, round(sqrt({VAR}), 9) AS spread,
  verdict AS d_verdict, CASE WHEN safe >= 0.5 THEN 'yes' WHEN safe < 0.5 THEN 'no' END AS d_safe, CAST(CAST(floor(quality + 0.5) AS INTEGER) AS VARCHAR) AS d_quality,
  ({TOP} >= 0.3 AND {TOP} < 0.7) OR safe BETWEEN 0.3 AND 0.7 AS in_band
FROM (SELECT *, "quality.dist"[2] + 2 * "quality.dist"[3] AS m FROM {ROWS}) WHERE error IS NULL""")
def answer_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Uncertainty, decisions and band membership of every answered row."""
    rows = judged(spark, folder).where(F.col("error").isNull())
    v, s, q = (A.measures(n, RUBRIC[n]) for n in RUBRIC)
    return rows.select("id", v["top_probability"].alias("top_probability"), F.round(v["margin"], 9).alias("margin"), F.round(s["ambiguity"], 9).alias("ambiguity"),
                       F.round(q["spread"], 9).alias("spread"), *[A.decision(n, RUBRIC[n]).alias(f"d_{n}") for n in RUBRIC], A.in_band(RUBRIC).alias("in_band"))


REASON = f"""nullif(concat_ws('; ', CASE WHEN {TOP} < 0.5 THEN 'verdict:low_top_probability' END, CASE WHEN round({TOP} - {SECOND}, 9) < 0.1 THEN 'verdict:low_margin' END,
  CASE WHEN safe BETWEEN 0.3 AND 0.7 THEN 'safe:ambiguous_bool' END,
  CASE WHEN "quality.dist" IS NULL THEN 'quality:score_distribution_unavailable' WHEN sqrt({VAR}) > 0.8 THEN 'quality:wide_score' END), '')"""
FLAGS = f"""SELECT id, error, list_filter([CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN error IS NULL THEN 'coverage_incomplete' END,
  CASE WHEN error IS NULL AND provenance_unknown THEN 'provenance_unknown' END, CASE WHEN error IS NULL AND fallback THEN 'fallback:' || selected_model END,
  CASE WHEN error IS NULL THEN {REASON} END, CASE WHEN big THEN 'unmeasured' END], lambda x: x IS NOT NULL) AS why
FROM (SELECT j.*, "quality.dist"[2] + 2 * "quality.dist"[3] AS m, (SELECT octet_length(encode({Q.json_string('text')})) > 32000 FROM documents WHERE doc_id = pos) AS big FROM {ROWS} j)"""


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    states = doc_states(spark, folder)
    rows, _ = J.conclude(J.run(states.select("id", "pos", "state_sha256"), RUBRIC, of_documents(spark, folder)), RUBRIC)
    return R.flag(rows, R.policy_rule(POLICY, RUBRIC), report=states)


@query("flagged_rows", FLAGS)
def flagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that need a look, with all reasons in order."""
    return _flagged(spark, folder).select("id", "error", "why")


@query("flag_reasons", f"SELECT reason, count(*) AS rows FROM (SELECT unnest(why) AS reason FROM ({FLAGS})) GROUP BY reason")
def flag_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per reason."""
    return R.reason_counts(_flagged(spark, folder))


@query("signature_triage", f"""
WITH s AS (SELECT {Q.signature('text')} AS signature FROM {Q.doc_lines()} WHERE {Q.nonblank('text')}),
g AS (SELECT signature, count(*) AS n FROM s GROUP BY signature),
j AS {Q.judged(f"SELECT substr(sha1(signature), 1, 10) AS id, n AS pos, CAST('0x' || substr(sha1(signature), 1, 6) AS BIGINT) % 199 AS head, sha256({Q.json_string('signature')}) AS state_sha256 FROM g", head="head")}
SELECT reason, count(*) AS signatures, CAST(sum(pos) AS BIGINT) AS lines FROM (
  SELECT pos, unnest(list_filter([CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN error IS NULL THEN 'coverage_incomplete' END,
    CASE WHEN error IS NULL AND provenance_unknown THEN 'provenance_unknown' END, CASE WHEN error IS NULL AND fallback THEN 'fallback:stub-b' END], lambda x: x IS NOT NULL)) AS reason FROM j) GROUP BY reason""")
def signature_triage(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: lines to signatures, signatures to the judge, flags counted by reason with the lines they stand for."""
    units = U.line_units(document_lines(spark, folder), order=["doc_id", "line"], examples=0)
    states = units.select("id", F.col("count").alias("pos"), D.text_digest(F.col("signature")).alias("state_sha256"))
    # ids are 40 bits of a hash: among millions of signatures some share one, and such an id is asked for once
    keys = units.select(F.col("id").alias("key")).distinct().withColumn("head", F.conv(F.substring("key", 1, 6), 16, 10).cast("bigint") % 199)
    rows = J.run(states, RUBRIC, results(spark, folder, keys))
    flagged = R.flag(rows).select("pos", F.explode("why").alias("reason"))
    return flagged.groupBy("reason").agg(F.count("*").alias("signatures"), F.sum("pos").alias("lines"))


@query("tally_verdict", f"SELECT coalesce(verdict, 'missing/error') AS bin, count(*) AS rows FROM {ROWS} GROUP BY bin")
def tally_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per label, errors apart."""
    return R.tally(judged(spark, folder), "verdict")


def _bins(value: str, pairs: list[tuple[float, float, str]]) -> str:
    parts = [f"SELECT '{n}' AS bin, count(*) FILTER ({value} >= {a} AND {value} < {b}) AS rows FROM j" for a, b, n in pairs]
    return (f"WITH j AS {ROWS} " + " UNION ALL ".join(parts) +
            f" UNION ALL SELECT 'missing/error', count(*) FILTER ({value} IS NULL) FROM j HAVING count(*) FILTER ({value} IS NULL) > 0")


@query("tally_safe", _bins("safe", [(a, b, f"[{a:g}, {b:g})") for a, b in zip(EDGES, EDGES[1:])]))
def tally_safe(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of P(yes) with the default edges, empty bins kept."""
    return R.tally(judged(spark, folder), "safe")


@query("tally_quality", _bins("quality", [(i - 0.5, i + 0.5, f"level {i}") for i in range(3)]))
def tally_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of weighted levels, bins centred on whole levels."""
    return R.tally(judged(spark, folder), "quality", levels=3)


PILOT = f"""(SELECT *, "quality.dist"[2] + 2 * "quality.dist"[3] AS m FROM {Q.judged(Q.doc_states(), faults=False)})"""


@query("pilot_check", f"""
WITH p AS (SELECT count(*) AS units, count(*) AS answered, count(*) FILTER (fallback OR {REASON} IS NOT NULL) AS flagged, CAST(0 AS BIGINT) AS provenance_only,
  count(*) FILTER (({TOP} >= 0.3 AND {TOP} < 0.7) OR safe BETWEEN 0.3 AND 0.7) AS band, count(*) FILTER (verdict = 'drop') AS catchall_verdict FROM {PILOT})
SELECT *, CAST(0 AS BIGINT) AS errors, flagged / units AS flag_rate, band / answered AS band_rate, catchall_verdict / answered AS catchall_verdict_rate,
  CASE WHEN answered < 10 THEN 'too_small' WHEN flagged / units > 0.4 OR band / answered > 0.4 OR catchall_verdict / answered > 0.4 THEN 'use_direct' ELSE 'proceed' END AS verdict FROM p""")
def pilot_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a full sweep is worth running, from the rates of a pilot."""
    rows = judged(spark, folder, faults=False).withColumn("coverage_complete", F.lit(True))
    return R.pilot_check(rows, RUBRIC, rule=R.policy_rule(POLICY, RUBRIC), catchall={"verdict": ["drop"]})


CHANGED = "text || CASE WHEN doc_id % 3 = 0 THEN ' changed' ELSE '' END"


def changed_text() -> Column:
    return F.concat("text", F.when(F.col("pos") % 3 == 0, " changed").otherwise(""))


@query("reused_rows", f"""
SELECT s.id, s.state_sha256, r.verdict, r.error IS NULL AND r.state_sha256 = s.state_sha256 AS reused FROM ({Q.doc_states(text=CHANGED)}) s LEFT JOIN {ROWS} r ON r.id = s.id
WHERE r.error IS NULL AND r.state_sha256 = s.state_sha256
UNION ALL SELECT s.id, s.state_sha256, NULL, false FROM ({Q.doc_states(text=CHANGED)}) s LEFT JOIN {ROWS} r ON r.id = s.id AND r.error IS NULL AND r.state_sha256 = s.state_sha256 WHERE r.id IS NULL""")
def reused_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier rows that still hold, and states that must be judged."""
    now = doc_states(spark, folder, text=changed_text()).select("id", "state_sha256")
    todo, kept = R.remaining(now, judged(spark, folder), RUBRIC)
    return kept.select("id", "state_sha256", "verdict", F.lit(True).alias("reused")).unionByName(
        todo.select("id", "state_sha256", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("reused")))


def _mixed(a: str, b: str, mod: int, text: str = "text") -> str:
    return (f"(SELECT * FROM {Q.judged(Q.doc_states(where=f'doc_id % {mod} <> 0', text=text), a)} UNION ALL "
            f"SELECT * FROM {Q.judged(Q.doc_states(where=f'doc_id % {mod} = 0', text=text), b)})")


def mixed(spark: SparkSession, folder: str, a: str, b: str, mod: int, text: Column | None = None) -> DataFrame:
    """Rows of two judges: `b` takes every `mod`-th document."""
    st = doc_states(spark, folder, text=text).select("id", "pos", "state_sha256")
    rest = lambda name: F.col(name) % mod != 0
    return J.run(st.where(rest("pos")), RUBRIC, of_documents(spark, folder, a, of=rest("head"))).unionByName(
        J.run(st.where(~rest("pos")), RUBRIC, of_documents(spark, folder, b, of=~rest("head"))))


def _gate_sql(value: str, moved: str) -> str:
    return f"""
WITH b AS (SELECT * FROM {ROWS} WHERE pos % 19 <> 0), a AS (SELECT * FROM {_mixed('a', 'b', 5, CHANGED)} WHERE pos % 23 <> 0), r AS {_mixed('a', 'c', 2, CHANGED)},
x AS (SELECT coalesce(b.id, a.id) AS id, b.{value} AS bv, a.{value} AS av, r.{value} AS rv, b.state_sha256 AS bd, a.state_sha256 AS ad, r.state_sha256 AS rd
  FROM b FULL JOIN a ON a.id = b.id LEFT JOIN r ON r.id = coalesce(b.id, a.id))
SELECT id, CASE WHEN bv IS NULL OR av IS NULL THEN 'unknown' WHEN NOT ({moved.format('bv', 'av')}) THEN CASE WHEN bd <> ad THEN 'source_changed' ELSE 'unchanged' END
  WHEN bd = ad THEN 'noise' WHEN rv IS NULL OR rd <> ad THEN 'unconfirmed' WHEN {moved.format('av', 'rv')} THEN 'noise' ELSE 'regression' END AS class FROM x"""


def _gate(spark: SparkSession, folder: str, qid: str) -> DataFrame:
    before = judged(spark, folder).where(F.col("pos") % 19 != 0)
    after = mixed(spark, folder, "a", "b", 5, changed_text()).where(F.col("pos") % 23 != 0)
    again = mixed(spark, folder, "a", "c", 2, changed_text())
    return R.gate(before, after, RUBRIC, qid=qid, rejudge=again)


@query("regression_gate", _gate_sql("verdict", "{} <> {}"))
def regression_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Two sweeps and a re-judgment: what changed, what is noise, what is a regression."""
    return _gate(spark, folder, "verdict")


@query("regression_gate_score", _gate_sql("quality", "abs({1} - {0}) / 2 > 0.15"))
def regression_gate_score(spark: SparkSession, folder: str) -> DataFrame:
    """The same on a score question, where a move is a share of the level range."""
    return _gate(spark, folder, "quality")


@query("spliced_rows", f"""
SELECT b.id, CASE WHEN p.id IS NULL THEN 'single' ELSE 'spliced-patch' END AS assembly, CASE WHEN p.id IS NULL THEN b.error ELSE p.error END AS error,
  CASE WHEN p.id IS NULL THEN b.verdict ELSE p.verdict END AS verdict, CASE WHEN p.id IS NULL THEN b.safe ELSE p.safe END AS safe
FROM {ROWS} b LEFT JOIN {Q.judged(Q.doc_states(where='doc_id % 4 = 0'), 'b')} p ON p.id = b.id""")
def spliced_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Base rows with re-judged rows put in their place."""
    patch = judged(spark, folder, "b").where(F.col("pos") % 4 == 0)
    return R.splice(judged(spark, folder), patch).select("id", "assembly", "error", "verdict", "safe")


@query("comparable_sweeps", f"""
WITH f AS (SELECT t, count(*) FILTER (error IS NULL AND model IS NULL) AS u, count(DISTINCT model) FILTER (error IS NULL) AS m
  FROM (SELECT 'A' AS t, * FROM {ROWS} UNION ALL SELECT 'B', * FROM {Q.judged(Q.doc_states(), 'b', faults=False)}) GROUP BY t)
SELECT false AS comparable, (SELECT string_agg(r, '; ' ORDER BY t, k) FROM (SELECT t, 1 AS k, t || ': unknown served model' AS r FROM f WHERE u > 0
  UNION ALL SELECT t, 2, t || ': several served models' FROM f WHERE m > 1)) AS reasons""")
def comparable_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """Whether two sweeps measure the same thing."""
    return R.comparable(judged(spark, folder), judged(spark, folder, "b", faults=False))


EXPORTED = [n for n in KNOWN if not n.endswith(".dist")]


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = judged(spark, folder)
    flagged = R.flag(rows)
    hits = rows.where(F.col("pos") % 6 == 0).select("id", F.array(F.lit("house rule"), F.lit("a|b")).alias("reasons"))
    labels = table(spark, folder, "labels")
    labels = labels.withColumnRenamed("quality", "good")
    reviewed = rows.join(labels, F.col("pos") == F.col("doc_id")).select(
        F.col("id").alias("unit"), F.when(F.col("good") == 1, "confirmed").alias("verdict"), F.when(F.col("pos") % 9 == 0, "stale_source").alias("stale"))
    return R.export(rows, flagged, RUBRIC, rule_flags=hits, reviewed=reviewed)


RECORDS = f"""SELECT id, {', '.join(f'"{n}"' for n in EXPORTED)}, error,
  list_filter([CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN error IS NULL THEN 'coverage_incomplete' END, CASE WHEN error IS NULL AND provenance_unknown THEN 'provenance_unknown' END,
    CASE WHEN error IS NULL AND fallback THEN 'fallback:' || selected_model END], lambda x: x IS NOT NULL) AS judge_flag,
  CASE WHEN pos % 6 = 0 THEN ['house rule', 'a|b'] ELSE [] END AS rule_flags,
  CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN pos % 9 = 0 THEN 'stale' WHEN l.good = 1 THEN 'confirmed' ELSE 'pending' END AS review_status,
  'single' AS assembly, left(state_sha256, 12) AS state_sha256 FROM {ROWS} j LEFT JOIN (SELECT doc_id, quality AS good FROM labels) l ON l.doc_id = j.pos"""


@query("export_records", RECORDS)
def export_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per row: answers, judge flags, rule flags, review status, digest."""
    return _records(spark, folder)


@query("export_markdown", f"""
WITH r AS ({RECORDS})
SELECT id, '| ' || concat_ws(' | ', id, coalesce(error, ''), array_to_string(judge_flag, '; '), replace(array_to_string(rule_flags, '; '), '|', '\\|'), review_status, assembly, state_sha256) || ' |' AS markdown FROM r""")
def export_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The same records as Markdown table rows."""
    return R.markdown_rows(_records(spark, folder).select("id", "error", "judge_flag", "rule_flags", "review_status", "assembly", "state_sha256"))


@query("run_report", f"""
WITH j AS {ROWS}
SELECT question, measure, CAST(value AS DOUBLE) AS value FROM (
  SELECT '' AS question, 'units' AS measure, count(*) AS value FROM j UNION ALL SELECT '', 'ok', count(*) FILTER (error IS NULL) FROM j UNION ALL SELECT '', 'errors', count(error) FROM j
  UNION ALL SELECT '', 'fallback', count(*) FILTER (error IS NULL AND fallback) FROM j UNION ALL SELECT '', 'provenance_unknown', count(*) FILTER (error IS NULL AND provenance_unknown) FROM j
  UNION ALL SELECT 'verdict', v, (SELECT count(*) FROM j WHERE verdict = v) FROM (VALUES ('keep'), ('revise'), ('drop')) AS x(v)
  UNION ALL SELECT 'safe', 'yes', count(*) FILTER (safe >= 0.5) FROM j UNION ALL SELECT 'safe', 'answered', count(*) FILTER (error IS NULL) FROM j
  UNION ALL SELECT 'quality', 'mean_level', CAST(sum(CAST(quality AS DECIMAL(38, 6))) AS DOUBLE) / count(*) FILTER (error IS NULL) FROM j)""")
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """Label counts, yes counts, mean levels and row counts in one pass."""
    return R.report(judged(spark, folder), RUBRIC)


@query("answer_stability", f"""
WITH v AS (SELECT 'base' AS variant, * FROM {ROWS} UNION ALL SELECT 'order', * FROM {Q.judged(Q.doc_states(), 'p')} UNION ALL SELECT 'context', * FROM {Q.judged(Q.doc_states(text=CHANGED))}),
l AS (SELECT id, 'verdict' AS question, verdict AS d FROM v UNION ALL SELECT id, 'safe', CASE WHEN safe >= 0.5 THEN 'yes' WHEN safe < 0.5 THEN 'no' END FROM v
  UNION ALL SELECT id, 'quality', CAST(floor(quality + 0.5) AS VARCHAR) FROM v)
SELECT id, question, CASE WHEN count(DISTINCT d) > 1 THEN 'disagree' WHEN count(d) < 3 THEN 'unresolved' ELSE 'stable' END AS status FROM l GROUP BY id, question""")
def answer_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Stability of each answer over a reordered rubric and an added context."""
    return R.stability({"base": judged(spark, folder), "order": judged(spark, folder, "p"), "context": judged(spark, folder, text=changed_text())}, RUBRIC)


STRATA = f"""p AS (SELECT id, pos, "verdict.keep" AS p, CASE {' '.join(f'WHEN "verdict.keep" < {b} THEN {i}' for i, b in enumerate(EDGES[1:]))} END AS stratum FROM {ROWS} WHERE error IS NULL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('11:' || id), id) AS n FROM p) WHERE n <= 20),
o AS (SELECT s.id, s.stratum, CASE l.quality WHEN 1 THEN 'keep' WHEN 0 THEN 'drop' END AS verdict FROM s LEFT JOIN labels l ON l.doc_id = s.pos),
a AS (SELECT stratum, count(verdict) AS calibrated, count(*) FILTER (verdict = 'keep') AS agreed, count(*) FILTER (verdict IS NULL) AS errors FROM o GROUP BY stratum),
b AS (SELECT k AS stratum, coalesce((SELECT count(*) FROM p WHERE p.stratum = k), 0) AS n, coalesce(calibrated, 0) AS calibrated, coalesce(agreed, 0) AS agreed, coalesce(errors, 0) AS errors,
  CASE WHEN calibrated > 0 THEN agreed / calibrated END AS agreement FROM generate_series(0, 5) AS g(k) LEFT JOIN a ON a.stratum = k),
e AS (SELECT *, coalesce(last_value(agreement IGNORE NULLS) OVER (ORDER BY stratum), 0.0) AS estimate FROM b)"""


def _calibration(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = judged(spark, folder)
    pool = R.calibration_pool(rows, RUBRIC, qid="verdict", label="keep")
    sampled = R.calibration_sample(pool)
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    return sampled, *R.calibrate(pool, sampled, labels, agree=["keep"])


@query("calibration_sample", f"WITH {STRATA} SELECT id, p, stratum FROM s")
def calibration_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Up to twenty rows of each probability stratum."""
    return _calibration(spark, folder)[0]


@query("calibration_bins", f"WITH {STRATA} SELECT stratum, n, calibrated, agreed, errors, agreement, estimate FROM e")
def calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the human labels with the judge per stratum; empty strata take the estimate below."""
    return _calibration(spark, folder)[1].select(F.col("stratum").cast("bigint").alias("stratum"), "n", "calibrated", "agreed", "errors", "agreement", "estimate")


@query("calibration_thresholds", f"""
WITH {STRATA} SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS flagged, round(sum(estimate), 6) AS expected_true, round(count(*) - sum(estimate), 6) AS expected_false
FROM (VALUES (0.9), (0.8), (0.7), (0.6), (0.5)) AS x(t) JOIN p ON p.p >= t JOIN e ON e.stratum = p.stratum GROUP BY t""")
def calibration_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Expected right and wrong flags above each threshold."""
    return _calibration(spark, folder)[2].select("threshold", "flagged", F.round("expected_true", 6).alias("expected_true"), F.round("expected_false", 6).alias("expected_false"))
