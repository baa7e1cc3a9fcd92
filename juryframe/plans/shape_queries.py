"""Queries of shaping: states, groups, packing, plans, samples, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from juryframe.functions import digest as D, text as T
from juryframe.operators import shape as S, units as U
from juryframe.plans import sqltext as Q
from juryframe.plans.common import RUBRIC, WHOLE, cat, doc_states
from juryframe.plans.registry import query
from juryframe.rubric import limits, power
from juryframe.sources.tables import document_units, table

CAP = 600


@query("state_outcomes", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN {Q.nonblank('t')} THEN t END AS state, CASE WHEN {Q.nonblank('t')} THEN 'submitted' ELSE 'dropped' END AS status,
  CASE WHEN NOT {Q.nonblank('t')} THEN 'empty rendered unit' WHEN length(text) > {CAP} THEN 'string fields capped at {CAP} chars' END AS reason,
  CAST(length(text) > {CAP} AS INTEGER) AS truncated, false AS oversize, false AS unmeasured,
  CASE WHEN {Q.nonblank('t')} THEN sha256({Q.json_string('t')}) END AS state_sha256
FROM (SELECT doc_id, text, {Q.capped('text', CAP)} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN ' ' || chr(10) ELSE text END AS text FROM documents))""")
def state_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Capped states with outcome and digest; blank texts are dropped but stay listed."""
    units = document_units(spark, folder).withColumn("text", F.when(F.col("pos") % 37 == 0, " \n").otherwise(F.col("text")))
    return S.states(units, cap=CAP).drop("pos", "file", "lang")


@query("state_sizes", f"""
WITH s AS (SELECT octet_length(encode({Q.json_string('text')})) AS n FROM documents WHERE {Q.nonblank('text')})
SELECT count(*) AS states, count(*) FILTER (n > 32000) AS unmeasured, CAST(sum(n) AS BIGINT) AS bytes, CAST(max(n) AS BIGINT) AS largest FROM s""")
def state_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Byte sizes of whole states; those above the byte bound would need a tokenizer."""
    st = S.states(document_units(spark, folder), cap=WHOLE).where(F.col("status") == "submitted")
    size = F.octet_length(D.json_string(F.col("state")))
    return st.agg(F.count("*").alias("states"), F.count_if("unmeasured").alias("unmeasured"),
                  F.sum(size.cast("bigint")).alias("bytes"), F.max(size.cast("bigint")).alias("largest"))


GROUPED = f"""
u AS (SELECT doc_id, source, text AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE {Q.nonblank('text')}),
g AS (SELECT source, r // 8 + 1 AS chunk, min(doc_id) AS pos, list(CAST(doc_id AS VARCHAR) ORDER BY r) AS slots,
  '{{"group":' || {Q.json_string('source')} || ',"units":{{' || string_agg('"s' || (r % 8) || '":' || {Q.json_string('t')}, ',' ORDER BY r) || '}}}}' AS state
  FROM u GROUP BY source, r // 8)"""


@query("group_states", f"WITH {GROUPED} SELECT source || '#' || chunk AS id, source AS group_key, slots, sha256(state) AS state_sha256 FROM g")
def group_states(spark: SparkSession, folder: str) -> DataFrame:
    """Documents grouped by source in chunks of eight, with slots and state digest."""
    made, _ = S.group(document_units(spark, folder), by="file", k=8, cap=WHOLE)
    return made.select("id", "group_key", "slots", "state_sha256")


@query("conversation_groups", f"""
WITH t AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS c FROM conversations WHERE {Q.nonblank('text')})
SELECT CAST(conv_id AS VARCHAR) || '#' || (c + 1) AS id, count(*) AS units, list(turn ORDER BY turn) AS turns FROM t GROUP BY conv_id, c""")
def conversation_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation in chunks of four."""
    turns = table(spark, folder, "conversations").where(T.nonblank(F.col("text")))
    placed = S.chunks(turns.select("conv_id", "turn"), by="conv_id", pos="turn", k=4)
    rows = placed.groupBy("conv_id", "chunk").agg(F.count("*").alias("units"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("chunk").cast("string")).alias("id"), "units", "turns")


@query("grouping_cover", f"""
WITH s AS (SELECT doc_id FROM documents WHERE {Q.nonblank('text')} AND doc_id % 50 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 2 AND {Q.nonblank('text')}),
e AS (SELECT doc_id FROM documents WHERE NOT {Q.nonblank('text')} OR doc_id % 50 = 3 UNION ALL SELECT -1)
SELECT unit, problem FROM (SELECT CAST(doc_id AS VARCHAR) AS unit, CASE
  WHEN doc_id = -1 THEN 'not an original' WHEN n > 1 THEN 'several slots' WHEN n > 0 AND m > 0 THEN 'placed and excluded' WHEN n + m = 0 THEN 'not accounted for' END AS problem
  FROM (SELECT k.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = k.doc_id) AS n, (SELECT count(*) FROM e WHERE e.doc_id = k.doc_id) AS m
    FROM (SELECT doc_id FROM documents UNION SELECT -1) k)) WHERE problem IS NOT NULL""")
def grouping_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Units that are lost, placed twice, or both placed and excluded."""
    u = document_units(spark, folder)
    full, key = T.nonblank(F.col("text")), F.col("pos") % 50
    slots = u.where(full & (key != 1)).unionByName(u.where(full & (key == 2))).select(F.col("id").alias("unit"))
    stray = u.agg(F.lit("-1").alias("unit"))
    excluded = u.where(~full | (key == 3)).select(F.col("id").alias("unit")).unionByName(stray)
    return S.grouping_problems(u.select(F.col("id").alias("unit")), slots, excluded)


SIZES = {qid: len(text.encode()) for qid, text in RUBRIC.texts().items()}
ALL, (TOTAL, SINGLE) = sum(SIZES.values()), limits(8_000, 4_000)
WORST, LARGEST = max(SIZES.items(), key=lambda kv: kv[1])
REQUESTS = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, b AS state_bytes, CASE WHEN b + {ALL} <= {TOTAL} THEN 'ok' ELSE 'unmeasured' END AS total_status,
  b + {ALL} AS total_upper, '{WORST}' AS worst_question, b + {LARGEST} AS single_upper,
  CASE WHEN b + {ALL} <= {TOTAL} AND b + {LARGEST} <= {SINGLE} THEN 'ok' ELSE 'unmeasured' END AS status
FROM (SELECT doc_id, CAST(octet_length(encode({Q.json_string('text')})) AS INTEGER) AS b FROM documents WHERE {Q.nonblank('text')})"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return S.request_sizes(doc_states(spark, folder), RUBRIC, total=8_000, single=4_000)


@query("request_sizes", REQUESTS)
def request_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Size verdict of the request each document makes."""
    return _requests(spark, folder)


@query("request_plan", f"""
WITH r AS ({REQUESTS})
SELECT CAST(count(*) AS BIGINT) AS requests, CAST(0 AS BIGINT) AS over_budget, count(*) FILTER (status = 'unmeasured') AS unmeasured, quantile_cont(single_upper, 0.5) AS median_upper,
  count(*) FILTER (status = 'unmeasured') = 0 AS admissible, count(*) >= 20 AND quantile_cont(single_upper, 0.5) < 400 AS pack_suggested FROM r""")
def request_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the whole set may be submitted, and whether packing deserves a pilot."""
    return S.plan(_requests(spark, folder), RUBRIC, single=4_000)


PACK_CAP = 3_000


@query("packed_groups", f"""
WITH RECURSIVE u AS (SELECT doc_id, lang, octet_length(encode({Q.json_string('text')})) + 8 AS size, {PACK_CAP} - 40 - octet_length(encode(lang)) AS room
  FROM documents WHERE {Q.nonblank('text')}),
f AS (SELECT lang, doc_id, size, room, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM u WHERE size <= room),
w AS (SELECT lang, doc_id, r, size, room, 1 AS chunk, 0 AS slot, size AS used FROM f WHERE r = 1
  UNION ALL SELECT f.lang, f.doc_id, f.r, f.size, f.room, CASE WHEN w.slot = 3 OR w.used + f.size > f.room THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN w.slot = 3 OR w.used + f.size > f.room THEN 0 ELSE w.slot + 1 END, CASE WHEN w.slot = 3 OR w.used + f.size > f.room THEN f.size ELSE w.used + f.size END
  FROM w JOIN f ON f.lang = w.lang AND f.r = w.r + 1)
SELECT lang, CAST(doc_id AS VARCHAR) AS id, CAST(chunk AS BIGINT) AS chunk, slot, 'placed' AS status FROM w
UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), NULL, NULL, 'one-unit request does not fit' FROM u WHERE size > room""")
def packed_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy packing per language under a byte budget, at most four per group."""
    u = document_units(spark, folder).where(T.nonblank(F.col("text")))
    u = u.select("id", "pos", "lang", (F.octet_length(D.json_string(F.col("text"))) + 8).alias("size"))
    placed, excluded = S.pack(u, by="lang", id="id", pos="pos", size="size", base=F.lit(40) + F.octet_length("lang"), capacity=PACK_CAP,
                              k=4, width=64)
    out = excluded.join(u.select(F.col("id").alias("unit"), "lang"), "unit").select(
        "lang", F.col("unit").alias("id"), F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("int").alias("slot"), F.col("reason").alias("status"))
    return placed.select("lang", "id", "chunk", "slot", F.lit("placed").alias("status")).unionByName(out)


@query("byte_cap_admission", f"""
WITH RECURSIVE u AS (SELECT doc_id, octet_length(encode(text)) AS size, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS doc_id, false AS admitted
  UNION ALL SELECT u.r, CASE WHEN u.size <= 20000 AND w.used + u.size <= 100000 THEN w.used + u.size ELSE w.used END, u.doc_id,
    u.size <= 20000 AND w.used + u.size <= 100000 FROM w JOIN u ON u.r = w.r + 1)
SELECT CAST(doc_id AS VARCHAR) AS id, admitted FROM w WHERE r > 0""")
def byte_cap_admission(spark: SparkSession, folder: str) -> DataFrame:
    """A running byte cap that skips what does not fit and goes on."""
    u = document_units(spark, folder).select("id", "pos", F.octet_length("text").cast("bigint").alias("size"))
    return S.admit_within(u, id="id", pos="pos", size="size", total=100_000, each=20_000).select("id", "admitted")


@query("sampled_units", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ORDER BY sha256('11:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 60")
def sampled_units(spark: SparkSession, folder: str) -> DataFrame:
    """Sixty documents in seeded digest order."""
    return S.sample(document_units(spark, folder)).select("id")


@query("slot_questions", f"""
WITH w AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS k FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS id, q || '@s' || s AS question, s AS slot FROM (SELECT conv_id, unnest(generate_series(0, k - 1)) AS s FROM w), (VALUES {", ".join(f"('{q}')" for q in RUBRIC)}) AS v(q)""")
def slot_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of every group state: slots times questions."""
    width = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("k"))
    slots = width.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("slot"))
    asked = slots.select("*", F.explode(F.array(*[F.lit(q) for q in RUBRIC])).alias("q"))
    return asked.select(F.col("conv_id").cast("string").alias("id"), F.concat("q", F.lit("@s"), F.col("slot").cast("string")).alias("question"),
                        F.col("slot").cast("bigint").alias("slot"))


@query("unit_facts", f"""
WITH u AS (SELECT doc_id, source, lang, n_chars, text FROM documents),
f AS (SELECT *, len({Q.lines('text')}) AS lines, CASE WHEN doc_id % 29 <> 0 THEN 100 / (doc_id % 29) END AS ratio, regexp_matches(text, '@') AS mail FROM u)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(lines AS INTEGER) AS lines, CASE WHEN doc_id % 29 = 0 THEN 'ratio' ELSE '' END AS check_errors,
  CASE WHEN doc_id % 29 <> 0 AND n_chars < 200 THEN 'drop' END AS settled, CASE WHEN doc_id % 29 <> 0 AND n_chars < 200 THEN NULL WHEN doc_id % 13 = 0 THEN 'lang' ELSE '' END AS missing FROM f""")
def unit_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per unit, check errors, rule settlement before any judge, and missing fields."""
    docs = table(spark, folder, "documents").withColumn("lang", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("lang")))
    checks = {"lines": F.size(T.lines(F.col("text"))), "ratio": F.try_divide(F.lit(100), F.col("doc_id") % 29), "mail": F.col("text").rlike("@")}
    got = U.facts(docs, checks, failed={"ratio": F.col("doc_id") % 29 == 0}, settle=F.when(F.col("n_chars") < 200, "drop"), requires={"verdict": ["lang"]})
    return got.select(F.col("doc_id").cast("string").alias("id"), F.col("facts.lines").alias("lines"), F.array_join("check_errors", ",").alias("check_errors"),
                      "settled", F.array_join("missing_verdict", ",").alias("missing"))


@query("canonical_digests", """
SELECT event_id, '{"event":' || to_json(event_type) || ',"k":' || json_extract_string(props, '$.k') || ',"user":' || user_id || '}' AS canonical,
  sha256('{"event":' || to_json(event_type) || ',"k":' || json_extract_string(props, '$.k') || ',"user":' || user_id || '}') AS digest FROM events""")
def canonical_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical JSON of event objects given with other key orders and spaces."""
    e = table(spark, folder, "events")
    raw = cat('{ "user": ', F.col("user_id").cast("string"), ', "k": ', F.get_json_object("props", "$.k"), ', "event": "', F.col("event_type"), '"}')
    return e.select("event_id", D.canonical_json(raw).alias("canonical")).withColumn("digest", D.sha(F.col("canonical")))


@query("strict_json", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":' || user_id || ',"b":[true,null]}' END AS canonical FROM events""")
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    """Strict canonical form: repeated keys, floats and unsafe integers are refused."""
    e, u = table(spark, folder, "events"), F.col("user_id").cast("string")
    raw = (F.when(F.col("event_id") % 4 == 0, cat('{"b": [true, null], "a": ', u, "}")).when(F.col("event_id") % 4 == 1, cat('{"a": 1, "a": ', u, "}"))
           .when(F.col("event_id") % 4 == 2, cat('{"a": ', u, ".5}")).otherwise(cat('{"a": 9007199254740992, "b": ', u, "}")))
    return e.select("event_id", D.strict_canonical_json(raw).alias("canonical"))


@query("sample_power", """
SELECT source, CAST(count(*) AS BIGINT) AS units, CAST(ceil(1.959963984540054 * 1.959963984540054 * r * (1 - r) / (0.1 * 0.1)) AS BIGINT) AS needed
FROM (SELECT *, count(*) FILTER (lang = 'en') OVER (PARTITION BY source) / count(*) OVER (PARTITION BY source) AS r FROM documents) GROUP BY source, r""")
def sample_power(spark: SparkSession, folder: str) -> DataFrame:
    """Units needed per source to estimate its share of English documents within a tenth."""
    from juryframe.rubric import Z_VALUES
    g = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("units"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("r"))
    z, r = Z_VALUES[0.95], F.col("r")
    return g.select("source", "units", F.ceil(F.lit(z) * z * r * (1 - r) / (F.lit(0.1) * 0.1)).alias("needed"))
