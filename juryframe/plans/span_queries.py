"""Queries over line spans, citations and occurrences of quotes, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from juryframe.functions import digest as D, text as T
from juryframe.operators import occurrences as O, shape as S, spans as P
from juryframe.plans import sqltext as Q
from juryframe.plans.registry import query
from juryframe.sources.tables import document_lines, document_units, table

#: Lines with a digit open a span that reaches as many lines further as their length says, at most to the end.
SPANS = (f"(SELECT doc_id AS file, line AS start, least(line + length(text) % 7, n) AS stop FROM "
         f"(SELECT *, max(line) OVER (PARTITION BY doc_id) AS n FROM {Q.doc_lines()}) WHERE regexp_matches(text, '[0-9]'))")


def numbered_spans(spark: SparkSession, folder: str) -> DataFrame:
    """file, start, stop of the spans that lines with a digit open. The lines of a document stay in its row."""
    rows = table(spark, folder, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    opened = F.filter(F.transform("l", lambda t, i: F.struct((i + 1).alias("start"), F.least(i + 1 + F.length(t) % 7, F.size("l")).alias("stop"), t.rlike("[0-9]").alias("digit"))), lambda s: s["digit"])
    return rows.select(F.col("doc_id").alias("file"), F.explode(opened).alias("s")).select("file", "s.start", "s.stop")


@query("span_coverage", f"""
WITH s AS {SPANS}, p AS (SELECT doc_id AS file, line FROM {Q.doc_lines()} WHERE text LIKE '%.'),
c AS (SELECT file, line, EXISTS (SELECT 1 FROM s WHERE s.file = p.file AND p.line BETWEEN s.start AND s.stop) AS covered FROM p)
SELECT file, count(*) AS points, count(*) FILTER (covered) AS covered FROM c GROUP BY file""")
def span_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, how many lines that end in a full stop lie in a span opened by a line with a digit."""
    points = document_lines(spark, folder).where(F.col("text").endswith(".")).select(F.col("doc_id").alias("file"), "line")
    return P.covered(points, numbered_spans(spark, folder)).groupBy("file").agg(F.count("*").alias("points"), F.count_if("covered").alias("covered"))


@query("span_places", f"""
WITH s AS {SPANS}, f AS (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s)
SELECT file, CASE WHEN far >= stop THEN 'inside' WHEN far >= start THEN 'overlap' WHEN far + 1 = start THEN 'adjacent' ELSE 'apart' END AS place, count(*) AS spans
FROM f GROUP BY ALL""")
def span_places(spark: SparkSession, folder: str) -> DataFrame:
    """How the spans of each document lie to those before them."""
    return P.placed(numbered_spans(spark, folder)).groupBy("file", "place").agg(F.count("*").alias("spans"))


ISLANDS = f"""s AS {SPANS}, f AS (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, stop, coalesce(start > far + 1, true) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM f),
m AS (SELECT file, i, min(start) AS start, max(stop) AS stop, count(*) AS spans FROM g GROUP BY file, i)"""


@query("merged_spans", f"WITH {ISLANDS} SELECT file, start, stop, spans FROM m")
def merged_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Islands of spans that overlap or touch."""
    return P.merged(numbered_spans(spark, folder))


_KEPT = rf"regexp_extract_all(text, '([^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]*(?:{Q.BREAK})|[^\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+)')"


@query("deletion_plan", f"""
WITH {ISLANDS}, d AS (SELECT doc_id AS file, {_KEPT} AS l FROM documents WHERE doc_id IN (SELECT file FROM m)),
u AS (SELECT file, l, unnest(generate_series(1, len(l))) AS i FROM d),
v AS (SELECT file, i AS pos, l[i] AS body FROM u),
k AS (SELECT file, pos AS i, body, EXISTS (SELECT 1 FROM m WHERE m.file = v.file AND (v.pos BETWEEN m.start AND m.stop OR v.pos = m.stop + 1 AND NOT {Q.nonblank('v.body')})) AS gone FROM v)
SELECT k.file, (SELECT sum(spans)::BIGINT FROM m WHERE m.file = k.file) AS units, (SELECT count(*) FROM m WHERE m.file = k.file) AS islands,
  count(*) FILTER (gone) AS removed, sha256(coalesce(string_agg(body, '' ORDER BY i) FILTER (NOT gone), '')) AS left_sha256 FROM k GROUP BY k.file""")
def deletion_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What documents lose with all their spans, and a digest of the text that stays."""
    files = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), "text")
    out = P.deletion_plan(numbered_spans(spark, folder), files)
    return out.select("file", "units", "islands", "removed", D.sha(F.col("left")).alias("left_sha256"))


_UNITS = f"(SELECT doc_id || ':' || line AS id, CASE WHEN length(text) % 11 = 0 THEN '/' || doc_id WHEN length(text) % 13 = 0 THEN 'gone/' || doc_id ELSE doc_id::VARCHAR END AS file, line - length(text) % 3 AS start, line + length(text) % 5 - 1 AS stop, length(text) % 17 = 0 AS fixed FROM {Q.doc_lines()} WHERE regexp_matches(text, '[0-9]'))"


@query("deletion_problems", f"""
WITH u AS {_UNITS}, d AS (SELECT doc_id::VARCHAR AS file, len({_KEPT}) AS n FROM documents)
SELECT u.id, u.file, CASE WHEN fixed THEN 'read-only evidence' WHEN starts_with(u.file, '/') THEN 'path leaves the root' WHEN start < 1 OR stop < start THEN 'not a 1-based span'
  WHEN n IS NULL THEN 'no such file' ELSE 'span exceeds file' END AS problem FROM u LEFT JOIN d USING (file)
WHERE fixed OR starts_with(u.file, '/') OR start < 1 OR stop < start OR n IS NULL OR stop > n""")
def deletion_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of lines with a digit that may not be deleted, each with its first reason."""
    size = F.length("text")
    doc = F.col("doc_id").cast("string")
    path = F.when(size % 11 == 0, F.concat(F.lit("/"), doc)).when(size % 13 == 0, F.concat(F.lit("gone/"), doc)).otherwise(doc)
    units = document_lines(spark, folder).where(F.col("text").rlike("[0-9]")).select(
        F.concat_ws(":", doc, F.col("line").cast("string")).alias("id"), path.alias("file"), (F.col("line") - size % 3).alias("start"), (F.col("line") + size % 5 - 1).alias("stop"), (size % 17 == 0).alias("fixed"))
    files = table(spark, folder, "documents").select(doc.alias("file"), "text")
    return P.deletion_problems(units, files, read_only="fixed")


@query("citations", f"""
WITH c AS (SELECT doc_id, line AS start, line + length(text) % 40 - 1 AS stop FROM {Q.doc_lines()} WHERE regexp_matches(text, '[0-9]')),
d AS (SELECT doc_id, {Q.lines('text')} AS l, sha256(text) AS file_sha256, n_chars % 10 = 0 AS moved FROM documents WHERE text IS NOT NULL),
p AS (SELECT c.doc_id, start, stop, file_sha256, l, CASE WHEN file_sha256 IS NULL THEN 'not in the snapshot' WHEN start < 1 OR stop < start THEN 'invalid span' WHEN stop - start >= 20 THEN 'too many lines'
  WHEN moved THEN 'source changed' WHEN stop > len(l) THEN 'span exceeds file' END AS problem FROM c LEFT JOIN d USING (doc_id))
SELECT doc_id, start, stop, file_sha256, CASE WHEN problem IS NULL THEN array_to_string(l[start:stop], chr(10)) END AS quote,
  CASE WHEN problem IS NULL THEN sha256(array_to_string(l[start:stop], chr(10))) END AS text_sha256, problem FROM p""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of documents cited against their frozen texts; a part of the texts has changed since."""
    docs = table(spark, folder, "documents")
    asked = document_lines(spark, folder).where(F.col("text").rlike("[0-9]")).select("doc_id", F.col("line").alias("start"), (F.col("line") + F.length("text") % 40 - 1).alias("stop"))
    now = docs.select("doc_id", F.when(F.col("n_chars") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return P.cited(asked, docs, now, file="doc_id", most=20)


@query("extraction_coverage", f"""
WITH d AS (SELECT doc_id, text, len({Q.lines('text')}) AS n FROM documents),
h AS (SELECT length(text) % 60 AS line, n FROM d),
u AS (SELECT CASE WHEN {Q.nonblank('text')} THEN 'submitted' ELSE 'dropped' END AS status, CASE WHEN length(text) > 5000 THEN 1 ELSE 0 END AS truncated FROM d)
SELECT count(*) AS originals, count(*) FILTER (status = 'submitted') AS submitted, count(*) FILTER (status = 'dropped') AS dropped, 0::BIGINT AS excluded,
  count(*) FILTER (truncated > 0) AS truncated, 0::BIGINT AS truncation_unknown, (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM h WHERE line < 1 OR line > greatest(n, 1)) AS uncovered_hits, false AS complete FROM u""")
def extraction_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """One unit for each document, its capped state, and a place in it: what was submitted, cut or left uncovered."""
    units = document_units(spark, folder).withColumn("n", F.size(T.lines(F.col("text"))))
    entries = P.bound(units.select("id"), S.states(units, cap=5000))
    hits = units.select(F.col("id").alias("file"), (F.length("text") % 60).alias("line"))
    spans = units.select(F.col("id").alias("file"), F.lit(1).alias("start"), F.greatest("n", F.lit(1)).alias("stop"))
    return P.coverage(entries, P.covered(hits, spans))


QUOTES = f"SELECT item_id, i AS line, l[i] AS quote FROM (SELECT item_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT item_id, {Q.lines('text')} AS l FROM benchmark))"
FOUND = f"""q AS ({QUOTES}), dq AS (SELECT DISTINCT quote FROM q WHERE length(quote) > 0),
h AS (SELECT doc_id, text, quote FROM documents JOIN dq ON contains(text, quote)),
o AS (SELECT doc_id, text, quote, s AS start, s + length(quote) AS "end" FROM (SELECT *, unnest(generate_series(0, length(text) - length(quote))) AS s FROM h) WHERE substring(text, s + 1, length(quote)) = quote)"""
_LINE = lambda upto: f"len(regexp_extract_all(substring(text, 1, {upto}), '{Q.BREAK}'))"


def quoted(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, line, quote: the lines of the benchmark items."""
    return table(spark, folder, "benchmark").select("item_id", F.posexplode(T.lines(F.col("text"))).alias("i", "quote")).select("item_id", (F.col("i") + 1).alias("line"), "quote")


def found_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return O.occurrences(quoted(spark, folder), table(spark, folder, "documents"), doc="doc_id")


@query("quote_occurrences", f"""
WITH {FOUND} SELECT quote, doc_id::VARCHAR AS doc, start, "end", octet_length(encode(substring(text, 1, start))) AS byte_start, octet_length(encode(substring(text, 1, "end"))) AS byte_end,
  {_LINE("start")} + 1 AS line_start, {_LINE('"end" - 1')} + 1 AS line_end FROM o""")
def quote_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every benchmark line in every document, in code points, bytes and lines."""
    return found_quotes(spark, folder)


@query("quote_claims", f"""
WITH {FOUND}, e AS (SELECT DISTINCT item_id, line, quote, doc_id FROM q JOIN (SELECT doc_id, i.item_id FROM documents JOIN (SELECT DISTINCT item_id, quote FROM q WHERE length(quote) > 0) i ON contains(text, i.quote)) USING (item_id)),
n AS (SELECT doc_id, quote, count(*) AS n, min(start) AS start FROM o GROUP BY ALL)
SELECT e.item_id, e.line, e.doc_id::VARCHAR AS doc, CASE WHEN n = 1 THEN 'candidate' ELSE 'rejected' END AS status,
  CASE WHEN quote = '' THEN 'empty value is no occurrence' WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' END AS reason, CASE WHEN n = 1 THEN start END AS start FROM e LEFT JOIN n USING (doc_id, quote)""")
def quote_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of an item claimed for each document that holds any line of the item: located once, ambiguous or absent."""
    quotes, found = quoted(spark, folder), found_quotes(spark, folder)
    pairs = found.join(quotes, "quote").select("item_id", "doc").distinct()
    claims = quotes.join(pairs, "item_id")
    return O.located(claims, found).select("item_id", "line", "doc", "status", "reason", "start")
