"""Queries of unit builders: lines, hits, tables, sections, patches, code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from juryframe.functions import text as T
from juryframe.operators import hunks as H, units as U
from juryframe.plans import sqltext as Q
from juryframe.plans.common import cat
from juryframe.plans.registry import query
from juryframe.sources.tables import document_lines, document_units, table


@query("line_signatures", f"""
WITH s AS (SELECT doc_id, line, text AS raw, {Q.signature('text')} AS signature FROM {Q.doc_lines()} WHERE {Q.nonblank('text')})
SELECT signature, count(*) AS count, substr(sha1(signature), 1, 10) AS id,
  list(raw ORDER BY doc_id, line)[1:3] AS examples FROM s GROUP BY signature""")
def line_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signature, count and first examples over all document lines."""
    return U.line_units(document_lines(spark, folder), order=["doc_id", "line"])


@query("line_signatures_kept", f"""
WITH s AS (SELECT doc_id, line, {Q.strip('text')} AS signature FROM {Q.doc_lines()}
  WHERE {Q.nonblank('text')} AND regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '^Section'))
SELECT signature, count(*) AS count, substr(sha1(signature), 1, 10) AS id FROM s GROUP BY signature""")
def line_signatures_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Raw signatures of lines that hold a digit, without those that start with Section."""
    return U.line_units(document_lines(spark, folder), order=["doc_id", "line"], keep="[0-9]", drop="^Section",
                        normalize=False, examples=0).drop("examples")


@query("turn_signatures", f"""
WITH t AS (SELECT conv_id * 1000000 + turn AS doc_id, role, text FROM conversations),
s AS (SELECT role, {Q.signature('text')} AS signature FROM {Q.doc_lines('role', 't')} WHERE {Q.nonblank('text')})
SELECT role, count(*) AS lines, count(DISTINCT signature) AS signatures FROM s GROUP BY role""")
def turn_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and distinct signatures per conversation role."""
    turns = table(spark, folder, "conversations")
    rows = turns.select("role", F.explode(T.lines(F.col("text"))).alias("text")).where(T.nonblank(F.col("text")))
    rows = rows.select("role", T.signature(F.col("text")).alias("signature"))
    # Distinct is counted over pre-aggregated pairs, so one role holding most rows is still combined on the map side.
    pairs = rows.groupBy("role", "signature").agg(F.count("*").alias("n"))
    return pairs.groupBy("role").agg(F.sum("n").alias("lines"), F.count("*").alias("signatures"))


CONTEXT = f"""
WITH d AS (SELECT doc_id, {Q.lines('text')} AS l FROM documents),
h AS (SELECT doc_id, l, i FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d) WHERE regexp_matches(l[i], %s))
SELECT doc_id || ':' || i AS id, CAST(doc_id AS VARCHAR) AS file, i AS line, l[i] AS match,
  list_aggregate(list_transform(generate_series(greatest(1, i - %d), least(len(l), i + %d)),
    lambda n: (CASE WHEN n = i THEN '>' ELSE ' ' END) || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, ' ') ELSE CAST(n AS VARCHAR) END || '| ' || l[n]),
    'string_agg', chr(10)) AS context FROM h"""


@query("pattern_hits", CONTEXT % ("'[0-9]{3}'", 3, 3))
def pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with three digits in a row, three lines of context on either side."""
    return U.context_units(document_units(spark, folder).withColumn("doc", F.col("id")), "[0-9]{3}", file="doc")


@query("pattern_hits_fixed", CONTEXT % (r"'(?i)\+1 \(5'", 1, 1))
def pattern_hits_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed string in any case, one line of context, and a refusal above a limit."""
    return U.context_units(document_units(spark, folder).withColumn("doc", F.col("id")), "+1 (5", file="doc",
                           context=1, fixed=True, case=False, max_units=2 ** 40)


@query("unit_ids", f"""
SELECT doc_id, line, CASE WHEN n > 1 THEN i || '#' || n ELSE i END AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY doc_id, line) AS n FROM (
    SELECT doc_id, line, source || ':' || line AS i FROM {Q.doc_lines('source')}))""")
def unit_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Lines named by source and number: most names repeat across documents and get a suffix."""
    rows = document_lines(spark, folder, "source").select(
        "doc_id", "line", F.concat_ws(":", "source", F.col("line").cast("string")).alias("id"))
    from juryframe.operators.ordered import run_of
    return U.unique_ids(rows, scope=[], id="id", order=[F.col("doc_id"), F.col("line")], bucket=run_of(F.col("doc_id")))


def elided_text() -> Column:
    """Documents with a cut marker put into some of them."""
    mark = (F.when(F.col("pos") % 11 == 0, "\n[… 12 ln elided]").when(F.col("pos") % 11 == 1, "\n... 40 more rows")
            .when(F.col("pos") % 11 == 2, "\n[Some lines truncated to 80").when(F.col("pos") % 11 == 3, "\nmoreover"))
    return F.concat("text", F.coalesce(mark, F.lit("")))


@query("elided_inputs", """
WITH t AS (SELECT doc_id, text, doc_id % 11 AS k FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE k WHEN 0 THEN '[… N ln elided' WHEN 1 THEN '… N more' WHEN 2 THEN '[Some lines truncated to' END AS marker,
  CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS INTEGER) AS line FROM t WHERE k < 3""")
def elided_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not the whole source: the marker found and its line."""
    rows = document_units(spark, folder).select("id", T.elision(elided_text()).alias("e"))
    return rows.where(F.col("e").isNotNull()).select("id", F.col("e.marker").alias("marker"), F.col("e.line").alias("line"))


def part_table() -> Column:
    """A Markdown table per part: escaped pipes in names, some ragged, some with a second table."""
    key = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit(r"\|"))
    return cat("Parts\n\n| field | value |\n|:--|--:|\n| name | ", name, " |\n| size | ", F.col("p_size").cast("string"), " |",
               F.when(key % 7 == 1, "\n| extra | 1 | 2 |").when(key % 7 == 2, "\n| size | again |").when(key % 7 == 3, "\n|  | none |")
               .when(key % 7 == 4, "\ntail\n| other | table |\n|---|---|\n| a | b |").otherwise(""), "\n")


@query("table_units", """
SELECT p_partkey, NULL AS problem, f AS id, f AS field, CASE f WHEN 'name' THEN replace(p_name, ' ', '|') ELSE CAST(p_size AS VARCHAR) END AS value
FROM part, (VALUES ('name'), ('size')) AS x(f) WHERE p_partkey % 7 IN (0, 5, 6)
UNION ALL SELECT p_partkey, ['', 'ragged', 'duplicate_key', 'empty_key', 'second_table'][p_partkey % 7 + 1], NULL, NULL, NULL
FROM part WHERE p_partkey % 7 BETWEEN 1 AND 4""")
def table_units(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a Markdown table keyed by a column, with the reason where a table is refused."""
    texts = table(spark, folder, "part").select("p_partkey", part_table().alias("text"))
    rows = U.table_rows(texts, key="field").select("p_partkey", "problem", F.explode_outer("rows").alias("r"))
    return rows.select("p_partkey", "problem", F.col("r.id").alias("id"), F.col("r.cells")["field"].alias("field"),
                       F.col("r.cells")["value"].alias("value"))


@query("table_row_cells", """
SELECT p_partkey, [replace(p_name, ' ', '|'), p_brand, '', CAST(p_size AS VARCHAR)] AS cells FROM part""")
def table_row_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of one row: escaped pipes are text, frames are dropped, blanks stay."""
    line = cat("  | ", F.replace("p_name", F.lit(" "), F.lit(r"\|")), " |", F.col("p_brand"), "  |  | ", F.col("p_size").cast("string"), "|")
    return table(spark, folder, "part").select("p_partkey", T.table_cells(line).alias("cells"))


def markdown_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: every twelfth line a heading, another underlined, another fenced."""
    docs = document_units(spark, folder).select("id", "pos", T.lines(F.col("text")).alias("l"))

    def show(x: Column, i: Column) -> Column:
        return (F.when(i % 12 == 5, cat("## Part ", (i % 3).cast("string"), " ##"))
                .when(i % 12 == 8, cat("Title", (F.col("pos") % 2).cast("string"), "\n==="))
                .when((i % 12 == 10) & (F.col("pos") % 2 == 0), "```\n# not a heading\n```")
                .otherwise(cat("x", F.regexp_replace(x, r"^[ \t]*(#|`|~|=|-|[0-9])+", ""))))

    return docs.select("id", F.array_join(F.transform("l", show), "\n").alias("text"))


@query("markdown_sections", f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({Q.lines('text')}, lambda x: 'x' || regexp_replace(x, '^[ \\t]*(#|`|~|=|-|[0-9])+', '')) AS l FROM documents),
e AS (SELECT doc_id, i - 1 AS i, l[i] AS x FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d)),
p AS (SELECT doc_id, i, CASE WHEN i % 12 = 5 THEN ['## Part ' || (i % 3) || ' ##'] WHEN i % 12 = 8 THEN ['Title' || (doc_id % 2), '===']
  WHEN i % 12 = 10 AND doc_id % 2 = 0 THEN ['```', '# not a heading', '```'] ELSE [x] END AS piece,
  CASE WHEN i % 12 = 5 THEN 'Part ' || (i % 3) WHEN i % 12 = 8 THEN 'Title' || (doc_id % 2) END AS heading FROM e),
q AS (SELECT *, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) - len(piece) + 1 AS line,
  count(heading) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM p),
g AS (SELECT doc_id, s, coalesce(max(heading), 'preamble') AS heading, CAST(min(line) AS INTEGER) AS line,
  CAST(max(line + len(piece) - 1) AS INTEGER) AS end_line, array_to_string(flatten(list(piece ORDER BY i)), chr(10)) AS body FROM q GROUP BY doc_id, s),
b AS (SELECT *, body || CASE WHEN s < max(s) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS passage FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY s) AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS section FROM b)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(section AS INTEGER) AS section, heading, CAST(nth AS INTEGER) AS nth, line, end_line, passage,
  substr(sha256('["' || heading || '",' || nth || ']'), 1, 20) AS key FROM n""")
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with their heading, occurrence, span, passage and key."""
    docs = markdown_docs(spark, folder)
    return U.markdown_sections(docs, id="id")


@query("documentation_records", f"""
WITH d AS (SELECT doc_id, {Q.lines('text')} AS l FROM documents),
h AS (SELECT doc_id, len(l) AS n, len(list_filter(generate_series(1, len(l)), lambda i: (i - 1) % 12 IN (5, 8))) AS k,
  len(l) > 0 AS full_ FROM d)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN full_ THEN k + 1 ELSE 0 END AS BIGINT) AS sections, NOT full_ AS empty_document FROM h""")
def documentation_records(spark: SparkSession, folder: str) -> DataFrame:
    """Sections per document; a document without sections keeps one record."""
    docs = markdown_docs(spark, folder)
    found = U.markdown_sections(docs, id="id").groupBy("id").agg(F.count("*").alias("n"))
    return docs.select("id").join(found, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("sections"), F.col("n").isNull().alias("empty_document"))


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per document, made from its lines: added, deleted, renamed, binary or hunks of four lines."""
    docs = document_units(spark, folder).select("id", "pos", cat("src/", F.col("file"), "/d", F.col("id"), ".txt").alias("path"),
                                                T.lines(F.col("text")).alias("l"))
    docs = docs.where(F.size("l") > 0)
    p, n = F.col("path"), F.size("l")
    head = cat("diff --git a/", p, " b/", p, "\n")
    count = F.when(n == 1, "1").otherwise(cat("1,", n.cast("string")))
    every = lambda mark: F.array_join(F.transform("l", lambda x: cat(mark, x, "\n")), "")

    def hunk(h: Column) -> Column:
        at = (h * 4 + 1).cast("string")
        get = lambda i: F.coalesce(F.get("l", (h * 4 + i).cast("int")), F.lit("-"))
        return cat("@@ -", at, ",3 +", at, ",3 @@ part ", h.cast("string"), "\n ", get(0), "\n-", get(1), "\n+def f",
                   (h % 5).cast("string"), "(x): f", ((h + 1) % 5).cast("string"), "\n ", get(3), "\n")

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), hunk), "")
    kind = F.col("pos") % 6
    text = (F.when(kind == 0, cat(head, "new file mode 100644\n--- /dev/null\n+++ b/", p, "\n@@ -0,0 +", count, " @@\n", every("+")))
            .when(kind == 1, cat(head, "deleted file mode 100644\n--- a/", p, "\n+++ /dev/null\n@@ -", count, " +0,0 @@\n", every("-")))
            .when(kind == 2, cat('diff --git "a/', p, '.\\303\\251" "b/', p, '.new"\nsimilarity index 100%\nrename from x\nrename to ', p, ".new\n"))
            .when(kind == 3, cat(head, "index 1..2\nBinary files a/", p, " and b/", p, " differ\n"))
            .otherwise(cat(head, "--- a/", p, "\n+++ b/", p, "\n", body)))
    return docs.select("id", "pos", text.alias("patch")).withColumnRenamed("id", "patch_id")


PATCH_SQL = f"""
WITH d AS (SELECT doc_id, 'src/' || source || '/d' || doc_id || '.txt' AS p, {Q.lines('text')} AS l, doc_id % 6 AS k FROM documents WHERE {Q.lines('text')} <> []),
c AS (SELECT *, len(l) AS n, CASE WHEN len(l) = 1 THEN '1' ELSE '1,' || len(l) END AS cnt FROM d)"""


@query("patch_files", PATCH_SQL + """
SELECT CAST(doc_id AS VARCHAR) AS patch_id, CASE WHEN k = 2 THEN p || '.new' ELSE p END AS file,
  ['added', 'deleted', 'renamed', 'binary', 'modified', 'modified'][k + 1] AS status FROM c""")
def patch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of every patch with their status; quoted names are decoded."""
    return U.patch_files(patches(spark, folder), keep=["patch_id"]).select("patch_id", "file", "status")


@query("patch_hunks", PATCH_SQL + """,
h AS (SELECT *, unnest(generate_series(0, (n - 1) // 4)) AS h FROM c WHERE k > 3)
SELECT CAST(doc_id AS VARCHAR) AS patch_id, p || ':+' || (4 * h + 1) AS id, 'modified' AS status, '@@ -' || (4 * h + 1) || ',3 +' || (4 * h + 1) || ',3 @@ part ' || h AS header,
  CAST(4 * h + 1 AS INTEGER) AS line, CAST(4 * h + 1 AS INTEGER) AS old_line FROM h
UNION ALL SELECT CAST(doc_id AS VARCHAR), p || ':+1', 'added', '@@ -0,0 +' || cnt || ' @@', 1, 0 FROM c WHERE k = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), p || ':-1', 'deleted', '@@ -' || cnt || ' +0,0 @@', 0, 1 FROM c WHERE k = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE k WHEN 2 THEN p || '.new' ELSE p END || ':meta', CASE k WHEN 2 THEN 'renamed' ELSE 'binary' END, '', NULL, NULL FROM c WHERE k IN (2, 3)""")
def patch_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """Hunks of every patch with id, header and both line numbers."""
    rows = U.patch_hunks(patches(spark, folder), scope=["patch_id"])
    return rows.select("patch_id", "id", "status", "header", "line", "old_line")


@query("patch_lines", PATCH_SQL + """,
h AS (SELECT *, unnest(generate_series(0, (n - 1) // 4)) AS h FROM c WHERE k > 3),
r AS (SELECT p || ':+' || (4 * h + 1) AS id, 'removed' AS side, 4 * h + 2 AS number, coalesce(l[4 * h + 2], '-') AS text FROM h
  UNION ALL SELECT p || ':+' || (4 * h + 1), 'added', 4 * h + 2, 'def f' || (h % 5) || '(x): f' || ((h + 1) % 5) FROM h
  UNION ALL SELECT p || ':+1', 'added', i, l[i] FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM c WHERE k = 0)
  UNION ALL SELECT p || ':-1', 'removed', i, l[i] FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM c WHERE k = 1))
SELECT id, side, CAST(number AS BIGINT) AS number, text FROM r""")
def patch_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Added and removed lines with the number on their side."""
    rows = U.patch_hunks(patches(spark, folder), scope=["patch_id"])
    return U.hunk_lines(rows, keys=["id"]).select("id", "side", F.col("number").cast("bigint").alias("number"), "text")


@query("hunk_neighbours", PATCH_SQL + """,
h AS (SELECT 'src/' || split_part(p, '/', 2) AS f, p || ':+' || (4 * i + 1) AS id, doc_id * 100000 + i AS pos, 4 * i + 1 + doc_id % 7 AS a
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // 4)) AS i FROM c WHERE k > 3)
  UNION ALL SELECT 'src/' || split_part(p, '/', 2), p || [':+1', ':-1', '.new:meta', ':meta'][k + 1], doc_id * 100000, CASE k WHEN 0 THEN 1 ELSE 0 END + doc_id % 7 FROM c WHERE k <= 3)
SELECT x.id, (SELECT list(y.id ORDER BY abs(y.a - x.a), y.pos)[1:6] FROM h y WHERE y.f = x.f AND y.id <> x.id) AS near FROM h x""")
def hunk_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The six nearest hunks of each hunk, when one file is a whole source folder."""
    rows = U.patch_hunks(patches(spark, folder), scope=["patch_id", "pos"])
    rows = rows.select(F.regexp_extract("file", "^(src/[^/]+)/", 1).alias("file"), "id",
                       (F.col("pos") * 100000 + F.col("hunk_pos")).alias("p"), (F.coalesce("line", F.lit(0)) + F.col("pos") % 7).alias("a"))
    return H.neighbours(rows, file="file", id="id", anchor="a", pos="p", k=6)


@query("hunk_states", PATCH_SQL + """,
h AS (SELECT p AS f, p || ':+' || (4 * i + 1) AS id, doc_id * 100000 + i AS pos, 4 * i + 1 AS a, 'f' || (i % 5) AS def, i,
  '@@ -' || (4 * i + 1) || ',3 +' || (4 * i + 1) || ',3 @@ part ' || i AS header, coalesce(l[4 * i + 2], '-') AS gone
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // 4)) AS i FROM c WHERE k > 3)),
b AS (SELECT *, f || ' ' || header || chr(10) || '-' || gone || chr(10) || '+def ' || def || '(x): f' || ((i + 1) % 5) AS t FROM h),
near AS (SELECT x.id, list(y.id) AS ids, list(y.t ORDER BY y.n) AS texts FROM b x JOIN LATERAL (
  SELECT z.id, z.t, row_number() OVER (ORDER BY abs(z.a - x.a), z.pos) AS n FROM b z WHERE z.f = x.f AND z.id <> x.id) y ON y.n <= 6 GROUP BY x.id),
u AS (SELECT def, id, pos, t, row_number() OVER (PARTITION BY def ORDER BY pos) AS r FROM (
  SELECT 'f' || (i % 5) AS def, id, pos, t FROM b UNION SELECT 'f' || ((i + 1) % 5), id, pos, t FROM b)),
ask AS (SELECT x.id, u.t, row_number() OVER (PARTITION BY x.id ORDER BY u.pos) AS n FROM b x JOIN u ON u.def = x.def AND u.r <= 40 AND u.id <> x.id
  LEFT JOIN near ON near.id = x.id WHERE NOT coalesce(list_contains(near.ids, u.id), false))
SELECT b.id, b.f AS file, coalesce(near.texts, []) AS nearest_sibling_hunks,
  coalesce((SELECT list(ask.t ORDER BY n) FROM ask WHERE ask.id = b.id AND n <= 3), []) AS hunks_using_names_defined_here
FROM b LEFT JOIN near ON near.id = b.id
UNION ALL SELECT p || [':+1', ':-1', '.new:meta', ':meta'][k + 1], CASE k WHEN 2 THEN p || '.new' ELSE p END, [], [] FROM c WHERE k <= 3""")
def hunk_states(spark: SparkSession, folder: str) -> DataFrame:
    """Every hunk with its nearest hunks and the first hunks that use a name it defines."""
    rows = U.patch_hunks(patches(spark, folder), scope=["patch_id", "pos"])
    rows = rows.withColumn("pos", F.col("pos") * 100000 + F.col("hunk_pos"))
    return H.hunk_states(rows).select("id", "file", "nearest_sibling_hunks", "hunks_using_names_defined_here")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Python source per part: a function with a nested one, and one class; every ninth does not parse."""
    key = F.col("p_partkey")
    text = cat("def part_", key.cast("string"), "(x):\n    def inner(y):\n        return y + ", F.col("p_size").cast("string"),
               "\n    return inner(x)\n\nclass C:\n    def go(self):\n        return 1\n", F.when(key % 9 == 0, "def broken(:\n").otherwise(""))
    return table(spark, folder, "part").select(key.alias("file"), text.alias("text"))


@query("code_functions", """
SELECT p_partkey AS file, kind, CASE n WHEN 1 THEN 'part_' || p_partkey WHEN 2 THEN 'inner' WHEN 3 THEN 'go' END AS name,
  CASE WHEN kind <> 'error' THEN [1, 2, 7][n] END AS line, CASE WHEN kind <> 'error' THEN [4, 3, 8][n] END AS end_line
FROM (SELECT p_partkey, 'FunctionDef' AS kind, unnest([1, 2, 3]) AS n FROM part WHERE p_partkey % 9 <> 0
  UNION ALL SELECT p_partkey, 'error', NULL FROM part WHERE p_partkey % 9 = 0)""")
def code_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of generated source files; a file that does not parse stays as an error row."""
    return U.code_units(code_files(spark, folder), id="file").select("file", "kind", "name", "line", "end_line")


@query("enclosing_functions", """
SELECT p_partkey AS file, line, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN line <= 4 THEN 'part_' || p_partkey WHEN line >= 7 THEN 'go' END AS function
FROM part, (VALUES (1), (3), (5), (8), (3)) AS x(line)""")
def enclosing_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The first function in walk order that holds a line; a file that does not parse has none, and a line asked for twice is answered twice."""
    files = code_files(spark, folder)
    points = files.select("file", F.explode(F.array(*[F.lit(n) for n in (1, 3, 5, 8, 3)])).alias("line"))
    return U.enclosing(U.code_units(files, id="file"), points, key="file")


@query("enclosing_sections", PATCH_SQL + """,
s AS (SELECT CAST(doc_id AS VARCHAR) AS id, l, n FROM c), h AS (SELECT id, i AS at, CASE WHEN (i - 1) % 12 = 5 THEN 'Part ' || ((i - 1) % 3) ELSE 'Title' || (id::BIGINT % 2) END AS name,
  i + (SELECT count(*) FROM (SELECT unnest(generate_series(0, i - 2)) AS j) WHERE j % 12 = 8) + CASE WHEN id::BIGINT % 2 = 0 THEN 2 * (SELECT count(*) FROM (SELECT unnest(generate_series(0, i - 2)) AS j) WHERE j % 12 = 10) ELSE 0 END AS line
  FROM (SELECT id, unnest(generate_series(1, n)) AS i FROM s) WHERE (i - 1) % 12 IN (5, 8)),
p AS (SELECT id, unnest([1, 7, 8, 300, 7]) AS line FROM s), t AS (SELECT id, n + len(list_filter(generate_series(0, n - 1), lambda j: j % 12 = 8)) + CASE WHEN id::BIGINT % 2 = 0 THEN 2 * len(list_filter(generate_series(0, n - 1), lambda j: j % 12 = 10)) ELSE 0 END AS total FROM s)
SELECT p.id AS file, p.line, CASE WHEN p.line <= total THEN coalesce((SELECT arg_max(name, h.line) FROM h WHERE h.id = p.id AND h.line <= p.line), 'preamble') END AS function FROM p JOIN t ON t.id = p.id""")
def enclosing_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown section that holds each of a few lines of every document; a line asked for twice is answered twice."""
    docs = markdown_docs(spark, folder).where("text <> ''")
    spans = U.markdown_sections(docs, id="id", passages=False).select(F.col("id").alias("file"), "line", "end_line", F.col("heading").alias("name"), F.col("section").alias("walk_pos"))
    points = docs.select(F.col("id").alias("file"), F.explode(F.array(*[F.lit(n) for n in (1, 7, 8, 300, 7)])).alias("line"))
    return U.enclosing(spans, points, key="file")
