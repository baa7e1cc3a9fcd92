"""The opN_ queries: each runs one operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from juryframe.llm import (decontaminate as D, fim as I, html_text as H, lm as L, mixing as M, packing as B, pii as P, quality as Q, secrets as S, shingle_join as J,
                           substrings as R, tokens as T, whitening as E)
from juryframe.llm.common import cut, fresh_path
from juryframe.session import configure
from juryframe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB text: ASCII letters to lower case.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op2_decontaminate", rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
part AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS body
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM part),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
span AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT r, i, n, item_id FROM span JOIN part USING (n, body)),
hits AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS u(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""")
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside occurrences of 13-word benchmark windows, and the contamination verdict."""
    docs = table(spark, folder, "documents")
    out = D.report(D.contaminated_spans(docs, table(spark, folder, "benchmark")))
    return out.select(
        F.col("id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_row"),
    ).drop("_row")


@query("op1_mixing", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM s0),
s2 AS (SELECT *, 2 * source_size AS most, (2 * source_size)::DOUBLE / w AS level FROM s1),
s3 AS (SELECT *, coalesce(sum(most) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
  sum(w) OVER (ORDER BY level, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, (sum(source_size) OVER ())::BIGINT AS total FROM s2),
s4 AS (SELECT *, (total * 1.5::DOUBLE - full_) / open_ AS stand FROM s3),
s5 AS (SELECT first(stand ORDER BY level, s) AS stand FROM s4 WHERE stand * w <= most),
s6 AS (SELECT s4.source, source_size, least(most::DOUBLE, coalesce(s5.stand * w, most::DOUBLE)) AS target FROM s4 LEFT JOIN s5 ON true),
p AS (SELECT r, doc_id, size, source_size, target, round(target)::BIGINT AS words,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, (greatest(least(a + size, words) - a, 0) + greatest(least(a + source_size + size, words) - a - source_size, 0))::BIGINT AS taken FROM p""")
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes, next to its source's size and target."""
    out = M.taken(*M.mix(table(spark, folder, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _listed(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _distance(counts: str, reference: str) -> str:
    q, p = f"({counts}[i]::DOUBLE / list_sum({counts}))", f"({reference}[i]::DOUBLE / list_sum({reference}))"
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({counts}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {term(q)} + {term(p)})) / 2, 0)) END"


_B = Q.Bounds()
_PER_BIN = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"


@query("op10_quality", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
  CASE lang {" ".join(f"WHEN '{k}' THEN '{k}'" for k in Q.COMMON)} ELSE 'other' END AS lang FROM documents),
tri AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 3)) AS u(j) GROUP BY r),
m AS (SELECT r, doc_id, lang, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines, length(t) AS total,
  length(t) - length(regexp_replace(t, '[\p{{Ll}}\p{{Lo}}\p{{Lm}}]+', '', 'g')) AS letters, length(t) - length(translate(t, '.,', '')) AS stops,
  CASE lang {" ".join(f"WHEN '{k}' THEN {_listed(v)}" for k, v in Q.COMMON.items())} END AS known FROM d LEFT JOIN rep USING (r)),
h AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  [letters, n_symbols, stops, total - word_chars, word_chars - letters - n_symbols - stops] AS chars,
  CASE WHEN known IS NOT NULL THEN list_concat(list_transform(range(1, {Q.BINS + 1}), lambda k: len(list_filter(w, lambda x: x = known[k]))), [len(list_filter(w, lambda x: NOT list_contains(known, x)))]) END AS common FROM m),
ref AS (SELECT lang, {_PER_BIN("chars", Q.CHAR_BINS)} AS rc, {_PER_BIN("common", Q.BINS + 1)} AS rw FROM h GROUP BY lang),
v AS (SELECT h.*, {_distance("chars", "rc")} AS dc, CASE WHEN common IS NOT NULL THEN {_distance("common", "rw")} END AS dw FROM h JOIN ref USING (lang)),
b AS (SELECT *, n_words < {_B.min_words} OR 100 * n_repeat_words > {_B.max_repeat_percent} * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {_B.guard_chars_words} AND coalesce(dc, 0) > {_B.max_char_distance} OR n_words >= {_B.guard_common_words} AND coalesce(dw, 0) > {_B.max_word_distance}) AS kept FROM b""")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Plain measures and the divergence verdict of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    measured = cut(Q.measures(docs).select("doc_id", "_q"))
    out = Q.verdict(measured, Q.references(measured))
    return out.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def _found(rule: S.Rule, order: int) -> str:
    """DuckDB: spans of one rule by the lengths of matches and of the texts between them."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return rf"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: {{
  'a': coalesce(list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda x: length(x))), 0)::BIGINT,
  'o': {order}, 'k': '{rule.kind}', 'n': length(regexp_extract_all(t, {pattern})[i]), 'g': length(regexp_extract_all(t, {pattern}, {rule.group})[i])}}), lambda s: s.g >= {rule.least})"""


@query("op3_secrets", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(f"{_found(r, i)} AS {r.kind}" for i, r in enumerate(S.RULES))} FROM d),
g AS (SELECT *, list_sort({" || ".join(r.kind for r in S.RULES)}) AS everything, list_sort({" || ".join(r.kind for r in S.RULES if r.base)}) AS base FROM f)
SELECT doc_id, {", ".join(f"len({r.kind})::BIGINT AS n_{r.kind}" for r in S.RULES if r.base)},
  sha256(array_to_string(list_transform(base, lambda s: s.k || ':' || s.a || ':' || (s.a + s.n)), ',')) AS base_sha256,
  array_to_string(list_transform(everything, lambda s: s.k || ':' || s.a || ':' || (s.a + s.n)), ',') AS spans FROM g""")
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document: counts, a digest and the list of spans."""
    out = S.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in S.RULES if r.base]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in S.RULES if r.base]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"))


@query("op6_shingle_join", rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS u(i)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 90 * (cx.n + cy.n - k)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.seen)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) LEFT JOIN c USING (doc_id)""")
def op6_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of each document under a Jaccard similarity of 0.9 of three-word shingles."""
    rows, _ = J.similar_documents(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def word_vocabulary() -> str:
    """The vocabulary file of the token query; any other tokenizer file may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token files of `docs`."""
    out = T.read(T.write(docs, word_vocabulary(), fresh_path(spark)))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query("op4_tokens")
def op4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document stands in the token files, how long it is, and a checksum of its ids."""
    return token_rows(spark, table(spark, folder, "documents"))


@query("op5_lm")
def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of each document under the interpolated model, next to the plain unigram score."""
    return L.scored(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_substrings", rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM x JOIN m USING (h), unnest(range(0, 50)) AS u(j) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""")
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that earlier documents hold in runs of fifty, and a digest of what is left."""
    rows, changed = R.repeats_removed(table(spark, folder, "documents"))
    out = rows.join(changed.select("id", "key", "n_removed", F.sha2("kept", 256).alias("left")), ["id", "key"], "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256"))


@query("op8_pii")
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in each document: counts and digest of the plain matches, list of all spans."""
    out = P.scan(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in P.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op9_html")
def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of each page."""
    return H.extract(table(spark, folder, "pages"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened coordinates of each usable vector, its exact deviation, and the explained share of each component."""
    out = E.whiten(table(spark, folder, "embeddings"))
    deviation = F.col("deviation").try_cast("long").alias("deviation")  # null beyond 2**63, as n * n grows
    return out.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    out = B.pack(table(spark, folder, "documents"), word_vocabulary())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


_GROUP = "('0x' || substr(h, {}, 8))::UBIGINT::BIGINT"


@query("op13_fim", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, least({_GROUP.format(1)} % (n + 1), {_GROUP.format(9)} % (n + 1)) AS a, greatest({_GROUP.format(1)} % (n + 1), {_GROUP.format(9)} % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_GROUP.format(17)} % 100 >= 90 THEN 'plain'
    WHEN {_GROUP.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o""")
def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-middle form, cuts and output of each document, with a digest of the text rebuilt from the output."""
    out = I.transform(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(I.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
