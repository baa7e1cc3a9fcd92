"""Line spans of texts: coverage, containment, merging, deletion plans, citations, and bound extractions.

Spans are 1-based and inclusive. All of it sweeps along the lines of a file with running maxima, so no pair of spans is
ever made and a file with very many spans is cut into runs (see `ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from juryframe.functions import digest as D, text as T
from juryframe.operators.ordered import run_of, with_running

#: Most lines one citation may name.
CITED_LINES = 400
#: Roles of units that are evidence, never text to edit (fixed values).
KEPT_ROLES = ("original_comment", "external_history", "snapshot")


def covered(points: DataFrame, spans: DataFrame, *, file: str = "file", line: str = "line", start: str = "start", stop: str = "stop") -> DataFrame:
    """`points` with `covered`: true where some span of the file holds the line.

    A span without an end covers its first line; one without a first line, or that ends before it starts, covers nothing.
    Points without a line are not covered. Null files are one file; repeated points stay.
    """
    reach = F.coalesce(F.col(stop), F.col(start)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    ends = spans.where(F.col(start).isNotNull() & (reach >= F.col(start))).select(F.col(file).alias("f"), F.col(start).cast("long").alias("at"), reach.alias("reach"), F.lit(0).alias("is_point"))
    asked = points.select(F.col(file).alias("f"), F.col(line).cast("long").alias("at"), F.lit(None).cast("long").alias("reach"), F.lit(1).alias("is_point"), row.alias("row"))
    both = asked.unionByName(ends, allowMissingColumns=True)
    swept = with_running(both, ["f"], [F.col("at"), F.col("is_point")], run_of(F.col("at")), maxes={"far": F.col("reach")})
    return swept.where("is_point = 1").select("row.*", F.coalesce(F.col("far") >= F.col("at"), F.lit(False)).alias("covered"))


def placed(spans: DataFrame, *, file: str = "file", start: str = "start", stop: str = "stop") -> DataFrame:
    """`spans` with `place`: how a span lies to those before it (by start, longer ones first).

    "inside" one that reaches as far (or equals it), "overlap" with one that ends no sooner than this starts,
    "adjacent" to the line after the furthest, else "apart".
    """
    order = [F.col(start), F.col(stop).desc()]
    swept = with_running(spans, [file], order, run_of(F.col(start)), maxes={"far": F.col(stop)}, inclusive=False)
    place = F.when(F.col("far") >= F.col(stop), "inside").when(F.col("far") >= F.col(start), "overlap").when(F.col("far") + 1 == F.col(start), "adjacent")
    return swept.withColumn("place", F.coalesce(place, F.lit("apart"))).drop("far")


def merged(spans: DataFrame, *, file: str = "file", start: str = "start", stop: str = "stop") -> DataFrame:
    """Islands of spans that overlap or touch: file, start, stop, spans (how many made the island)."""
    rows = spans.select(F.col(file).alias("file"), F.col(start).cast("long").alias("start"), F.col(stop).cast("long").alias("stop"))
    order, bucket = [F.col("start"), F.col("stop")], run_of(F.col("start"))
    swept = with_running(rows, ["file"], order, bucket, maxes={"far": F.col("stop")}, inclusive=False)
    opens = F.coalesce(F.col("start") > F.col("far") + 1, F.lit(True)).cast("long")
    # of equal spans the one that opens an island comes first
    numbered = with_running(swept.withColumn("opens", opens), ["file"], [*order, F.col("opens").desc()], bucket, sums={"island": F.col("opens")})
    return numbered.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("spans")).drop("island")


def kept_lines(text: Column) -> Column:
    """Lines of a text with their breaks."""
    inner = T.LINE_BREAK[T.LINE_BREAK.index("[") + 1:-1]
    return F.regexp_extract_all(text, F.lit(rf"([^{inner}]*(?:{T.LINE_BREAK})|[^{inner}]+)"), F.lit(1))


def deletion_problems(units: DataFrame, files: DataFrame, *, id: str = "id", file: str = "file", start: str = "start", stop: str = "stop",
                      role: str | None = None, read_only: str | None = None, text: str = "text") -> DataFrame:
    """Units whose span may not be deleted, with the first reason: `id`, `file`, `problem`.

    In this order: evidence that is read-only or has a role of KEPT_ROLES; a file path that is absolute or leaves the
    root; a span that is no 1-based range; a file that is not there; a span beyond its file.
    """
    protected = F.lit(False)
    if read_only is not None:
        protected = protected | F.coalesce(F.col(read_only), F.lit(False))
    if role is not None:
        protected = protected | F.coalesce(F.col(role).isin(*KEPT_ROLES), F.lit(False))
    held = files.select(F.col(file).alias("held_file"), F.size(kept_lines(F.coalesce(F.col(text), F.lit("")))).alias("held_lines"))
    rows = units.select(F.col(id).alias("id"), F.col(file).alias("file"), F.col(start).alias("start"), F.col(stop).alias("stop"), protected.alias("protected"))
    path = F.col("file").cast("string")
    escapes = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    problem = (F.when(F.col("protected"), "read-only evidence").when(escapes, "path leaves the root")
               .when(F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") < 1) | (F.col("stop") < F.col("start")), "not a 1-based span")
               .when(F.col("held_lines").isNull(), "no such file").when(F.col("stop") > F.col("held_lines"), "span exceeds file"))
    return rows.join(held, rows["file"] == held["held_file"], "left").withColumn("problem", problem).where("problem IS NOT NULL").select("id", "file", "problem")


def deletion_plan(units: DataFrame, files: DataFrame, *, file: str = "file", start: str = "start", stop: str = "stop", text: str = "text") -> DataFrame:
    """Files that lose lines: file, units, islands, removed (lines), left (the text that stays, breaks as they were).

    Spans that overlap or touch are one island; a blank line right after an island goes with it. The spans must have
    passed `deletion_problems`; one that exceeds its file stops the job, and so nothing is planned by halves.
    """
    spans = merged(units, file=file, start=start, stop=stop).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("islands"), F.sum("spans").alias("units"))  # at most one for every two lines
    rows = files.select(F.col(file).alias("held_file"), kept_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    joined = spans.join(rows, spans["file"] == rows["held_file"])
    n, m = F.size("islands"), F.size("lines")
    after = lambda k: F.get("islands", k)["stop"]
    blank = lambda k: F.coalesce(~T.nonblank(F.get("lines", after(k).cast("int"))) & F.get("lines", after(k).cast("int")).isNotNull(), F.lit(False)).cast("int")
    first = lambda k: F.when(k == 0, F.lit(1)).otherwise((after(k - 1) + 1).cast("int") + blank(k - 1))
    last = lambda k: F.when(k == n, m).otherwise((F.get("islands", k)["start"] - 1).cast("int"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("lines", first(k), F.greatest(last(k) - first(k) + 1, F.lit(0)))))
    inside = F.when(F.element_at("islands", -1)["stop"] > m, F.raise_error(F.lit("a span exceeds its file"))).otherwise(pieces)
    return joined.withColumn("stay", inside).select("file", "units", n.cast("long").alias("islands"), (m - F.size("stay")).cast("long").alias("removed"), F.array_join("stay", "").alias("left"))


def cited(citations: DataFrame, snapshot: DataFrame, current: DataFrame | None = None, *, file: str = "file", start: str = "start", stop: str = "stop",
          text: str = "text", most: int = CITED_LINES) -> DataFrame:
    """`citations` with file_sha256, quote, text_sha256, problem: quotes of whole lines, joined by line feeds.

    `snapshot` has the texts as they were frozen, `current` (the snapshot itself if not given) as they are now. A
    citation has a problem, and no quote, if its file is not in the snapshot, its span is no 1-based range, names more
    than `most` lines, its file changed since, or it ends beyond the file; the first of these is named.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in citations.columns]).alias("row")
    asked = citations.select(row, F.col(file).alias("f"), F.col(start).alias("a"), F.col(stop).alias("b"))
    frozen = snapshot.select(F.col(file).alias("frozen_file"), D.sha(F.col(text)).alias("frozen_sha"), T.lines(F.col(text)).alias("lines"))
    joined = asked.join(frozen, F.col("f") == F.col("frozen_file"), "left").withColumn("now_sha", F.col("frozen_sha"))
    if current is not None:
        now = current.select(F.col(file).alias("now_file"), D.sha(F.col(text)).alias("now_sha"))
        joined = joined.drop("now_sha").join(now, F.col("f") == F.col("now_file"), "left")
    problem = (F.when(F.col("frozen_sha").isNull(), "not in the snapshot")
               .when(F.coalesce((F.col("a") < 1) | (F.col("b") < F.col("a")), F.lit(True)), "invalid span")
               .when(F.col("b") - F.col("a") >= most, "too many lines")
               .when(~F.col("frozen_sha").eqNullSafe(F.col("now_sha")), "source changed")
               .when(F.col("b") > F.size("lines"), "span exceeds file"))
    quote = F.when(F.col("problem").isNull(), F.array_join(F.slice("lines", F.col("a").cast("int"), (F.col("b") - F.col("a") + 1).cast("int")), "\n"))
    out = joined.withColumn("problem", problem).withColumn("quote", quote)
    return out.select("row.*", F.col("frozen_sha").alias("file_sha256"), "quote", D.sha(F.col("quote")).alias("text_sha256"), "problem")


def bound(units: DataFrame, shaped: DataFrame, *, excluded: DataFrame | None = None, id: str = "id") -> DataFrame:
    """Extracted units bound to what became of them: `units` with status, reason, truncated.

    `shaped` (id, status, reason, truncated) says what shaping submitted or dropped; `excluded` (id, reason) what a
    grouping left out. A unit that neither names was dropped as not submitted, and whether it was cut is unknown. The
    ids of units must be unique, and what was shaped must be among them: see `stray`.
    """
    done = shaped.select(F.col(id).alias("shaped_id"), F.col("status").alias("shaped_status"), F.col("reason").alias("shaped_reason"), F.col("truncated").cast("long").alias("truncated"))
    out = units.join(done, F.col(id) == F.col("shaped_id"), "left")
    left_out = F.lit(None).cast("string")
    if excluded is not None:
        rest = excluded.select(F.col(id).alias("excluded_id"), F.coalesce("reason", F.lit("excluded")).alias("excluded_reason"))
        out, left_out = out.join(rest, F.col(id) == F.col("excluded_id"), "left"), F.col("excluded_reason")
    submitted = F.coalesce(F.col("shaped_status") == "submitted", F.lit(False))
    status = F.when(submitted, "submitted").when(left_out.isNotNull(), "excluded").otherwise("dropped")
    reason = F.when(submitted, F.col("shaped_reason")).when(left_out.isNotNull(), left_out).otherwise(F.coalesce("shaped_reason", F.lit("not submitted")))
    return out.select(*[F.col(f"`{c}`") for c in units.columns], status.alias("status"), reason.alias("reason"), "truncated")


def stray(units: DataFrame, shaped: DataFrame, *, id: str = "id") -> DataFrame:
    """Ids that were shaped although no unit has them."""
    return shaped.select(id).distinct().join(units.select(id), id, "left_anti")


def coverage(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: originals, submitted, dropped, excluded, truncated, truncation_unknown, hits, uncovered_hits, complete.

    `entries` come from `bound`, `hits` from `covered`. An extraction is complete if every unit was submitted uncut and
    every hit lies in a unit.
    """
    of = lambda status: F.count_if(F.col("status") == status)
    units = entries.agg(F.count("*").alias("originals"), of("submitted").alias("submitted"), of("dropped").alias("dropped"), of("excluded").alias("excluded"),
                        F.count_if(F.col("truncated") > 0).alias("truncated"), F.count_if(F.col("truncated").isNull()).alias("truncation_unknown"))
    seen = hits.agg(F.count("*").alias("hits"), F.count_if(~F.col("covered")).alias("uncovered_hits"))
    complete = (F.col("submitted") == F.col("originals")) & (F.col("truncated") == 0) & (F.col("truncation_unknown") == 0) & (F.col("uncovered_hits") == 0)
    return units.crossJoin(seen).withColumn("complete", complete)  # one row each
