"""Hunk states: each hunk with its nearest hunks in the file and the hunks that use a name it defines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from juryframe.functions import text as T
from juryframe.operators.ordered import run_of, with_rank
from juryframe.session import written

# Fixed pattern of a definition at the start of an added line.
DEFINES = (r"(?md)^\+([ \t]*)(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?"
           r"(?:def|class|function|fn|struct|enum|trait|interface|type|func|const|let|var)\s+([A-Za-z_][\p{L}\p{N}_]*)")
NAME = r"[A-Za-z_][\p{L}\p{N}_]*"


def changed(hunk: Column, marks: str) -> Column:
    """Lines after the header that start with one of `marks`."""
    body = F.split(hunk, r"\r?\n", -1)
    return F.filter(T.tail(body, F.lit(2)), lambda line: F.left(line, F.lit(1)).isin(*marks))


def brief(file: Column, header: Column, hunk: Column) -> Column:
    """File, header and changed lines of a hunk, whole."""
    return F.concat(file, F.lit(" "), header, F.lit("\n"), F.array_join(changed(hunk, "+-"), "\n"))


def neighbours(units: DataFrame, *, file: str, id: str, anchor: str, pos: str, k: int, width: int = 10_000) -> DataFrame:
    """The k units of the same file nearest by line, ties in input order: (id, near array<id>).

    Within one line only the first k+1 units by position can be chosen, so lines are reduced to that many. Then the
    chosen ones lie within k lines on either side. Lines are ranked per file and cut into runs with a border of k
    lines copied to both neighbours, so no task sees a whole file and no pairs are formed. Units of one line have the
    same distances, so a line orders its candidates once; a unit only leaves itself out. The units are read three times
    and written once before.
    """
    base = written(units.select(F.col(file).alias("f"), F.col(id).alias("i"), F.col(anchor).cast("long").alias("a"),
                                F.col(pos).alias("p")))
    first = Window.partitionBy("f", "a").orderBy("p")
    per_line = (base.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                .groupBy("f", "a").agg(F.collect_list(F.struct("p", "i")).alias("m")))
    ranked = with_rank(per_line, ["f"], [F.col("a")], run_of(F.col("a")), "r")
    run, edge = F.floor((F.col("r") - 1) / width), (F.col("r") - 1) % width
    homes = F.array_compact(F.array(run, F.when(edge < k, run - 1), F.when(edge >= width - k, run + 1)))
    spread = ranked.select("f", "a", "m", "r", run.alias("home"), F.explode(homes).alias("run"))
    around = Window.partitionBy("f", "run").orderBy("a").rowsBetween(-k, k)
    near = spread.withColumn("near", F.flatten(F.collect_list(
        F.transform("m", lambda e: F.struct(F.col("a").alias("a"), e["p"].alias("p"), e["i"].alias("i")))).over(around)))
    near = near.where(F.col("run") == F.col("home"))
    options = F.transform("near", lambda e: F.struct(F.abs(e["a"] - F.col("a")).alias("d"), e["p"].alias("p"), e["i"].alias("i")))
    near = near.select("f", "a", F.transform(F.array_sort(options), lambda e: e["i"]).alias("all"))
    # one more than k is enough, unless a unit could be among them twice
    lead = F.slice("all", 1, k + 1)
    near = near.select("f", "a", F.when(F.size(F.array_distinct(lead)) == F.size(lead), lead).otherwise(F.col("all")).alias("all"))
    joined = base.join(near, ["f", "a"])
    return joined.select(F.col("i").alias(id), F.slice(F.filter("all", lambda e: e != F.col("i")), 1, k).alias("near"))


def name_users(units: DataFrame, near: DataFrame, *, id: str, pos: str, siblings: int, users: int) -> DataFrame:
    """Up to `users` other units that use a name a unit defines: by definition order, then input order.

    A unit can rule out itself, its near units and the users already chosen. So only the first
    `1 + siblings + users` users of a name can ever be taken, and the rest of a very common name is left out exactly.
    """
    need = 1 + siblings + users
    depth = F.regexp_extract_all("hunk", F.lit(DEFINES), 1)
    names = F.regexp_extract_all("hunk", F.lit(DEFINES), 2)
    defs = units.select(F.col(id).alias("id_"), F.posexplode(F.arrays_zip(depth.alias("depth"), names.alias("name"))))
    defs = written(defs.select("id_", "pos", F.col("col.name").alias("name"), F.length(
        F.replace(F.col("col.depth"), F.lit("\t"), F.lit("    "))).alias("depth")).where(~F.col("name").startswith("__")))
    outer = defs.groupBy("id_").agg(F.min("depth").alias("depth"))
    defs = written(defs.join(outer, ["id_", "depth"]).groupBy("id_", "name").agg(F.min("pos").alias("def_pos")))
    words = units.select(F.col(id).alias("user"), F.col(pos).alias("user_pos"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.array_join(changed(F.col("hunk"), "+"), "\n"), F.lit(f"({NAME})"), 1))).alias("name"))
    words = words.join(defs.select("name").distinct(), "name", "left_semi")
    order = Window.partitionBy("name").orderBy("user_pos")
    index = words.withColumn("n", F.row_number().over(order)).where(F.col("n") <= need).drop("n")
    pairs = defs.join(index, "name").where(F.col("user") != F.col("id_"))
    pairs = pairs.join(near.select(F.col(id).alias("id_"), "near"), "id_").where(~F.array_contains("near", F.col("user")))
    first = pairs.groupBy("id_", "user").agg(F.min(F.struct("def_pos", "user_pos")).alias("o"))
    top = first.groupBy("id_").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "user"))), 1, users).alias("u"))
    return top.select(F.col("id_").alias(id), F.transform("u", lambda e: e["user"]).alias("callers"))


def hunk_states(units: DataFrame, *, id: str = "id", pos: str = "pos", siblings: int = 6, users: int = 3) -> DataFrame:
    """State columns of every hunk: file, status, hunk, nearest and using hunks as short texts.

    The units are read in many places, so they are written once before: nothing that makes them runs again.
    """
    u = written(units.select(
        F.col(id), F.col(pos), "file", "status", "header", "hunk",
        F.coalesce(F.nullif("line", F.lit(0)), F.nullif("old_line", F.lit(0)), F.lit(0)).alias("_anchor")))
    near = written(neighbours(u, file="file", id=id, anchor="_anchor", pos=pos, k=siblings))
    callers = written(name_users(u, near, id=id, pos=pos, siblings=siblings, users=users))
    briefs = u.select(F.col(id).alias("other"), F.struct("file", "header", "hunk").alias("whole"))

    def texts(df: DataFrame, ids: str, name: str) -> DataFrame:
        flat = df.select(id, F.posexplode(ids).alias("n", "other"))
        # few units may be named by very many: only those named are joined, so that a short list is sent to all
        named = briefs.join(flat.select("other").distinct(), "other", "left_semi").select(
            "other", brief(F.col("whole.file"), F.col("whole.header"), F.col("whole.hunk")).alias("text"))
        flat = flat.join(named, "other")
        got = flat.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
        return got.select(id, F.transform("t", lambda e: e["text"]).alias(name))

    out = u.select(id, "file", "status", "hunk")
    for df, ids, name in ((near, "near", "nearest_sibling_hunks"), (callers, "callers", "hunks_using_names_defined_here")):
        out = out.join(texts(df, ids, name), id, "left").withColumn(
            name, F.coalesce(name, F.array().cast("array<string>")))
    return out
