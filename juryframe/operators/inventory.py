"""Inventories of sources compared by content, and the records that a change makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot(files: DataFrame, *, name: str = "name", text: str = "text") -> DataFrame:
    """name, sha256. A null text is a file that can't be read: its digest is null."""
    return files.select(F.col(name).alias("name"), F.sha2(F.col(text), 256).alias("sha256"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change, old_sha256, new_sha256, moved_from for every name that differs between two snapshots.

    "changed" if both have the name with different contents; "removed" if only the old one has it; "added" if only the
    new one has it, or "moved" if exactly that content was removed elsewhere: then `moved_from` is the least such name.
    Files that can't be read on either side count as changed. Names must be unique in a snapshot.
    """
    both = old.select("name", F.col("sha256").alias("old_sha256"), F.lit(True).alias("was")).join(new.select("name", F.col("sha256").alias("new_sha256"), F.lit(True).alias("is")), "name", "full")
    same = F.col("was") & F.col("is") & (F.col("old_sha256") == F.col("new_sha256"))
    odd = both.where(~F.coalesce(same, F.lit(False)))
    gone = odd.where(F.col("is").isNull() & F.col("old_sha256").isNotNull()).groupBy(F.col("old_sha256").alias("gone_sha")).agg(F.min("name").alias("gone_name"))
    out = odd.join(gone, F.col("was").isNull() & (F.col("new_sha256") == F.col("gone_sha")), "left")
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNotNull(), "changed").when(F.col("gone_name").isNotNull(), "moved").otherwise("added")
    return out.select("name", change.alias("change"), "old_sha256", "new_sha256", F.col("gone_name").alias("moved_from"))


def stale_records(depends: DataFrame, changes: DataFrame) -> DataFrame:
    """record, changed, removed, moved: records with a dependency (record, name) that is not as it was.

    An added file makes no record stale by itself; a moved one is gone from where the record looks for it.
    """
    bad = changes.where("change IN ('changed', 'removed')").select("name", "change")
    away = changes.where("change = 'moved'").select(F.col("moved_from").alias("name")).distinct().withColumn("away", F.lit(True))
    hit = depends.select("record", "name").distinct().join(bad, "name").join(away, "name", "left")
    is_ = lambda c: F.count_if(F.col("change") == c)
    return hit.groupBy("record").agg(is_("changed").alias("changed"), F.count_if((F.col("change") == "removed") & F.col("away").isNull()).alias("removed"), F.count_if("away").alias("moved"))


def stale_by_group(refers: DataFrame, members: DataFrame, changes: DataFrame) -> DataFrame:
    """`stale_records` of records that depend on whole groups: `refers` (record, group), `members` (group, name).

    The names of a group are counted once, so pairs of a record and a name are never formed. A name in two groups, which
    a record that refers to both would count twice, stops the job.
    """
    held = members.where(F.col("group").isNotNull() & F.col("name").isNotNull()).groupBy("name").agg(F.min("group").alias("record"), F.max("group").alias("_hi"))
    held = held.where(F.when(F.col("_hi") != F.col("record"), F.raise_error(F.concat(F.lit("in two groups: "), F.col("name"))).cast("boolean")).otherwise(F.lit(True)))
    per = stale_records(held.select("record", "name"), changes).withColumnRenamed("record", "group")
    return refers.select("record", "group").distinct().join(per, "group").groupBy("record").agg(*[F.sum(c).alias(c) for c in ("changed", "removed", "moved")])


def refreshed(old_records: DataFrame, new_records: DataFrame, stale: DataFrame, *, rubric_changed: bool = False) -> DataFrame:
    """record, fate: what a new run may take over. Records are (record, sha256) of all that was put before the judge.

    "added" and "removed" records; "rubric_changed" for all others if the questions did; "changed" if a record's own
    digest did; "stale" if only its dependencies did; else "reusable".
    """
    one = old_records.select("record", F.col("sha256").alias("a"), F.lit(True).alias("was"))
    two = new_records.select("record", F.col("sha256").alias("b"), F.lit(True).alias("is"))
    rows = one.join(two, "record", "full").join(stale.select("record", F.lit(True).alias("touched")), "record", "left")
    fate = (F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.lit(rubric_changed), "rubric_changed")
            .when(~F.col("a").eqNullSafe(F.col("b")), "changed").when(F.col("touched"), "stale").otherwise("reusable"))
    return rows.select("record", fate.alias("fate"))
