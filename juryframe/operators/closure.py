"""What records depend on: references followed breadth first to a fixed point, all records at once, one join a level.

Each level is written before the next joins it, so the lineage stays short and a lost executor replays one level. A
node is expanded once for each record, by the shortest way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from juryframe.session import cut_lineage

READY, MISSING, EXHAUSTED = "ready", "missing_evidence", "expansion_exhausted"


def _roots(seeds: DataFrame, record: str, source: str) -> DataFrame:
    return seeds.where(F.col(source).isNotNull()).select(F.col(record).alias("record"), F.col(source).alias("source")).distinct()


def closure(seeds: DataFrame, references: DataFrame, registry: DataFrame, *, depth: int, record: str = "record", source: str = "source", target: str = "target") -> DataFrame:
    """record, source, depth, parent, path, status: every source that a record needs, as first reached.

    `seeds` names the sources a record starts from, `references` which source refers to which, `registry` the sources
    that exist. Of several shortest ways the one over the least parent counts; `path` holds the sources above. A source
    that isn't registered is "missing_evidence"; one deeper than `depth` is "expansion_exhausted"; neither is expanded.
    Null sources and targets refer to nothing; repeated rows count once; a cycle ends where it meets a source again.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    edges = references.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("u"), F.col(target).alias("v")).distinct()
    known = registry.select(F.col(source).alias("known")).where("known IS NOT NULL").distinct()
    levels, seen, level = [], None, 0
    none = F.lit(None).cast(references.schema[source].dataType)
    frontier = _roots(seeds, record, source).select("record", "source", none.alias("parent"), F.array().cast(f"array<{references.schema[source].dataType.simpleString()}>").alias("path"))
    while True:
        status = F.when(F.col("known").isNull(), MISSING).when(F.lit(level) > depth, EXHAUSTED).otherwise(READY)
        now = cut_lineage(frontier.join(known, F.col("source") == F.col("known"), "left").select("record", "source", F.lit(level).alias("depth"), "parent", "path", status.alias("status")))
        if now.isEmpty():
            break
        levels.append(now)
        places = now.select(F.col("record").alias("r"), F.col("source").alias("s"))
        seen = places if seen is None else seen.unionByName(places)
        if level > depth:
            break
        step = now.where(F.col("status") == READY).join(edges, F.col("source") == F.col("u")).select("record", F.col("v").alias("source"), F.col("u").alias("parent"), F.concat("path", F.array("u")).alias("path"))
        least = step.groupBy("record", "source").agg(F.min(F.struct("parent", "path")).alias("w"))
        frontier = least.join(seen, (F.col("record") == F.col("r")) & (F.col("source") == F.col("s")), "left_anti").select("record", "source", "w.parent", "w.path")
        level += 1
    return reduce(DataFrame.unionByName, levels) if levels else now


def cycles(nodes: DataFrame, references: DataFrame, *, source: str = "source", target: str = "target") -> DataFrame:
    """record, source, target: references from an expanded source back to itself or to one above it, which establish nothing."""
    edges = references.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("u"), F.col(target).alias("v")).distinct()
    above = nodes.where(F.col("status") == READY).select("record", "source", F.concat("path", F.array("source")).alias("above"))
    return above.join(edges, F.col("source") == F.col("u")).where(F.array_contains("above", F.col("v"))).select("record", "source", F.col("v").alias("target"))


def blocked(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """record, sources, missing, exhausted, cycles, ready: a record is ready if all it needs is there and no way ran out."""
    of = lambda s: F.count_if(F.col("status") == s)
    per = nodes.groupBy("record").agg(F.count("*").alias("sources"), of(MISSING).alias("missing"), of(EXHAUSTED).alias("exhausted"))
    held = rings.groupBy(F.col("record").alias("ring_record")).agg(F.count("*").alias("cycles"))
    out = per.join(held, F.col("record") == F.col("ring_record"), "left").withColumn("cycles", F.coalesce("cycles", F.lit(0))).drop("ring_record")
    return out.withColumn("ready", (F.col("missing") == 0) & (F.col("exhausted") == 0) & (F.col("cycles") == 0))
