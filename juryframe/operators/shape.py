"""Shaping: states with outcomes, groups, packing under a budget, request plans, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from juryframe.functions import digest as D, text as T
from juryframe.operators.ordered import run_of, with_rank, with_running
from juryframe.rubric import SEED, STATE_CAP, STATE_TOKENS, Rubric, limits

EMPTY_UNIT = "empty rendered unit"


def states(units: DataFrame, *, id: str = "id", pos: str = "pos", text: str = "text", cap: int = STATE_CAP,
           tokens: Column | None = None) -> DataFrame:
    """Capped text states with their outcome: status, reason, truncated, oversize, unmeasured, state_sha256.

    Bytes bound tokens, so only states above the byte bound are measured; without a `tokens` column those are
    `unmeasured`. Rows whose status is `dropped` keep a null state.
    """
    capped = T.capped(F.col(text), cap)
    rows = units.withColumn("truncated", T.was_capped(F.col(text), cap)).withColumn("state", capped)
    full = T.nonblank(F.col("state"))
    size = F.octet_length(D.json_string(F.col("state")))
    measured = tokens if tokens is not None else F.lit(None).cast("int")
    big = full & (size > STATE_TOKENS)
    kept = [c for c in units.columns if c not in (text,)]
    return rows.select(
        *kept, F.when(full, F.col("state")).alias("state"),
        F.when(full, "submitted").otherwise("dropped").alias("status"),
        F.when(~full, EMPTY_UNIT).when(F.col("truncated") > 0, f"string fields capped at {cap} chars").alias("reason"),
        "truncated", F.coalesce(big & (measured > STATE_TOKENS), F.lit(False)).alias("oversize"),
        (big & measured.isNull()).alias("unmeasured"),
        F.when(full, D.text_digest(F.col("state"))).alias("state_sha256"))


def chunks(units: DataFrame, *, by: str, pos: str, k: int, bucket: Column | None = None) -> DataFrame:
    """Cut each bucket of `by` into chunks of k in order: adds chunk (from 1) and slot (from 0)."""
    if k < 1:
        raise ValueError("k must be positive")
    ranked = with_rank(units, [by], [F.col(pos)], bucket if bucket is not None else run_of(F.col(pos)), "_r")
    return (ranked.withColumn("chunk", F.floor((F.col("_r") - 1) / k).cast("long") + 1)
            .withColumn("slot", ((F.col("_r") - 1) % k).cast("int")).drop("_r"))


def group_states(placed: DataFrame, *, by: str, id: str, text: str, cap: int = STATE_CAP) -> DataFrame:
    """One state per chunk: id `key#n`, slots, JSON state, digest, truncated. A chunk holds at most k units."""
    parts = placed.groupBy(by, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("slot", F.col(id).alias("unit"), F.col(text).alias("text")))).alias("m"),
        F.min("pos").alias("pos"))
    named = F.transform("m", lambda e: F.struct(
        F.concat(F.lit("s"), e["slot"].cast("string")).alias("k"), T.capped(e["text"], cap).alias("v")))
    ordered = F.array_sort(named)
    body = F.array_join(F.transform(ordered, lambda e: F.concat(
        D.json_string(e["k"]), F.lit(":"), D.json_string(e["v"]))), ",")
    key = T.capped(F.col(by), cap)
    state = F.concat(F.lit('{"group":'), D.json_string(key), F.lit(',"units":{'), body, F.lit("}}"))
    cut = F.aggregate("m", F.lit(0), lambda acc, e: acc + T.was_capped(e["text"], cap))
    return parts.select(
        F.concat_ws("#", by, F.col("chunk").cast("string")).alias("id"), "pos", F.col(by).alias("group_key"),
        F.transform("m", lambda e: e["unit"]).alias("slots"), state.alias("state"),
        D.sha(state).alias("state_sha256"), cut.alias("truncated"))


def group(units: DataFrame, *, by: str, id: str = "id", pos: str = "pos", text: str = "text", k: int = 8,
          cap: int = STATE_CAP) -> tuple[DataFrame, DataFrame]:
    """(group states, excluded units). Blank units are excluded with a reason."""
    full = T.nonblank(F.col(text))
    placed = chunks(units.where(full), by=by, pos=pos, k=k)
    excluded = units.where(~full).select(F.col(id).alias("unit"), F.lit(EMPTY_UNIT).alias("reason"))
    return group_states(placed, by=by, id=id, text=text, cap=cap), excluded


def grouping_problems(originals: DataFrame, slots: DataFrame, excluded: DataFrame) -> DataFrame:
    """Violations of the rule that every original appears exactly once, in a slot or in the exclusions."""
    seen = (originals.select(F.col("unit"), F.lit(1).alias("o"), F.lit(0).alias("s"), F.lit(0).alias("e"))
            .unionByName(slots.select("unit", F.lit(0).alias("o"), F.lit(1).alias("s"), F.lit(0).alias("e")))
            .unionByName(excluded.select("unit", F.lit(0).alias("o"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    n = seen.groupBy("unit").agg(F.sum("o").alias("o"), F.sum("s").alias("s"), F.sum("e").alias("e"))
    problem = (F.when(F.col("o") > 1, "repeated original").when(F.col("o") == 0, "not an original")
               .when(F.col("s") > 1, "several slots").when((F.col("s") > 0) & (F.col("e") > 0), "placed and excluded")
               .when(F.col("s") + F.col("e") == 0, "not accounted for"))
    return n.select("unit", problem.alias("problem")).where(F.col("problem").isNotNull())


def request_sizes(states_: DataFrame, rubric: Rubric, *, state: str = "state", tokens: Column | None = None,
                  **budget) -> DataFrame:
    """Size verdict of every request: state with all questions, and state with each question alone.

    ok when bytes fit; otherwise tokens decide when given (over, or ok), else unmeasured. The question side is a
    handful of constants, so this is a projection: no join and no shuffle.
    """
    total, single = limits(**budget)
    sizes = {qid: len(text.encode()) for qid, text in rubric.texts().items()}
    size = F.octet_length(D.json_string(F.col(state)))
    measured = tokens if tokens is not None else F.lit(None).cast("int")

    def verdict(extra: int, limit: int) -> tuple[Column, Column]:
        status = (F.when(size + extra <= limit, "ok").when(measured.isNull(), "unmeasured")
                  .when(measured > limit, "over").when(measured + extra <= limit, "ok").otherwise("unmeasured"))
        upper = F.when(size + extra <= limit, size + extra).otherwise(F.coalesce(measured, size) + extra)
        return status, upper

    rank = lambda s: F.when(s == "over", 2).when(s == "unmeasured", 1).otherwise(0)
    whole, whole_upper = verdict(sum(sizes.values()), total)
    singles = []
    for i, (qid, extra) in enumerate(sizes.items()):
        s, u = verdict(extra, single)
        singles.append(F.struct(rank(s).alias("rank"), u.alias("upper"), F.lit(-i).alias("o"), F.lit(qid).alias("qid"), s.alias("status")))
    worst = F.array_max(F.array(*singles))
    both = F.greatest(rank(whole), worst["rank"])
    return states_.select(
        "id", size.alias("state_bytes"), whole.alias("total_status"), whole_upper.alias("total_upper"),
        worst["qid"].alias("worst_question"), worst["upper"].alias("single_upper"),
        F.element_at(F.array(F.lit("ok"), F.lit("unmeasured"), F.lit("over")), both + 1).alias("status"))


def plan(requests: DataFrame, rubric: Rubric, *, single: int = 32_000) -> DataFrame:
    """One row: admissible, over, unmeasured, and whether packing many small requests is worth a pilot.

    The median is taken over counted sizes, so the aggregate sees one entry per distinct size.
    """
    sizes = requests.groupBy("single_upper", "status").agg(F.count("*").alias("n"))
    wide = [qid for qid, q in rubric.items() if q.kind == "choice" and len(q.criteria) > 255]
    out = sizes.agg(
        F.sum("n").alias("requests"), F.coalesce(F.sum(F.when(F.col("status") == "over", F.col("n"))), F.lit(0)).alias("over_budget"),
        F.coalesce(F.sum(F.when(F.col("status") == "unmeasured", F.col("n"))), F.lit(0)).alias("unmeasured"),
        F.expr("percentile(single_upper, 0.5, n)").alias("median_upper"))
    return (out.withColumn("admissible", (F.col("over_budget") == 0) & (F.col("unmeasured") == 0) & F.lit(not wide))
            .withColumn("pack_suggested", (F.col("requests") >= 20) & (F.col("median_upper") < 0.10 * single)))


def _next_start(sizes: np.ndarray, capacity: int, k: int) -> np.ndarray:
    """For a group opened at each row, the row that opens the next group (first fit fails, or k reached)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    fit = np.searchsorted(total, total[:-1] + capacity, side="right") - 1
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(fit, at + 1), at + k)


def pack(units: DataFrame, *, by: str, id: str, pos: str, size: str, base: Column, capacity: int, k: int = 8,
         width: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Greedy packing per bucket: (placed rows with chunk and slot, excluded rows).

    A group closes before it would exceed `capacity` or k units. `size` is the bytes a unit adds, `base` the bytes
    of an empty group. A unit too large alone is excluded.

    Where a group starts depends on all units before it, but a group never spans more than k rows. So each run of
    `width` rows is summarised by k entries (if the first group starts at row e, where does the next run begin and
    how many groups opened), runs are chained through these small tables, and every run is then cut on its own. The
    result equals the sequential one, and no task reads a whole bucket.
    """
    room = F.lit(capacity) - base
    alone = F.col(size) <= room
    excluded = units.where(~alone).select(F.col(id).alias("unit"), F.lit("one-unit request does not fit").alias("reason"))
    fits = units.where(alone).select(F.col(by).alias("b"), F.col(id).alias("unit"), F.col(pos).alias("p"),
                                     F.col(size).cast("long").alias("size"), room.cast("long").alias("room"))
    ranked = with_rank(fits, ["b"], [F.col("p")], run_of(F.col("p")), "r").withColumn("r", F.col("r") - 1)
    run = F.floor(F.col("r") / width).cast("long")
    halo = F.when((F.col("r") % width < k) & (run > 0), run - 1)
    spread = ranked.select("*", run.alias("home"), F.explode(F.array_compact(F.array(run, halo))).alias("run"))
    key_type = dict(fits.dtypes)["b"]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        own = int((pdf["home"] == pdf["run"]).sum())
        nxt = _next_start(pdf["size"].to_numpy(), int(pdf["room"].iloc[0]), k)
        exits, opened = [], []
        for entry in range(k):
            row, count = entry, 0
            while row < own:
                row, count = int(nxt[row]), count + 1
            exits.append(row - own)
            opened.append(count)
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "run": [pdf["run"].iloc[0]], "exits": [exits], "opened": [opened]})

    tables = spread.groupBy("b", "run").applyInPandas(
        summarise, f"b {key_type}, run long, exits array<long>, opened array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, groups, rows = 0, 0, []
        for b, r, exits, opened in pdf.sort_values("run")[["b", "run", "exits", "opened"]].itertuples(index=False):
            rows.append((b, r, entry, groups))
            groups += int(opened[entry])
            entry = int(exits[entry])
        return pd.DataFrame(rows, columns=["b", "run", "entry", "before"])

    # One row per run reaches this group: rows / width of a bucket, not its rows.
    starts = tables.groupBy("b").applyInPandas(chain, f"b {key_type}, run long, entry long, before long")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r").reset_index(drop=True)
        own = int((pdf["home"] == pdf["run"]).sum())
        nxt = _next_start(pdf["size"].to_numpy(), int(pdf["room"].iloc[0]), k)
        first = np.zeros(len(pdf), dtype=bool)
        row = int(pdf["entry"].iloc[0])
        while row < own:
            first[row] = True
            row = int(nxt[row])
        chunk = np.cumsum(first) + int(pdf["before"].iloc[0])
        at = np.arange(len(pdf))
        anchor = np.maximum.accumulate(np.where(first, at, -1))
        # Rows before the first start belong to the last group of the run before: their slot is set by the caller.
        pdf["chunk"], pdf["slot"] = chunk, np.where(anchor >= 0, at - anchor, -1)
        return pdf[:own][["b", "unit", "p", "r", "chunk", "slot"]]

    unit_type = dict(fits.dtypes)["unit"]
    placed = spread.join(starts, ["b", "run"]).groupBy("b", "run").applyInPandas(
        cut, f"b {key_type}, unit {unit_type}, p long, r long, chunk long, slot long")
    # A group that began in the run before has at most k rows, so its slots come from a rank inside the chunk.
    slot = F.row_number().over(Window.partitionBy("b", "chunk").orderBy("r")) - 1
    out = placed.withColumn("slot", slot)
    return out.select(F.col("b").alias(by), F.col("unit").alias(id), F.col("p").alias(pos), "chunk", "slot"), excluded


def admit_within(units: DataFrame, *, id: str, pos: str, size: str, total: int, each: int) -> DataFrame:
    """Take units in order while the running total stays within `total`; one that does not fit is skipped, not a stop.

    Between two skips the taken units are a plain prefix. Each round takes the longest prefix that fits by one
    distributed running sum, then drops the units that can no longer fit. Only two numbers come to the driver per
    round. At most `total` bytes are ever taken, so the rounds are few.
    """
    left, after, taken = total, None, None
    pool = units.where(F.col(size) <= each)
    while True:
        rows = pool.where(F.col(size) <= left)
        if after is not None:
            rows = rows.where(F.col(pos) > after)
        summed = with_running(rows.select(id, pos, size), [], [F.col(pos)], run_of(F.col(pos)), sums={"_sum": F.col(size)})
        prefix = summed.where(F.col("_sum") <= left)
        got = prefix.agg(F.count("*").alias("n"), F.max("_sum").alias("used"), F.max(pos).alias("last")).first()
        if not got["n"]:
            break
        chosen = pool.where(F.col(size) <= left).where(F.col(pos) <= got["last"])
        if after is not None:
            chosen = chosen.where(F.col(pos) > after)
        chosen = chosen.select(id)
        taken = chosen if taken is None else taken.unionByName(chosen)
        left, after = left - int(got["used"]), got["last"]
    flag = F.coalesce(F.col("_in"), F.lit(False))
    if taken is None:
        return units.withColumn("admitted", F.lit(False))
    return units.join(taken.withColumn("_in", F.lit(True)), id, "left").withColumn("admitted", flag).drop("_in")


def sample(units: DataFrame, n: int = 60, *, id: str = "id", seed: int = SEED) -> DataFrame:
    """n units without replacement in digest order: the same seed gives the same units on any cluster."""
    if n < 0:
        raise ValueError("n must not be negative")
    return units.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id)), 256), id).limit(n)
