"""Scores of verdicts against a key, paired intervals over cases, and the rule that decides between two arms.

Denominators come from the key: an item without a verdict, with a failed one or with repeated verdicts that differ stays
in them and earns nothing. A rate over nothing is null, never zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Labels of plain verdicts (fixed values).
FLAGGED, CLEARED, NOT_MENTIONED = "flagged", "cleared", "not_mentioned"
#: Facets, their labels, and the label of each that is an honest "can't tell" (fixed values).
FACETS = {"factual": ("supported", "refuted", "underdetermined", "omitted"), "action": ("fix_now", "defer", "no_action", "investigate", "omitted"), "introduced": ("yes", "no", "unknown", "omitted")}
UNSURE = {"factual": "underdetermined", "action": "investigate", "introduced": "unknown"}
#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom; beyond, the normal one (fixed values).
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069,
        2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
NORMAL_95 = 1.96


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _single(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; a value on which repeated rows differ is null."""
    agreed = lambda v: F.when((F.min(v) == F.max(v)) & (F.count(v) == F.count("*")), F.min(v)).alias(v)
    return rows.groupBy(*keys).agg(*[agreed(v) for v in values])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same, "left").drop(*[f"_r_{k}" for k in keys])


def item_scores(truth: DataFrame, verdicts: DataFrame, errors: DataFrame | None = None, *, case: str = "case", item: str = "item") -> DataFrame:
    """Scores of each case and, with a null case and `overall` true, of all: `truth` has flag (null: the key is open), `verdicts` label.

    Items named in `errors` have no label. A flag on an item whose key is open counts against precision; everything that
    isn't flagged counts as missed where the key says flag.
    """
    keys = [case, item]
    rows = _joined(truth.select(*keys, "flag"), _single(verdicts, keys, ["label"]), keys)
    if errors is not None:
        rows = _joined(rows, errors.select(*keys, F.lit(True).alias("failed")).distinct(), keys).withColumn("label", F.when(F.col("failed").isNull(), F.col("label")))
    flagged, says = F.coalesce(F.col("label") == FLAGGED, F.lit(False)), F.col("flag")
    count = lambda c, name: F.count_if(c).alias(name)
    known = F.coalesce(F.col("label").isin(FLAGGED, CLEARED, NOT_MENTIONED), F.lit(False))
    rows = rows.withColumns({"k_": F.struct(F.col(case).alias("case"))})  # a null case is a case; only the total has no struct
    out = rows.cube("k_").agg(
        count(flagged & says, "tp"), count(flagged & ~says, "fp"), count(flagged & says.isNull(), "unresolved_flags"), count(says & ~flagged, "fn"),
        count((says & flagged) | (~says & (F.col("label") == CLEARED)), "correct"), F.count("*").alias("planned_items"), count(says.isNull() | ~known, "unresolved"),
        count(says.isNull(), "key_unresolved"), count(F.col("label") == NOT_MENTIONED, "omitted"))
    tp, fp = F.col("tp"), F.col("fp")
    return out.select(F.col("k_.case").alias("case"), F.col("k_").isNull().alias("overall"), "tp", "fp", "fn", _rate(tp, tp + F.col("fn")).alias("recall"), _rate(tp, tp + fp + F.col("unresolved_flags")).alias("precision"),
                      "unresolved_flags", "planned_items", "correct", _rate(F.col("correct"), F.col("planned_items")).alias("accuracy"), "unresolved", "key_unresolved", "omitted")


def _decided(key: DataFrame, verdicts: DataFrame, errors: DataFrame | None, unattributed: DataFrame | None) -> DataFrame:
    """The key with the usable label of each facet (said_*) and whether its attribution was rejected."""
    keys = ["case", "item"]
    said = _single(verdicts, keys, list(FACETS)).select(*keys, *[F.when(F.col(f).isin(*labels), F.col(f)).alias(f"said_{f}") for f, labels in FACETS.items()])
    rows = _joined(key, said, keys)
    if errors is not None:
        lost = errors.groupBy(*keys).agg(F.collect_set(F.coalesce("facet", F.lit("*"))).alias("lost"))
        rows = _joined(rows, lost, keys)
        bad = lambda f: F.coalesce(F.arrays_overlap("lost", F.array(F.lit("*"), F.lit(f))), F.lit(False))
        rows = rows.withColumns({f"said_{f}": F.when(~bad(f), F.col(f"said_{f}")) for f in FACETS}).drop("lost")
    rejected = F.lit(False)
    if unattributed is not None:
        rows = _joined(rows, unattributed.select(*keys, F.lit(True).alias("rejected")).distinct(), keys)
        rejected = F.coalesce("rejected", F.lit(False))
    rows = rows.withColumn("rejected", rejected)
    return rows.withColumns({f"said_{f}": F.when(~F.col("rejected"), F.col(f"said_{f}")) for f in FACETS})


def facet_scores(key: DataFrame, verdicts: DataFrame, errors: DataFrame | None = None, unattributed: DataFrame | None = None) -> DataFrame:
    """One row per case and facet: planned, correct, accuracy, covered, coverage, omitted, extraction_errors, unattributed, unresolved, asserted_uncertain, key_uncertain.

    `key` has case, item, factual, introduced, actions (all that are right) and defect; `verdicts` case, item and the
    three facets; `errors` case, item and facet (null: all of them); `unattributed` case and item whose attribution was
    rejected, so that whatever was said of them is void.
    """
    rows = _decided(key, verdicts, errors, unattributed)
    per = []
    for f in FACETS:
        right = F.col("actions") if f == "action" else F.array(f)
        per.append(F.struct(F.lit(f).alias("facet"), F.col(f"said_{f}").alias("said"), F.coalesce(F.array_contains(right, F.col(f"said_{f}")), F.lit(False)).alias("right"),
                            F.coalesce(F.array_contains(right, F.lit(UNSURE[f])), F.lit(False)).alias("key_unsure"), F.lit(UNSURE[f]).alias("unsure")))
    long = rows.select("case", "rejected", F.explode(F.array(*per)).alias("f")).select("case", "rejected", "f.*")
    omitted, none = F.col("said") == "omitted", F.col("said").isNull()
    out = long.groupBy("case", "facet").agg(
        F.count("*").alias("planned"), F.count_if(F.col("right") & ~omitted).alias("correct"), F.count_if(~omitted).alias("covered"), F.count_if(omitted).alias("omitted"),
        F.count_if(none & ~F.col("rejected")).alias("extraction_errors"), F.count_if(none & F.col("rejected")).alias("unattributed"), F.count_if(none).alias("unresolved"),
        F.count_if(F.col("said") == F.col("unsure")).alias("asserted_uncertain"), F.count_if("key_unsure").alias("key_uncertain"))
    return out.withColumns({"accuracy": _rate(F.col("correct"), F.col("planned")), "coverage": _rate(F.col("covered"), F.col("planned"))})


def repair_scores(key: DataFrame, verdicts: DataFrame, errors: DataFrame | None = None, unattributed: DataFrame | None = None) -> DataFrame:
    """One row per case: planned_defects, predicted_defects, tp, fp, fn, recall, precision, unsupported (claims to fix now without warrant).

    Claims about one defect count once, and only if every claim that would fix it is warranted: the key wants it fixed
    now, it is supported, and where it came from is said rightly. A claim that names no defect stands for itself.
    """
    rows = _decided(key, verdicts, errors, unattributed)
    wanted = F.array_contains("actions", F.lit("fix_now"))
    warranted = F.coalesce(wanted & (F.col("factual") == "supported") & (F.col("said_factual") == "supported") & (F.col("introduced") == F.col("said_introduced"))
                           & F.col("said_introduced").isin("yes", "no"), F.lit(False))
    selects = F.coalesce(F.col("said_action") == "fix_now", F.lit(False))
    named = F.when(F.length("defect") > 0, F.col("defect"))
    goal = F.struct(named.alias("defect"), F.when(named.isNull(), F.col("item")).alias("item"))
    per = rows.select("case", goal.alias("g"), selects.alias("selects"), warranted.alias("warranted"), (wanted & named.isNotNull()).alias("wanted"), wanted.alias("planned"))
    goals = per.groupBy("case", "g").agg(F.bool_or("selects").alias("selected"), F.bool_and(F.when(F.col("selects"), F.col("warranted"))).alias("all_warranted"),
                                         F.count_if(F.col("selects") & ~F.col("warranted")).alias("unsupported"), F.bool_or("wanted").alias("wanted"))
    tp = F.col("selected") & F.coalesce("all_warranted", F.lit(False)) & F.col("g.defect").isNotNull()
    out = goals.groupBy("case").agg(F.count_if("wanted").alias("planned_defects"), F.count_if("selected").alias("predicted_defects"), F.count_if(tp).alias("tp"),
                                    F.count_if(F.col("selected") & ~tp).alias("fp"), F.count_if(F.col("wanted") & ~tp).alias("fn"), F.sum("unsupported").alias("unsupported"))
    return out.withColumns({"recall": _rate(F.col("tp"), F.col("planned_defects")), "precision": _rate(F.col("tp"), F.col("predicted_defects"))})


def control_summary(rows: DataFrame, *, case: str = "case", final: str = "final_attempt", correct: str = "correct") -> DataFrame:
    """block ("overall", "final_attempt", "case"), case, n, scored, correct, accuracy. An unscored attempt (null) stays in n."""
    blocks = F.array(F.struct(F.lit("overall").alias("block"), F.lit(None).cast("string").alias("case")),
                     F.when(F.col(final), F.struct(F.lit("final_attempt").alias("block"), F.lit(None).cast("string").alias("case"))),
                     F.struct(F.lit("case").alias("block"), F.col(case).cast("string").alias("case")))
    long = rows.select(F.explode(F.array_compact(blocks)).alias("b"), F.col(correct).alias("right"))
    out = long.groupBy("b").agg(F.count("*").alias("n"), F.count("right").alias("scored"), F.count_if("right").alias("correct"))
    return out.select("b.block", "b.case", "n", "scored", "correct", F.round(F.col("correct") / F.col("n"), 3).alias("accuracy"))


def case_means(runs: DataFrame, metrics: list[str], *, case: str = "case", by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """metric, case, value: mean of each metric over the runs of a case to so many digits, nulls left out; repetitions of a case are no units of their own."""
    by = by or []
    per = runs.groupBy(*by, F.col(case).alias("case")).agg(*[F.avg(m).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), digits).alias("value")) for m in metrics])
    return per.select(*by, "case", F.explode(pairs).alias("p")).select(*by, "p.metric", "case", "p.value")


def paired_intervals(base: DataFrame, current: DataFrame, *, by: list[str], digits: int = 6) -> DataFrame:
    """For each `by`: n, unpaired, mean_delta, df, t_critical, low, high of the differences current less base, one for each case.

    Both sides have `by`, case, value, one row per case. A case that one side lacks or has without a value is unpaired.
    With fewer than two pairs there is no interval, with none no mean. Differences and results are rounded to `digits`.
    """
    one = base.select(*by, "case", F.col("value").alias("b"), F.lit(None).cast("double").alias("c"))
    two = current.select(*by, "case", F.lit(None).cast("double").alias("b"), F.col("value").alias("c"))
    cases = one.unionByName(two).groupBy(*by, "case").agg(F.max("b").alias("b"), F.max("c").alias("c")).withColumn("d", F.round(F.col("c") - F.col("b"), digits))
    out = cases.groupBy(*by).agg(F.count("d").alias("n"), F.count_if(F.col("d").isNull()).alias("unpaired"), F.avg("d").alias("mean"), F.var_samp("d").alias("var"))
    df = F.when(F.col("n") >= 2, F.col("n") - 1)
    t = F.when(df > len(T_95), NORMAL_95).otherwise(F.get(F.array(*map(F.lit, T_95)), (df - 1).cast("int")))
    half = t * F.sqrt(F.col("var") / F.col("n"))
    return out.select(*by, "n", "unpaired", F.round("mean", digits).alias("mean_delta"), df.alias("df"), F.when(df.isNotNull(), t).alias("t_critical"),
                      F.when(df.isNotNull(), F.round(F.col("mean") - half, digits)).alias("low"), F.when(df.isNotNull(), F.round(F.col("mean") + half, digits)).alias("high"))


def threshold_choice(intervals: DataFrame, roles: dict[str, str], *, by: list[str], min_cases: int, correctness_min_delta: float, coverage_max_regression: float,
                     unsafe_max_increase: float) -> DataFrame:
    """`by`, verdict, reason from the intervals of three metrics; `roles` names those of correctness, coverage and unsafe.

    "inconclusive" without all three intervals or with too few cases; "contradicts_candidate" where a bound is broken
    beyond chance; "supports_candidate" where all bounds hold beyond chance; else "inconclusive".
    """
    if set(roles) != {"correctness", "coverage", "unsafe"} or min_cases < 2 or any(not math.isfinite(x) for x in (correctness_min_delta, coverage_max_regression, unsafe_max_increase)):
        raise ValueError("a rule names three roles, two cases or more, and finite bounds")
    side = lambda role: F.max(F.when(F.col("metric") == roles[role], F.struct("n", "low", "high"))).alias(role)
    rows = intervals.groupBy(*by).agg(*[side(r) for r in ("correctness", "coverage", "unsafe")])
    c, v, u = ("correctness", "coverage", "unsafe")
    missing = F.col(f"{c}.low").isNull() | F.col(f"{v}.low").isNull() | F.col(f"{u}.low").isNull()
    few = F.least(f"{c}.n", f"{v}.n", f"{u}.n") < min_cases
    harmful = F.col(f"{u}.low") > unsafe_max_increase
    worse = (F.col(f"{c}.high") < 0) | (F.col(f"{v}.high") < -coverage_max_regression)
    good = (F.col(f"{c}.low") >= correctness_min_delta) & (F.col(f"{v}.low") >= -coverage_max_regression) & (F.col(f"{u}.high") <= unsafe_max_increase)
    verdict = (F.when(missing | few, "inconclusive").when(harmful | worse, "contradicts_candidate").when(good, "supports_candidate").otherwise("inconclusive"))
    reason = (F.when(missing, "a metric has no interval").when(few, "too few cases").when(harmful, "unsafe rises beyond chance").when(worse, "correctness or coverage falls beyond chance")
              .when(~good, "the intervals do not clear the rule"))
    return rows.select(*by, verdict.alias("verdict"), reason.alias("reason"))
