"""Answers as columns: decoding, measures, decisions, bands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from juryframe.rubric import BAND, Question, Rubric

SUM_TOLERANCE = 1e-3


def c(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


@dataclass
class Decoded:
    """Columns of one answer and whether every one of them is valid."""

    valid: Column
    columns: dict[str, Column]


def _path(qid: str, slot: Column | None, tail: str) -> Column:
    if slot is None:
        return F.lit(f'$["{qid}"]{tail}')
    return F.concat(F.lit(f'$["{qid}@s'), slot.cast("string"), F.lit(f'"]{tail}'))


def _get(answers: Column, path: Column, kind: str) -> Column:
    return F.try_variant_get(answers, path, kind)


def _is_fraction(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def _shape(value: Column) -> Column:
    """array, object, null or other of a VARIANT; null when it is absent."""
    kind = F.schema_of_variant(value)
    return (F.when(kind.isNull(), F.lit(None).cast("string")).when(kind.startswith("ARRAY"), "array")
            .when(kind.startswith("OBJECT"), "object").when(kind == "VOID", F.lit(None).cast("string")).otherwise("other"))


class Steps:
    """`df` with parts of expressions as columns of their own, so that no part is computed again by each that uses it."""

    def __init__(self, df: DataFrame):
        self.df, self.before, self.n = df, df.columns, 0

    def __call__(self, parts: dict[str, Column]) -> dict[str, Column]:
        self.n += 1
        names = {k: f"_step{self.n}_{i}" for i, k in enumerate(parts)}
        self.df = self.df.withColumns({names[k]: col for k, col in parts.items()})
        return {k: F.col(n) for k, n in names.items()}


def _same(parts: dict[str, Column]) -> dict[str, Column]:
    return parts


def decode(answers: Column, qid: str, question: Question, slot: Column | None = None, keep: Callable[[dict[str, Column]], dict[str, Column]] = _same) -> Decoded:
    """Flat columns of one answer. `answers` is a VARIANT keyed by question id (or `qid@s<slot>`). `keep` may be `Steps`."""
    get = lambda tail, kind: _get(answers, _path(qid, slot, tail), kind)
    inside = lambda value, key, kind: _get(value, F.lit(f'$["{key}"]'), kind)
    if question.kind == "bool":
        p = keep({"p": get(".bool", "double")})["p"]
        return Decoded(_is_fraction(p), {qid: p})
    if question.kind == "choice":
        one = keep({"label": get(".choice", "string"), "all": get(".probabilities", "variant"), "conf": get(".confidence", "double")})
        two = keep({"shape": _shape(one["all"])} | {f"p.{name}": F.when(inside(one["all"], name, "variant").isNotNull(), inside(one["all"], name, "double")).otherwise(F.lit(0.0)) for name in question.criteria})
        valid = F.coalesce(one["label"].isin(*question.criteria), F.lit(False)) & F.coalesce(two["shape"] == "object", F.lit(False))
        columns = {qid: one["label"]}
        for name in question.criteria:
            columns[f"{qid}.{name}"] = two[f"p.{name}"]
            valid = valid & _is_fraction(two[f"p.{name}"])
        columns[f"{qid}.conf"] = one["conf"]
        return Decoded(valid & _is_fraction(one["conf"]), columns)
    n = question.levels
    one = keep({"score": get(".score", "double"), "conf": get(".confidence", "double"), "all": get(".probabilities", "variant"), "legend": get(".legend", "variant")})
    score, conf = one["score"], one["conf"]
    two = keep({"shape": _shape(one["all"]), "legend_shape": _shape(one["legend"])})
    named = F.array(*[inside(one["all"], str(i), "double") for i in range(n)])
    extra = F.size(F.map_keys(_get(one["all"], F.lit("$"), "map<string,variant>")))
    by_level = F.array(*[inside(one["legend"], str(i), "string") for i in range(n)])
    three = keep({
        "dist": F.when(two["shape"] == "array", _get(one["all"], F.lit("$"), "array<double>")).when((two["shape"] == "object") & (extra == n), named),
        "legend": F.when(two["legend_shape"] == "array", _get(one["legend"], F.lit("$"), "array<string>")).when(two["legend_shape"] == "object", by_level)})
    dist, legend = three["dist"], three["legend"]
    total = F.aggregate(dist, F.lit(0.0), lambda acc, x: acc + x)
    good_dist = two["shape"].isNull() | F.coalesce(
        (F.size(dist) == n) & F.forall(dist, _is_fraction) & (F.abs(total - 1) <= SUM_TOLERANCE), F.lit(False))
    good_legend = two["legend_shape"].isNull() | F.coalesce(
        (F.size(legend) == n) & F.forall(legend, lambda x: x.isNotNull()), F.lit(False))
    valid = F.coalesce(score.between(0.0, float(n - 1)), F.lit(False)) & _is_fraction(conf) & good_dist & good_legend
    return Decoded(valid, {qid: score, f"{qid}.conf": conf, f"{qid}.dist": dist, f"{qid}.legend": legend})


def all_valid(answers: Column, rubric: Rubric, slot: Column | None = None, keep: Callable[[dict[str, Column]], dict[str, Column]] = _same) -> Column:
    ok = answers.isNotNull()
    for qid, question in rubric.items():
        ok = ok & decode(answers, qid, question, slot, keep).valid
    return F.coalesce(ok, F.lit(False))


def scalar(answers: Column, qid: str, question: Question) -> Column:
    """One answer as a plain value: label, P(yes) or weighted level. Null when it is malformed."""
    got = decode(answers, qid, question)
    if question.kind == "choice":
        return got.columns[qid]
    if question.kind == "bool":
        return F.when(got.valid, got.columns[qid])
    return got.columns[qid]


def ranked(qid: str, question: Question) -> Column:
    """Label probabilities, highest first."""
    return F.sort_array(F.array(*[c(f"{qid}.{name}") for name in question.criteria]), asc=False)


def spread(dist: Column) -> Column:
    """Population standard deviation of a level distribution; null without one."""
    pairs = F.transform(dist, lambda p, i: F.struct(p.alias("p"), i.cast("double").alias("i")))
    mean = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["i"] * e["p"])
    var = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["p"] * ((e["i"] - mean) * (e["i"] - mean)))
    return F.when(dist.isNotNull(), F.sqrt(var))


def measures(qid: str, question: Question) -> dict[str, Column]:
    """Uncertainty of one answered row, by kind. Confidence is passed through, never redefined.

    A margin is rounded to nine digits, so that 0.3 - 0.2 is no less than 0.1.
    """
    if question.kind == "choice":
        order = ranked(qid, question)
        return {"top_probability": order[0], "margin": F.round(order[0] - order[1], 9), "host_confidence": c(f"{qid}.conf")}
    if question.kind == "bool":
        return {"p_yes": c(qid), "ambiguity": 1 - F.abs(2 * c(qid) - 1)}
    dist = c(f"{qid}.dist")
    return {"weighted_index": c(qid), "host_confidence": c(f"{qid}.conf"),
            "distribution_available": dist.isNotNull(), "spread": spread(dist)}


def decision(qid: str, question: Question) -> Column:
    """Label, side at one half, or nearest level, as text. Null for an unanswered row."""
    if question.kind == "choice":
        value = c(qid)
    elif question.kind == "bool":
        value = F.when(c(qid) >= 0.5, "yes").when(c(qid) < 0.5, "no")
    else:
        value = F.floor(c(qid) + 0.5).cast("string")
    return F.when(F.col("error").isNull(), value)


def in_band(rubric: Rubric) -> Column:
    """Any top probability in [0.3, 0.7) or any P(yes) in [0.3, 0.7]. The upper ends differ on purpose."""
    low, high = BAND
    out = F.lit(False)
    for qid, question in rubric.items():
        if question.kind == "choice":
            top = ranked(qid, question)[0]
            out = out | ((top >= low) & (top < high))
        elif question.kind == "bool":
            out = out | c(qid).between(low, high)
    return F.coalesce(out, F.lit(False))


def moved(before: Column, after: Column, question: Question, margin: float) -> Column:
    """Another label, or a value that moved by more than `margin` of its range."""
    if question.kind == "choice":
        return before != after
    span = 1.0 if question.kind == "bool" else float(max(question.levels - 1, 1))
    return F.abs(after - before) / span > margin


def provenance_unknown() -> Column:
    """True unless route and cache facts are all present and agree."""
    selected, primary = F.col("selected_model"), F.col("primary_model")
    cached, total = F.col("cached_questions"), F.col("questions")
    route = (selected != "") & (primary != "") & (F.col("fallback") == (selected != primary))
    counts = (total >= 1) & (cached >= 0) & (cached <= total)
    agree = (F.when(F.col("cache") == "hit", cached == total).when(F.col("cache") == "miss", cached == 0)
             .when(F.col("cache") == "partial", (cached > 0) & (cached < total)).otherwise(False))
    return ~F.coalesce(route & counts & agree, F.lit(False))


def policy_reason(policy_bounds: dict, rubric: Rubric) -> Column:
    """Reasons of a bound policy joined by `; `, or null."""
    parts = []
    for qid, bound in policy_bounds.items():
        m = measures(qid, rubric[qid])
        if "top" in bound:
            parts.append(F.when(m["top_probability"] < bound["top"], f"{qid}:low_top_probability"))
        if "margin" in bound:
            parts.append(F.when(m["margin"] < bound["margin"], f"{qid}:low_margin"))
        if "band" in bound:
            low, high = bound["band"]
            parts.append(F.when(m["p_yes"].between(low, high), f"{qid}:ambiguous_bool"))
        if "spread" in bound:
            parts.append(F.when(m["spread"].isNull(), f"{qid}:score_distribution_unavailable")
                         .when(m["spread"] > bound["spread"], f"{qid}:wide_score"))
    text = F.concat_ws("; ", *parts)
    return F.when(F.col("error").isNull() & (text != ""), text)
