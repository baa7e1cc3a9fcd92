"""Scores, intervals, ledgers: plain Python versions on random and awkward inputs."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from juryframe.operators import ledger as L, scoring as S


def test_item_scores_keep_their_denominators(spark):
    truth = [("c", 1, True), ("c", 2, True), ("c", 3, False), ("c", 4, None), ("c", 5, True), ("c", 6, False), (None, 1, True), ("d", 1, None)]
    verdicts = [("c", 1, "flagged"), ("c", 1, "flagged"), ("c", 2, "cleared"), ("c", 2, "flagged"), ("c", 3, "flagged"), ("c", 4, "flagged"), ("c", 6, "cleared"), (None, 1, "flagged"), ("c", 99, "flagged"), ("d", 1, "odd")]
    errors = [("c", 6), ("c", 6)]
    out = S.item_scores(spark.createDataFrame(truth, "case string, item int, flag boolean"), spark.createDataFrame(verdicts, "case string, item int, label string"), spark.createDataFrame(errors, "case string, item int"))
    got = {(r.case, r.overall): r for r in out.collect()}
    c = got["c", False]
    assert (c.tp, c.fp, c.fn, c.unresolved_flags, c.planned_items, c.correct, c.unresolved, c.key_unresolved, c.omitted) == (1, 1, 2, 1, 6, 1, 4, 1, 0)
    assert c.recall == pytest.approx(1 / 3) and c.precision == pytest.approx(1 / 3) and c.accuracy == pytest.approx(1 / 6)
    assert (got[None, False].tp, got[None, False].planned_items) == (1, 1) and got["d", False].recall is None and got["d", False].precision is None
    assert (got[None, True].planned_items, got[None, True].tp) == (8, 2)
    assert S.item_scores(*(spark.createDataFrame([], t) for t in ("case string, item int, flag boolean", "case string, item int, label string"))).where("NOT overall").count() == 0


KEY = "case string, item int, factual string, introduced string, actions array<string>, defect string"
SAID = "case string, item int, factual string, action string, introduced string"


def test_facets_and_repairs(spark):
    key = spark.createDataFrame([("c", 1, "supported", "yes", ["fix_now"], "d1"), ("c", 2, "supported", "no", ["fix_now", "defer"], "d1"), ("c", 3, "refuted", "unknown", ["no_action"], None),
                                 ("c", 4, "underdetermined", "unknown", ["investigate"], ""), ("c", 5, "supported", "yes", ["fix_now"], "d2"), ("c", 6, "supported", "yes", ["fix_now"], "d3")], KEY)
    said = spark.createDataFrame([("c", 1, "supported", "fix_now", "yes"), ("c", 2, "supported", "defer", "no"), ("c", 3, "omitted", "fix_now", "no"), ("c", 4, "underdetermined", "investigate", "unknown"),
                                  ("c", 5, "supported", "fix_now", "yes"), ("c", 6, "supported", "fix_now", "yes")], SAID)
    errors = spark.createDataFrame([("c", 4, "action")], "case string, item int, facet string")
    rejected = spark.createDataFrame([("c", 5), ("c", 5)], "case string, item int")
    f = {r.facet: r for r in S.facet_scores(key, said, errors, rejected).collect()}
    assert (f["factual"].planned, f["factual"].correct, f["factual"].covered, f["factual"].omitted, f["factual"].unattributed, f["factual"].extraction_errors) == (6, 4, 4, 1, 1, 0)
    assert (f["action"].correct, f["action"].extraction_errors, f["action"].unresolved, f["action"].asserted_uncertain, f["action"].key_uncertain) == (3, 1, 2, 0, 1)
    assert (f["introduced"].correct, f["introduced"].asserted_uncertain, f["introduced"].key_uncertain) == (4, 1, 2)
    r = S.repair_scores(key, said, errors, rejected).collect()[0]
    assert (r.planned_defects, r.predicted_defects, r.tp, r.fp, r.fn, r.unsupported) == (3, 3, 2, 1, 1, 1)
    assert r.recall == pytest.approx(2 / 3) and r.precision == pytest.approx(2 / 3)


def test_one_false_claim_spoils_a_defect(spark):
    key = spark.createDataFrame([("c", 1, "supported", "yes", ["fix_now"], "d"), ("c", 2, "supported", "yes", ["defer"], "d")], KEY)
    said = spark.createDataFrame([("c", i, "supported", "fix_now", "yes") for i in (1, 2)], SAID)
    r = S.repair_scores(key, said).collect()[0]
    assert (r.tp, r.fp, r.fn, r.unsupported) == (0, 1, 1, 1)


def test_controls_keep_unscored_attempts(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", False, None), ("b", True, False), (None, None, True)], "case string, final_attempt boolean, correct boolean")
    got = {(r.block, r.case): (r.n, r.scored, r.correct, r.accuracy) for r in S.control_summary(rows).collect()}
    assert got == {("overall", None): (4, 3, 2, 0.5), ("final_attempt", None): (2, 2, 1, 0.5), ("case", "a"): (2, 1, 1, 0.5), ("case", "b"): (1, 1, 0, 0.0), ("case", None): (1, 1, 1, 1.0)}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 31, 32, 40])
def test_paired_intervals(spark, n):
    rng = random.Random(n)
    base = [("m", f"c{i}", rng.random()) for i in range(n)] + [("m", "only", 1.0), ("m", "null", None)]
    current = [("m", f"c{i}", rng.random()) for i in range(n)] + [("m", "null", 2.0), ("m", "new", 1.0)]
    row = S.paired_intervals(*(spark.createDataFrame(x, "metric string, case string, value double") for x in (base, current)), by=["metric"]).collect()[0]
    d = [round(current[i][2] - base[i][2], 6) for i in range(n)]
    assert (row.n, row.unpaired) == (n, 3)
    if n < 2:
        assert row.low is None and row.df is None and row.t_critical is None and (row.mean_delta is None) == (n == 0)
        return
    mean = sum(d) / n
    half = (S.T_95[n - 2] if n <= 31 else 1.96) * math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1) / n)
    assert row.df == n - 1 and row.low == pytest.approx(mean - half, abs=2e-6) and row.high == pytest.approx(mean + half, abs=2e-6)


@pytest.mark.parametrize("c,v,u,n,want", [
    ((0.1, 0.2), (0.0, 0.1), (-0.1, 0.0), 9, "supports_candidate"), ((0.1, 0.2), (0.0, 0.1), (0.2, 0.3), 9, "contradicts_candidate"), ((-0.3, -0.1), (0.0, 0.1), (-0.1, 0.0), 9, "contradicts_candidate"),
    ((0.1, 0.2), (-0.5, -0.2), (-0.1, 0.0), 9, "contradicts_candidate"), ((-0.1, 0.2), (0.0, 0.1), (-0.1, 0.0), 9, "inconclusive"), ((0.1, 0.2), (0.0, 0.1), (-0.1, 0.0), 3, "inconclusive"),
    ((None, None), (0.0, 0.1), (-0.1, 0.0), 9, "inconclusive")])
def test_threshold_choice(spark, c, v, u, n, want):
    rows = spark.createDataFrame([("g", m, n, *map(lambda x: x, i)) for m, i in (("q", c), ("k", v), ("h", u))], "g string, metric string, n int, low double, high double")
    rule = dict(by=["g"], min_cases=5, correctness_min_delta=0.0, coverage_max_regression=0.1, unsafe_max_increase=0.1)
    assert S.threshold_choice(rows, {"correctness": "q", "coverage": "k", "unsafe": "h"}, **rule).collect()[0].verdict == want
    with pytest.raises(ValueError):
        S.threshold_choice(rows, {"correctness": "q"}, **rule)


CALL = "scope string, origin string, id string, `order` int, purpose string, stop_reason string, input int, output int, cache_read int, cache_write int, cost double, cost_unknown boolean, estimated boolean"


def call(scope, id, order, purpose="judge", origin="auxiliary", stop="stop", tokens=(1, 2, 3, 4), cost=0.1, lost=None, estimated=None):
    return scope, origin, id, order, purpose, stop, *tokens, cost, lost, estimated


def test_ledger_keeps_unknown_apart_from_zero(spark):
    rows = [call("a", "1", 1), call("a", "1", 2), call("a", "2", 3, cost=0.2, estimated=False), call("a", "1", 4, origin="outer"), call("b", "1", 1), call("b", "1", 2, cost=0.3), call("c", "1", 1, cost=None),
            call("d", "1", 1, stop="error", tokens=(0, None, 0, 0), cost=0.0), call("e", "1", 1, tokens=(1, None, 3, 4)), call("e", "2", 2, purpose="eval_completion"), call("e", "3", 3, purpose=None), call("a", None, 9), call("a", "", 9)]
    unique = L.first_entries(L.entries(spark.createDataFrame(rows, CALL)))
    held = {(r.scope, r.origin, r.id): (r.repeats, r.conflicts) for r in unique.collect()}
    assert held["a", "auxiliary", "1"] == (1, 0) and held["b", "auxiliary", "1"] == (1, 1) and len(held) == 9
    assert [(r.scope, r.conflicts) for r in L.conflicts(L.entries(spark.createDataFrame(rows, CALL))).collect()] == [("b", 1)]
    states = spark.createDataFrame([("a", "complete"), ("b", "complete"), ("c", "complete"), ("d", "complete"), ("e", "incomplete"), ("f", "complete")], "scope string, status string")
    got = {(r.scope, r.bucket): r for r in L.totals(unique, states).where("NOT overall").collect()}
    a = got["a", "judgment"]
    assert (a.entries, a.input, a.reported_cost, a.cost_unknown, a.tokens_complete, a.estimated) == (2, 2, Decimal("0.300000000"), False, True, True)
    assert got["a", "outer"].reported_cost == Decimal("0.1") and got["a", "total"].reported_cost is None and got["a", "total"].reported_subtotal == Decimal("0.4")
    assert got["b", "judgment"].reported_cost is None and not got["b", "judgment"].complete and got["b", "judgment"].reported_subtotal == Decimal("0.1")
    assert got["c", "judgment"].cost_unknown and got["c", "judgment"].reported_subtotal == 0 and got["d", "judgment"].cost_unknown
    assert not got["e", "judgment"].tokens_complete and got["e", "other"].entries == 1 and got["f", "total"].entries == 0 and got["f", "judgment"].reported_cost == 0
    total = {r.bucket: r for r in L.totals(unique, states).where("overall").collect()}
    assert total["total"].entries == 9 and total["total"].reported_cost is None and total["outer"].entries == 1
    parts = [L.totals(unique.where(F.col("scope").isin(*s)), states.where(F.col("scope").isin(*s)), overall=False) for s in (["a", "b"], ["c", "d", "e", "f"])]
    whole = L.totals(unique, states, overall=False)
    assert {tuple(r) for p in parts for r in p.collect()} == {tuple(r) for r in whole.collect()}
