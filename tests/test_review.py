"""Review inbox, closures and inventories on cases that a query does not reach."""

import pytest
from pyspark.sql import functions as F

from juryframe.operators import closure as C, inventory as I, review as R

ITEM, DECISION = "item string, unit string, claim string, file string, fingerprint string", "batch int, place int, item string, verdict string, kind string, cited array<string>"
ITEMS = [(f"i{k}", f"u{k % 3}", "c", f"f{k}", f"p{k}") for k in range(6)]


def states(spark, decisions, changed=(), blocked=(), **drift):
    items = spark.createDataFrame(ITEMS, ITEM)
    rows = R.state(items, spark.createDataFrame(decisions, DECISION))
    files = spark.createDataFrame([(c,) for c in changed], "file string")
    return R.drifted(rows, files, blocked=spark.createDataFrame([(b,) for b in blocked], "item string"), **drift), files


def test_the_last_decision_counts(spark):
    rows, files = states(spark, [(1, 0, "i0", "confirmed", "human", ["f9"]), (2, 0, "i0", "overturned", "agent", []), (1, 1, "i1", "unresolved", "agent", None)])
    got = {r.item: (r.verdict, r.decisions, r.last_kind) for r in rows.collect()}
    assert got["i0"] == ("overturned", 2, "agent") and got["i1"] == ("unresolved", 1, "agent") and got["i2"] == ("pending", 0, None)
    views = {r.item: r.view for r in rows.collect()}
    again, _ = states(spark, [(1, 0, "i0", "confirmed", "human", ["f9"]), (1, 1, "i1", "unresolved", "agent", None)])
    changed = {r.item for r in again.collect() if r.view != views[r.item]}
    assert changed == {"i0"} and len(set(views.values())) == 6
    odd = R.strangers(spark.createDataFrame(ITEMS, ITEM), spark.createDataFrame([(1, 0, "zz", "confirmed", "human", []), (1, 1, "i0", "maybe", "human", [])], DECISION))
    assert {(r.item, r.problem) for r in odd.collect()} == {("zz", "unknown item"), ("i0", "unknown verdict")}


def test_drift_by_precedence(spark):
    decisions = [(1, k, f"i{k}", "confirmed", "human", ["f1", "s"]) for k in range(5)]
    rows, files = states(spark, decisions, changed=["f1", "s", "s"], blocked=["i1", "i2", "i2"])
    assert {r.item: r.stale for r in rows.collect()} == {"i0": "stale_evidence", "i1": "stale_source", "i2": "missing_evidence", "i3": "stale_evidence", "i4": "stale_evidence", "i5": None}
    assert {r.stale for r in states(spark, decisions, policy=True)[0].collect()} == {"stale_policy"}
    assert {r.stale for r in states(spark, decisions, rubric=True, policy=True)[0].collect()} == {"stale_rubric"}
    queue = {r.item: (r.priority, r.askable) for r in R.queue(rows).collect()}
    assert queue == {"i0": (1, True), "i1": (2, False), "i2": (2, False), "i3": (1, True), "i4": (1, True), "i5": (0, True)}


def test_units_are_approved_whole(spark):
    decisions = [(1, k, f"i{k}", "confirmed", "human", []) for k in (0, 1, 3, 4, 5)] + [(2, 0, "i4", "overturned", "human", [])]
    rows, files = states(spark, decisions)
    assert {r.unit for r in R.approved_units(rows).collect()} == {"u0"}
    assert R.approved_units(rows, spark.createDataFrame([("u0",)], "unit string")).collect() == []
    s = R.summary(rows, files).collect()[0]
    assert (s["items"], s.pending, s.confirmed, s.overturned, s.complete, s.settled, s.approved_units) == (6, 1, 4, 1, False, False, 1)
    whole, files = states(spark, [(1, k, f"i{k}", "confirmed", "human", []) for k in range(6)])
    assert R.summary(whole, files).collect()[0].settled
    none = R.summary(whole.limit(0), files).collect()[0]
    assert none["items"] == 0 and none.complete and none.settled


def test_refusals_come_in_order(spark):
    rows, files = states(spark, [(1, 0, "i0", "confirmed", "human", ["f0"]), (1, 1, "i1", "unresolved", "agent", [])], changed=["f3", "x"], blocked=["i4"])
    view = {r.item: r.view for r in rows.collect()}
    good = lambda place, item, verdict="confirmed", kind="agent", cited=("f5",), fp=None, seen=None: (place, item, fp or f"p{item[1:]}", seen or view.get(item), verdict, kind, list(cited))
    batch = [good(0, "i0"), good(1, "i1"), good(2, "i1", "nonsense"), good(3, "zz"), good(4, "i3"), good(5, "i4"), (6, None, "p", "v", "confirmed", "human", []), good(7, "i2", fp="other", seen="older"),
             good(8, "i5", seen="older", verdict="nonsense")]
    schema = "place int, item string, fingerprint string, view string, verdict string, kind string, cited array<string>"
    got = {r.place: r.refusal for r in R.judged_batch(rows, spark.createDataFrame(batch, schema), files).collect()}
    assert got == {0: "protected_decision", 1: None, 2: "duplicate_item", 3: "unknown_item", 4: "stale_source", 5: "missing_evidence", 6: "invalid_decision", 7: "fingerprint_mismatch", 8: "superseded"}
    more = [good(0, "i1", "nonsense"), good(1, "i2", cited=()), good(2, "i5", cited=("x", "f5")), good(3, "i0", "unresolved", "human", ())]
    got = {r.place: r.refusal for r in R.judged_batch(rows, spark.createDataFrame(more, schema), files).collect()}
    assert got == {0: "invalid_decision", 1: "invalid_evidence", 2: "stale_source", 3: None}


def closure(spark, seeds, edges, known, depth):
    nodes = C.closure(spark.createDataFrame(seeds, "record string, source string"), spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(k,) for k in known], "source string"), depth=depth)
    return nodes, C.cycles(nodes, spark.createDataFrame(edges, "source string, target string"))


def test_closure_meets_cycles_gaps_and_its_depth(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "e"), ("c", "gone"), ("gone", "f"), ("a", "b"), (None, "a"), ("a", None)]
    nodes, rings = closure(spark, [("r", "a"), ("r", "a"), ("s", "e"), ("t", None), ("u", "nowhere")], edges, "abcdef", 9)
    got = {(r.record, r.source): (r.depth, r.parent, r.path, r.status) for r in nodes.collect()}
    assert got == {("r", "a"): (0, None, [], "ready"), ("r", "b"): (1, "a", ["a"], "ready"), ("r", "c"): (1, "a", ["a"], "ready"), ("r", "d"): (2, "b", ["a", "b"], "ready"), ("r", "e"): (3, "d", ["a", "b", "d"], "ready"),
                   ("r", "gone"): (2, "c", ["a", "c"], "missing_evidence"), ("s", "e"): (0, None, [], "ready"), ("u", "nowhere"): (0, None, [], "missing_evidence")}
    assert {tuple(r) for r in rings.collect()} == {("r", "d", "a"), ("r", "e", "e"), ("s", "e", "e")}
    state = {r.record: (r.sources, r.missing, r.exhausted, r.cycles, r.ready) for r in C.blocked(nodes, rings).collect()}
    assert state == {"r": (6, 1, 0, 2, False), "s": (1, 0, 0, 1, False), "u": (1, 1, 0, 0, False)}
    nodes, _ = closure(spark, [("r", "a")], edges, "abcdef", 1)
    assert {(r.source, r.status) for r in nodes.collect()} == {("a", "ready"), ("b", "ready"), ("c", "ready"), ("d", "expansion_exhausted"), ("gone", "missing_evidence")}
    assert closure(spark, [("t", None)], edges, "a", 3)[0].collect() == []
    with pytest.raises(ValueError):
        closure(spark, [("r", "a")], edges, "a", -1)


def test_moved_files_and_what_depends_on_them(spark):
    snap = lambda rows: spark.createDataFrame(rows, "name string, sha256 string")
    changes = I.delta(snap([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("n", None), ("z", "2")]), snap([("a", "1"), ("b", "9"), ("x", "3"), ("y", "3"), ("n", None), ("new", "7")]))
    got = {r.name: (r.change, r.moved_from) for r in changes.collect()}
    assert got == {"b": ("changed", None), "c": ("removed", None), "d": ("removed", None), "n": ("changed", None), "x": ("moved", "c"), "y": ("moved", "c"), "new": ("added", None), "z": ("removed", None)}
    depends = spark.createDataFrame([("r", "a"), ("s", "b"), ("s", "c"), ("s", "c"), ("t", "d"), ("u", "new"), ("v", None)], "record string, name string")
    stale = I.stale_records(depends, changes)
    assert {r.record: (r.changed, r.removed, r.moved) for r in stale.collect()} == {"s": (1, 0, 1), "t": (0, 1, 0)}
    records = lambda rows: spark.createDataFrame(rows, "record string, sha256 string")
    old, new = records([("r", "1"), ("s", "1"), ("t", "1"), ("q", "1")]), records([("r", "1"), ("s", "1"), ("t", "2"), ("w", "1")])
    assert {r.record: r.fate for r in I.refreshed(old, new, stale).collect()} == {"r": "reusable", "s": "stale", "t": "changed", "q": "removed", "w": "added"}
    assert {r.fate for r in I.refreshed(old, new, stale, rubric_changed=True).collect()} == {"rubric_changed", "removed", "added"}


def test_decisions_that_share_a_place_are_cited_apart(spark):
    rows, files = states(spark, [], changed=["x"])
    view = {r.item: r.view for r in rows.collect()}
    batch = [(7, i, f"p{i[1:]}", view[i], "confirmed", "agent", cited) for i, cited in (("i1", ["x"]), ("i2", ["f5"]), ("i5", ["f5", "x"]))]
    schema = "place int, item string, fingerprint string, view string, verdict string, kind string, cited array<string>"
    got = {r.item: r.refusal for r in R.judged_batch(rows, spark.createDataFrame(batch, schema), files).collect()}
    assert got == {"i1": "stale_source", "i2": None, "i5": "stale_source"}


def test_records_that_refer_to_groups_form_no_pairs(spark):
    changes = spark.createDataFrame([("a", "changed", None), ("b", "removed", None), ("c", "removed", None), ("d", "moved", "c"), ("e", "added", None)], "name string, change string, moved_from string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "z"), (3, "e"), (None, "a"), (1, None)], "group int, name string")
    refers = spark.createDataFrame([("r", 1), ("r", 1), ("r", 2), ("s", 2), ("t", 3), ("u", None)], "record string, group int")
    got = {r.record: (r.changed, r.removed, r.moved) for r in I.stale_by_group(refers, members, changes).collect()}
    assert got == {"r": (1, 1, 1), "s": (0, 0, 1)}
    with pytest.raises(Exception, match="in two groups"):
        I.stale_by_group(refers, members.unionByName(spark.createDataFrame([(2, "a")], members.schema)), changes).collect()
