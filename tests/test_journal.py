"""Journals as tables and as streams that are stopped and started again; saved runs that broke off."""

import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from juryframe.operators import journal as J
from juryframe.sources import runs as R
from juryframe.streaming import journal as S


def lines(*events, journal="j"):
    return [(journal, k, json.dumps(e), True) for k, e in enumerate(events)]


def test_torn_and_corrupt_lines(spark):
    rows = [("a", 0, '{"event":"attempt"}', True), ("a", 1, '{"event":"it', False), ("b", 0, '{"event":"x', False), ("b", 1, '{"event":"end"}', True), ("c", 0, "[1]", True), ("c", 1, '{"event":3}', True),
            ("c", 2, '{"kind":"x"}', True), ("c", 3, "", True), ("d", 0, '{"event":"end"}', False), (None, 0, '{"event":"end"}', True)]
    got = {(r.journal, r.number): (r.event, r.problem) for r in J.replayed(spark.createDataFrame(rows, S.LINES)).collect()}
    assert got == {("a", 0): ("attempt", None), ("a", 1): (None, "torn"), ("b", 0): (None, "corrupt"), ("b", 1): ("end", None), ("c", 0): (None, "not an event"), ("c", 1): (None, "not an event"),
                   ("c", 2): (None, "not an event"), ("c", 3): (None, "corrupt"), ("d", 0): (None, "torn"), (None, 0): ("end", None)}


RUN = lines(
    {"event": "attempt", "attempt": 1, "label": "first", "keys": ["a", "b", "c"]}, {"event": "batch", "attempt": 1}, {"event": "batch", "attempt": 1, "batch_id": "x", "host": "h1"},
    {"event": "batch", "attempt": 1, "batch_id": "y", "host": "h2"}, {"event": "item", "attempt": 1, "key": "a", "message": "old"}, {"event": "item", "attempt": 1, "key": "a", "message": "new"},
    {"event": "coverage", "attempt": 1, "message": "late"}, {"event": "resume"}, {"event": "attempt", "attempt": 2, "keys": ["a", "b"]}, {"event": "batch", "attempt": 2},
    {"event": "item", "attempt": 2, "key": "a", "message": "newest"}, {"event": "attempt", "attempt": 3, "keys": ["c", "c"]}, {"event": "attempt", "attempt": 4, "keys": []}, {"event": "what", "attempt": 4},
    {"event": "item", "attempt": 5, "key": "a"}, {"event": "attempt", "attempt": 5, "keys": ["a"]}, {"event": "item", "attempt": 6, "key": "z"}, {"event": "attempt", "attempt": 7, "keys": ["q"]},
    {"event": "attempt", "attempt": 7, "keys": ["q"]}, {"event": "item", "attempt": 1, "key": "zz"}, {"event": "end", "attempt": 2, "status": "completed", "cost": 1.5, "cost_known": True}, {"event": "finish"})


def test_attempts_fold(spark):
    records = J.fields(J.replayed(spark.createDataFrame(RUN, S.LINES)).where("problem IS NULL"))
    got = {r.attempt: r for r in J.attempts(records, host=F.lit("h9")).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: "unplanned item", 2: None, 3: "a key is planned twice", 4: "unknown event", 5: "used before it was opened", 6: "never opened", 7: "opened twice"}
    assert {k: r.status for k, r in got.items()} == {1: "stale", 2: "completed", 3: "submit_unknown", 4: "submit_unknown", 5: "submit_unknown", 6: "submit_unknown", 7: "submit_unknown"}
    one, two = got[1], got[2]
    assert (one.label, one.planned, one.delivered, one.unplanned, one.coverage_errors, one.batch_id, one.host) == ("first", 3, 1, 1, 1, "x", "h1")
    assert (two.delivered, two.cost, two.cost_known) == (1, 1.5, True)
    last = {r.key: (r.attempt, r.message, r.attempts) for r in J.delivered(records).collect()}
    assert last["a"] == (5, None, 3) and last["zz"][0] == 1
    assert {r.key for r in J.undelivered(records).collect()} == {"b", "c", "q"}


def test_a_stream_that_is_restarted_ends_like_the_table(spark, tmp_path):
    source, kept, mark = (str(tmp_path / n) for n in ("in", "kept", "mark"))
    rows = RUN + [("k", *r[1:]) for r in RUN] + [("j", 99, '{"event":"item","attempt":2,"key":"b"', False)]
    parts = [rows[0:5], rows[5:9] + rows[22:30], rows[9:22], rows[30:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, S.LINES).coalesce(1).write.parquet(f"{source}/part={k}")
        # a new query every time: it goes on from the checkpoint
        query = S.keep_attempts(S.read_lines(spark, f"{source}/*", S.LINES), kept, mark, host=F.lit("h9"))
        query.awaitTermination(120)
        assert query.exception() is None
    want = J.attempts(J.fields(J.replayed(spark.createDataFrame(rows, S.LINES)).where("problem IS NULL")), host=F.lit("h9"))
    now = S.current_attempts(spark, kept)
    assert {tuple(r) for r in now.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    # the last batch is written again by a run that lost its commit
    commits = sorted((f for f in os.listdir(f"{mark}/commits") if f.isdigit()), key=int)
    for f in glob.glob(f"{mark}/commits/*{commits[-1]}*") + glob.glob(f"{mark}/commits/.{commits[-1]}*"):
        os.remove(f)
    query = S.keep_attempts(S.read_lines(spark, f"{source}/*", S.LINES), kept, mark, host=F.lit("h9"))
    query.awaitTermination(120)
    assert {tuple(r) for r in S.current_attempts(spark, kept).select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def run_of_three(spark):
    rows = spark.createDataFrame([("a", 1.5, None), ("b", None, "failed"), ("ä", 2.0, None)], "id string, p double, error string")
    units = spark.createDataFrame([("a",), ("b",), ("ä",), ("x",)], "id string")
    return rows, R.inventory(rows, units, excluded=units.where("id = 'x'"))


def test_a_saved_run_comes_back(spark, tmp_path):
    rows, held = run_of_three(spark)
    path = R.save(rows, held, str(tmp_path / "run"), note="n")
    again, listed = R.load(spark, path)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.collect()} and {tuple(r) for r in listed.collect()} == {tuple(r) for r in held.collect()}
    with pytest.raises(ValueError, match="holds a run"):
        R.save(rows, held, path)
    empty = rows.limit(0), R.inventory(rows.limit(0), rows.select("id").limit(0))
    assert [d.count() for d in R.load(spark, R.save(*empty, str(tmp_path / "none")))] == [0, 0]


@pytest.mark.parametrize("damage", ["no manifest", "lost part", "extra part", "changed inventory"])
def test_a_torn_or_changed_run_is_refused(spark, tmp_path, damage):
    rows, held = run_of_three(spark)
    path = R.save(rows.repartition(3, "id"), held, str(tmp_path / "run"))
    if damage == "no manifest":
        shutil.rmtree(path + "/manifest")
    elif damage == "lost part":
        os.remove(sorted(glob.glob(path + "/rows/*.parquet"), key=os.path.getsize)[-1])
    elif damage == "extra part":
        rows.where("id = 'a'").write.mode("append").parquet(path + "/rows")
    else:
        held.where("id <> 'x'").write.mode("overwrite").parquet(path + "/inventory")
    with pytest.raises(ValueError):
        R.load(spark, path)


def test_rows_that_do_not_part_the_inventory_are_refused(spark, tmp_path):
    rows, held = run_of_three(spark)
    for bad in (rows.where("id <> 'a'"), rows.unionByName(rows.where("id = 'a'")), rows.withColumn("error", F.lit("e")), rows.withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="do not part"):
            R.save(bad, held, str(tmp_path / "run"))
