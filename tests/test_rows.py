"""Refusals that must survive pruning, and keys that come more than once."""

import json

import pytest
from pyspark.sql import functions as F

from juryframe.functions import answers as A, digest as D
from juryframe.operators import judge as J, rows as R
from juryframe.plans.common import RUBRIC
from juryframe.plans.row_queries import signature_triage

ANSWERS = json.dumps({"verdict": {"choice": "keep", "probabilities": {"keep": 0.8, "revise": 0.1, "drop": 0.1}, "confidence": 0.8}, "safe": {"bool": 0.9}, "quality": {"score": 1.0, "confidence": 1.0, "probabilities": None}})


def states(spark, ids="abc"):
    return spark.createDataFrame([(i, k, f"s{i}") for k, i in enumerate(ids)], "id string, pos int, state_sha256 string")


def items(spark, keys, attempt=1, ok=True):
    rows = [(k, attempt, (ok, None if ok else "failed", ANSWERS if ok else None, "m", "m", "m", False, "m", "hit", 3, 0)) for k in keys]
    return spark.createDataFrame(rows, "key string, attempt int, item " + J.ITEM.simpleString())


def test_results_for_no_state_and_double_results_stop_adoption(spark):
    good = J.adopt(states(spark), items(spark, "ab"), RUBRIC)
    assert {r.id: r.error for r in good.select("id", "error").collect()} == {"a": None, "b": None, "c": J.NOT_DELIVERED}
    for keys, why in (("abx", "no state was submitted"), ("aab", "more than once")):
        with pytest.raises(Exception, match=why):
            J.adopt(states(spark), items(spark, keys), RUBRIC).select("id").collect()
    listed = {(r.key, r.problem) for r in J.refused_results(states(spark), items(spark, "aabx")).collect()}
    assert listed == {("a", "duplicate key"), ("x", "unexpected key")}


def test_a_table_judge_is_asked_again(spark):
    table = items(spark, "a").unionByName(items(spark, "b", ok=False)).unionByName(items(spark, "b", 2)).unionByName(items(spark, "cc")).unionByName(items(spark, "a", 2, ok=False))
    got = {r.id: (r.attempt, r.error, r.verdict) for r in J.run(states(spark, "abcd"), RUBRIC, J.TableJudge(table)).collect()}
    assert got == {"a": (1, None, "keep"), "b": (2, None, "keep"), "c": (2, J.NOT_DELIVERED, None), "d": (2, J.NOT_DELIVERED, None)}


def judged(spark, ids="abc"):
    return J.adopt(states(spark, ids), items(spark, ids), RUBRIC)


def test_rows_of_another_rubric_are_refused(spark):
    rows = judged(spark)
    foreign = rows.withColumn("qhash", F.when(F.col("id") == "b", "other").otherwise(F.col("qhash")))
    assert R.pilot_check(rows, RUBRIC, min_units=1).count() == 1
    for ask in (lambda d: R.pilot_check(d, RUBRIC).select("units"), lambda d: R.gate(rows, d, RUBRIC, qid="verdict").select("class"), lambda d: R.calibration_pool(d, RUBRIC, qid="verdict", label="keep").select("p")):
        with pytest.raises(Exception, match="another rubric"):
            ask(foreign).collect()


def test_repeated_rows_are_refused(spark):
    rows = judged(spark)
    twice = rows.unionByName(rows.where("id = 'a'"))
    for ask in (lambda: R.gate(rows, twice, RUBRIC, qid="verdict").select("class"), lambda: R.splice(rows, twice).select("assembly"), lambda: R.splice(twice, rows.where("id = 'b'")).select("id")):
        with pytest.raises(Exception, match="repeated key"):
            ask().collect()
    with pytest.raises(Exception, match="absent from the base"):
        R.splice(rows.where("id = 'a'"), rows).select("assembly").collect()
    report = spark.createDataFrame([("a", 0, False, False), ("a", 1, False, True)], "id string, truncated int, oversize boolean, unmeasured boolean")
    flagged = {r.id: r.why for r in R.flag(rows.withColumn("coverage_complete", F.lit(True)), report=report).collect()}
    assert flagged["a"][-2:] == ["truncated", "unmeasured"] and all("truncated" not in why for i, why in flagged.items() if i != "a")


def test_opinions_that_differ_are_errors(spark):
    pool = spark.createDataFrame([("a", 0.95, 5), ("b", 0.95, 5)], "id string, p double, stratum int")
    opinions = spark.createDataFrame([("a", "keep"), ("a", "drop"), ("b", "keep"), ("b", "keep")], "id string, verdict string")
    bins = {r.stratum: (r.calibrated, r.agreed, r.errors) for r in R.calibrate(pool, pool, opinions, agree=["keep"])[0].collect()}
    assert bins[5] == (1, 1, 1)


def test_an_attempt_that_delivers_twice_has_no_item(spark):
    planned = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "b", "late")], "attempt int, key string, failure string")
    delivered = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (1, "b", 9)], "attempt int, key string, item int")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    got = {r.key: (r.attempt, r.item, r.issue) for r in J.latest_outcomes(planned, delivered, keys).collect()}
    assert got == {"a": (1, None, J.TWICE), "b": (2, None, "late"), "c": (None, None, "not submitted before the interruption")}


def test_float_noise_does_not_decide_a_margin(spark):
    one = spark.createDataFrame([(0.3, 0.2, 0.1, None)], "`verdict.keep` double, `verdict.revise` double, `verdict.drop` double, error string")
    low = A.policy_reason({"verdict": {"margin": 0.1}}, RUBRIC)
    assert one.select(low.alias("why"), A.measures("verdict", RUBRIC["verdict"])["margin"].alias("m")).first() == (None, 0.1)


def test_json_strings_of_odd_texts(spark):
    texts = ["", "plain", 'a"b\\c/d', "".join(map(chr, range(1, 32))) + "\x7f\x80\u2028\ufffd", "\x0b\x1f", "\\u00e9 \\u001F", "\U0001f600é<>&'", "\x00", "}{\n}", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", D.json_string(F.col("t")).alias("j"))
    assert {r.n: r.j for r in df.collect()} == {n: None if t is None else json.dumps(t, ensure_ascii=False) for n, t in enumerate(texts)}


def test_answers_of_odd_shapes_decode_in_steps_as_at_once(spark):
    full = json.loads(ANSWERS)
    score = lambda **x: {**full, "quality": {**full["quality"], **x}}
    odd = [full, {}, {**full, "verdict": {**full["verdict"], "probabilities": [1]}}, {**full, "verdict": {**full["verdict"], "choice": "other"}}, {**full, "safe": {"bool": 1.5}}, score(probabilities=[0.2, 0.3, 0.5]),
           score(probabilities={"0": 0.2, "1": 0.3, "2": 0.5}), score(probabilities={"0": 1.0}), score(probabilities=[0.9, 0.3, 0.5]), score(legend=["a", "b", "c"]), score(legend=["a"]), score(score=7), score(probabilities="x")]
    df = spark.createDataFrame([(n, json.dumps(a)) for n, a in enumerate(odd)] + [(99, "no json"), (100, None)], "n int, t string").withColumn("a", F.try_parse_json("t"))
    steps = A.Steps(df)
    staged = A.all_valid(F.col("a"), RUBRIC, keep=steps)
    got = {r.n: (r.x, r.y) for r in steps.df.select("n", staged.alias("x"), A.all_valid(F.col("a"), RUBRIC).alias("y")).collect()}
    assert {n for n, (x, _) in got.items() if x} == {0, 5, 6, 9} and all(x == y for x, y in got.values())


def test_signatures_that_share_an_id_are_judged_and_counted_once_each(spark, folder, tmp_path):
    """The ids are ten hex digits; these two lines have the same ones. Each alone gets a delivered result, so both do."""
    def triage(name, *lines):
        at = str(tmp_path / name)
        spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{folder}/events.parquet").write.parquet(f"{at}/events.parquet")
        return {r.reason: (r.signatures, r.lines) for r in signature_triage(spark, at).collect()}

    one, two = "line hoythv", "line hprnvz"
    alone = triage("alone", one)
    assert alone == triage("other", two)
    assert triage("both", one, two, one) == {reason: (2, 3) for reason in alone}
