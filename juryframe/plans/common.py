"""Rubric, states and derived inputs the queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from juryframe.functions import text as T
from juryframe.operators import judge as J, shape as S
from juryframe.rubric import Policy, Rubric, choice, scale, yes
from juryframe.sources.tables import document_units, table

RUBRIC = Rubric({
    "verdict": choice("What should happen to this text?", keep="It is fit as it is.", revise="It needs work.", drop="It has no use."),
    "safe": yes("Is the text safe to publish?", true="Nothing private or harmful.", false="Something private or harmful."),
    "quality": scale("How good is the writing?", "poor", "fair", "good"),
})
POLICY = Policy.of(RUBRIC, {"verdict": {"top": 0.5, "margin": 0.1}, "safe": {"band": (0.3, 0.7)}, "quality": {"spread": 0.8}})


#: No cap: states hold whole texts. Shaping with a cap is the subject of `state_outcomes` alone.
WHOLE = 2 ** 30
#: Events that answer one document, and which of them the two attempts of each judge take.
PER_DOC = 5
JUDGES = {"a": (0, 1), "b": (2, 3), "c": (3, 4), "p": (4, 0)}


def doc_states(spark: SparkSession, folder: str, text: Column | None = None) -> DataFrame:
    """Submitted states of all documents: id, pos, state, state_sha256 and the shaping outcome."""
    units = document_units(spark, folder)
    if text is not None:
        units = units.withColumn("text", text)
    return S.states(units, cap=WHOLE).where(F.col("status") == "submitted")


def opinions(spark: SparkSession, folder: str, judge: str = "a", faults: bool = True) -> DataFrame:
    """Delivered results from the event table: head (the document they are about), attempt, failed, broken, and what the event says.

    Five events in a row are the opinions on one document. Without `faults` every event is a good delivery.
    """
    first, second = JUDGES[judge]
    n = F.col("event_id")
    e = table(spark, folder, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    e = e.withColumn("attempt", F.when(n % PER_DOC == first, 1).when(n % PER_DOC == second, 2)).where("attempt IS NOT NULL")
    k, user = F.col("k"), F.col("user_id")
    v0, q0 = F.least(F.floor(F.col("value") * 100), F.lit(10000)), (k * 97 + user * 31) % 101 * 100
    v1, q1 = F.floor((10000 - v0) * k / 100), F.floor((10000 - q0) * (user % 101) / 100)
    failed = F.when(F.col("event_type") == "error", "transport failure").when((F.col("event_type") == "purchase") & (k % 5 == 0), J.TOO_LARGE + ": 40000 tokens")
    rows = e.where(k % 53 != 2) if faults else e
    return rows.select(F.floor(n / PER_DOC).alias("head"), "attempt", (failed if faults else F.lit(None).cast("string")).alias("failed"), ((k % 41 == 3) & F.lit(faults)).alias("broken"),
                       ((user % 23 == 7) & F.lit(faults)).alias("blank"), ((user % 29 == 5) & F.lit(faults)).alias("nameless"), "k", "user_id", F.array(v0, v1, 10000 - v0 - v1).alias("v"),
                       (user * 67 % 10001).alias("s"), F.array(q0, q1, 10000 - q0 - q1).alias("q"), (k % 7 != 0).alias("spread"))


def answer_json(o: Column, slot: Column | None = None) -> Column:
    """The answers an opinion gives to the rubric; `slot` is the suffix of the question names of a grouped state."""
    share = lambda x: x / 10000
    v, q = [o["v"][i] for i in range(3)], [o["q"][i] for i in range(3)]
    top = F.greatest(*v)
    names = list(RUBRIC["verdict"].criteria)
    verdict = F.struct(F.lit("choice").alias("type"), F.coalesce(*[F.when(x == top, n) for n, x in zip(names, v)]).alias("choice"), F.struct(*[share(x).alias(n) for n, x in zip(names, v)]).alias("probabilities"), share(top).alias("confidence"))
    safe = F.struct(F.lit("bool").alias("type"), F.when(o["broken"], 1.5).otherwise(share(o["s"])).alias("bool"))
    quality = F.struct(F.lit("score").alias("type"), share(q[1] + 2 * q[2]).alias("score"), share(F.greatest(*q)).alias("confidence"), F.when(o["spread"], F.array(*map(share, q))).alias("probabilities"))
    suffix = F.lit("") if slot is None else F.concat(F.lit("@"), slot)
    pairs = [F.concat(F.lit(f'"{n}'), suffix, F.lit('":'), F.to_json(body)) for n, body in (("verdict", verdict), ("safe", safe), ("quality", quality))]
    return F.concat_ws(",", *pairs)


def item_of(o: Column, answers: Column) -> Column:
    """The delivered item of an opinion: its outcome, its route and the answers."""
    user, model = o["user_id"], F.when(o["user_id"] % 10 == 0, "stub-b").otherwise("stub-a")
    return F.struct(
        o["failed"].isNull().alias("ok"), o["failed"].alias("error"), F.when(o["failed"].isNull(), F.concat(F.lit("{"), answers, F.lit("}"))).alias("answers"), F.when(~o["nameless"], model).alias("model"),
        model.alias("selected_model"), F.lit("stub-a").alias("primary_model"), (user % 10 == 0).alias("fallback"), model.alias("response_model"),
        F.when(~o["blank"], F.get(F.array(F.lit("hit"), F.lit("partial"), F.lit("miss")), (user % 3).cast("int"))).alias("cache"), F.lit(3).alias("questions"),
        F.get(F.array(F.lit(3), F.lit(1), F.lit(0)), (user % 3).cast("int")).alias("cached_questions")).cast(J.ITEM)


def results(spark: SparkSession, folder: str, keys: DataFrame, judge: str = "a", faults: bool = True) -> J.TableJudge:
    """The judge that holds the opinions for `keys` (key, head)."""
    given = keys.join(opinions(spark, folder, judge, faults).withColumn("o", F.struct("*")).select("head", "attempt", "o"), "head")
    return J.TableJudge(given.select("key", "attempt", item_of(F.col("o"), answer_json(F.col("o"))).alias("item")))


def of_documents(spark: SparkSession, folder: str, judge: str = "a", faults: bool = True, of: Column | None = None) -> J.TableJudge:
    """The judge that holds the opinions on documents, or on those whose `head` meets `of`."""
    keys = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("head"))
    return results(spark, folder, keys if of is None else keys.where(of), judge, faults)


def judged(spark: SparkSession, folder: str, judge: str = "a", faults: bool = True, text: Column | None = None) -> DataFrame:
    states = doc_states(spark, folder, text).select("id", "pos", "state_sha256")
    return J.run(states, RUBRIC, of_documents(spark, folder, judge, faults))


def cat(*parts: object) -> Column:
    """Concatenate text and columns."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
