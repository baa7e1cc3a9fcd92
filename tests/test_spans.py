"""Spans, deletions, citations and occurrences against plain versions, on awkward and random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from juryframe.operators import occurrences as O, ordered, spans as P

SPAN = "file string, start long, stop long"


def random_spans(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), a := rng.randrange(1, 300), a + rng.randrange(0, 12)) for _ in range(n)]


@pytest.fixture(autouse=True)
def short_runs(monkeypatch):
    """Runs of a few lines, so that every case crosses them."""
    monkeypatch.setattr(ordered, "RUN_WIDTH", 16)
    monkeypatch.setattr(P, "run_of", lambda c, width=16: ordered.run_of(c, 16))


@pytest.mark.parametrize("seed", range(2))
def test_coverage_and_islands_equal_plain_ones(spark, seed):
    spans = random_spans(seed)
    points = [(f, n) for f in ("a", "b", None, "c") for n in range(0, 320, 3)] + [("a", None), ("a", 3)]
    table = spark.createDataFrame(spans + [("a", None, 5), ("a", 9, None), ("b", 7, 3)], SPAN)
    got = P.covered(spark.createDataFrame(points, "file string, line long"), table).collect()
    whole = spans + [("a", 9, 9)]
    want = sorted((f or "", n if n is not None else -1, n is not None and any(g == f and a <= n <= b for g, a, b in whole)) for f, n in points)
    assert sorted((r.file or "", r.line if r.line is not None else -1, r.covered) for r in got) == want
    islands = []
    for f in ("a", "b", None):
        held = []
        for a, b in sorted((a, b) for g, a, b in spans if g == f):
            if held and a <= held[-1][1] + 1:
                held[-1] = [held[-1][0], max(b, held[-1][1]), held[-1][2] + 1]
            else:
                held.append([a, b, 1])
        islands += [(f or "", *h) for h in held]
    assert sorted((r.file or "", r.start, r.stop, r.spans) for r in P.merged(spark.createDataFrame(spans, SPAN)).collect()) == sorted(islands)


def plain_deletion(text, spans):
    lines, gone = text.splitlines(keepends=True), set()
    for a, b in spans:
        gone |= set(range(a, b + 1))
    after = {n + 1 for n in gone if n + 1 not in gone and n < len(lines) and not lines[n].strip()}
    return "".join(line for k, line in enumerate(lines, 1) if k not in gone | after)


@pytest.mark.parametrize("text", ["a\r\n\r\nb\n \nc d\x0ce", "one", "x\n" * 9, "\n\n\na\n\n\n", "a\n\nb\n\nc\n\nd"])
def test_deletion_keeps_the_rest(spark, text):
    n = len(text.splitlines())
    rng = random.Random(n)
    for _ in range(4):
        spans = [("f", a := rng.randrange(1, n + 1), rng.randrange(a, n + 1)) for _ in range(rng.randrange(1, 4))]
        files = spark.createDataFrame([("f", text), ("other", "x")], "file string, text string")
        row = P.deletion_plan(spark.createDataFrame(spans, SPAN), files).collect()[0]
        assert row.left == plain_deletion(text, [s[1:] for s in spans])
        assert row.units == len(spans) and row.removed == n - len(row.left.splitlines())


def test_deletion_refusals_come_in_order(spark):
    files = spark.createDataFrame([("f", "a\nb\n"), ("e", None)], "file string, text string")
    units = [("1", "f", 1, 2, False, None), ("2", "f", 0, 1, False, None), ("3", "f", 2, 1, False, None), ("4", "f", 1, 3, False, None), ("5", "/f", 1, 1, False, None), ("6", "x/../f", 1, 1, False, None),
             ("7", "g", 1, 1, False, None), ("8", "/f", 0, 9, True, None), ("9", "f", 1, 1, False, "snapshot"), ("10", "e", 1, 1, None, None), ("11", "f", None, 1, False, None)]
    table = spark.createDataFrame(units, "id string, file string, start int, stop int, read_only boolean, role string")
    got = {r.id: r.problem for r in P.deletion_problems(table, files, role="role", read_only="read_only").collect()}
    assert got == {"2": "not a 1-based span", "3": "not a 1-based span", "4": "span exceeds file", "5": "path leaves the root", "6": "path leaves the root", "7": "no such file", "8": "read-only evidence",
                   "9": "read-only evidence", "10": "span exceeds file", "11": "not a 1-based span"}
    with pytest.raises(Exception, match="exceeds its file"):
        P.deletion_plan(table.where("id = '4'"), files).collect()


def test_citations(spark):
    frozen = spark.createDataFrame([("f", "a\r\nb\nc"), ("g", "same"), ("n", None)], "file string, text string")
    now = spark.createDataFrame([("f", "a\r\nb\nc"), ("g", "other")], "file string, text string")
    asked = [("f", 1, 2), ("f", 2, 3), ("f", 3, 4), ("f", 0, 1), ("f", 1, 9), ("g", 1, 1), ("h", 1, 1), ("n", 1, 1), ("f", None, 1)]
    got = [(r.quote, r.problem) for r in P.cited(spark.createDataFrame(asked, "file string, start int, stop int"), frozen, now, most=5).collect()]
    assert sorted(got, key=str) == sorted([("a\nb", None), ("b\nc", None), (None, "span exceeds file"), (None, "invalid span"), (None, "too many lines"), (None, "source changed"), (None, "not in the snapshot"),
                                           (None, "not in the snapshot"), (None, "invalid span")], key=str)


def test_bound_units(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    shaped = spark.createDataFrame([("a", "submitted", None, 0), ("b", "dropped", "empty rendered unit", 0), ("x", "submitted", None, 1)], "id string, status string, reason string, truncated int")
    left_out = spark.createDataFrame([("c", "too long")], "id string, reason string")
    got = {r.id: (r.status, r.reason, r.truncated) for r in P.bound(units, shaped, excluded=left_out).collect()}
    assert got == {"a": ("submitted", None, 0), "b": ("dropped", "empty rendered unit", 0), "c": ("excluded", "too long", None), "d": ("dropped", "not submitted", None)}
    assert [r.id for r in P.stray(units, shaped).collect()] == ["x"]


def plain_occurrences(quotes, text):
    return sorted((q, i, i + len(q)) for q in set(quotes) if q for i in range(len(text) - len(q) + 1) if text[i:i + len(q)] == q)


def test_occurrences_overlap_and_count_bytes(spark):
    quotes = ["aa", "é", "aa", "", None, "x\ny", "𝒳", "no such"]
    texts = [("1", "aaaa\ré𝒳x\ny\r\naa"), ("2", None), ("3", ""), ("1", "aa")]
    table = spark.createDataFrame([(q,) for q in quotes], "quote string")
    for chars in (3, 1000):  # several blocks, one block
        rows = O.occurrences(table, spark.createDataFrame(texts, "doc string, text string"), block_chars=chars).collect()
        want = sorted(x for _, t in texts if t for x in plain_occurrences([q for q in quotes if q], t))
        assert sorted((r.quote, r.start, r.end) for r in rows) == want
        text = texts[0][1]
        for r in rows:
            if r.quote in ("é", "𝒳", "x\ny"):
                assert (r.byte_start, r.byte_end) == (len(text[:r.start].encode()), len(text[:r.end].encode()))
                assert r.line_start == len((text[:r.start] + "|").splitlines()) and r.line_end == len((text[:r.end - 1] + "|").splitlines())
    assert O.occurrences(table.where("quote = ''"), spark.createDataFrame(texts, "doc string, text string")).collect() == []


def test_claims_are_located(spark):
    texts = spark.createDataFrame([("1", "once twice twice")], "doc string, text string")
    claims = [("once", "1", None, None), ("twice", "1", None, None), ("twice", "1", 11, 16), ("twice", "1", 4, 9), ("never", "1", None, None), ("", "1", None, None), (None, "1", None, None), ("once", "2", None, None)]
    table = spark.createDataFrame(claims, "quote string, doc string, a long, b long")
    got = [(r.quote, r.doc, r.a, r.status, r.reason, r.start) for r in O.located(table, O.occurrences(table.select("quote"), texts), start=F.col("a"), stop=F.col("b")).collect()]
    assert sorted(got, key=str) == sorted([("once", "1", None, "candidate", None, 0), ("twice", "1", None, "rejected", "ambiguous", None), ("twice", "1", 11, "candidate", None, 11),
                                           ("twice", "1", 4, "rejected", "value does not stand at the offsets", None), ("never", "1", None, "rejected", "absent", None),
                                           ("", "1", None, "rejected", "empty value is no occurrence", None), (None, "1", None, "missing", "null value", None), ("once", "2", None, "rejected", "absent", None)], key=str)
