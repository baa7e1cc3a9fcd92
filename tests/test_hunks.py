"""Hunk operators: how often they read their units, and units that share an id."""

from pyspark.sql import functions as F

from juryframe.operators import hunks as H

HUNKS = [(f"f{k % 2}:+{k}", k, f"f{k % 2}", "modified", f"@@ -{k} +{k} @@", f"@@ -{k} +{k} @@\n+def g{k % 3}(x): g{(k + 1) % 3}\n", k, k)
         for k in range(1, 25)]
FIELDS = "id string, pos int, file string, status string, header string, hunk string, line int, old_line int"


def counted(spark, column):
    """Units whose `column` counts how often it is made."""
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    units = spark.createDataFrame(HUNKS, FIELDS)
    return units.withColumn(column, F.udf(seen, units.schema[column].dataType, useArrow=False)(column)), made


def test_neighbours_make_their_units_once(spark):
    units, made = counted(spark, "line")
    rows = H.neighbours(units, file="file", id="id", anchor="line", pos="pos", k=2).collect()
    assert made.value == len(HUNKS) == len(rows)
    assert {r.id: r.near for r in rows}["f1:+1"] == ["f1:+3", "f1:+5"]


def test_hunk_states_make_their_units_once(spark):
    units, made = counted(spark, "hunk")
    rows = {r.id: r for r in H.hunk_states(units, siblings=2, users=2).collect()}
    assert made.value == len(HUNKS) == len(rows)
    assert [t.split()[0:3] for t in rows["f0:+4"].nearest_sibling_hunks] == [["f0", "@@", "-2"], ["f0", "@@", "-6"]]
    # g1 is used by 1, 3, 6 and on; 6 is a near one
    assert [t.split()[2] for t in rows["f0:+4"].hunks_using_names_defined_here] == ["-1", "-3"]


def test_units_that_share_an_id_cost_no_neighbour(spark):
    units = spark.createDataFrame([("f", "a", 1, 1), ("f", "a", 1, 2), ("f", "a", 1, 3), ("f", "b", 1, 4), ("f", "c", 2, 5)], "file string, id string, line int, pos int")
    near = {(r.id, tuple(r.near)) for r in H.neighbours(units, file="file", id="id", anchor="line", pos="pos", k=3).collect()}
    assert near == {("a", ("b", "c")), ("b", ("a", "a", "a")), ("c", ("a", "a", "a"))}
