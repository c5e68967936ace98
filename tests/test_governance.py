"""Checks in order, versions at a time and digests along time."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance
from tidemark.operators.governance import Check

D = lambda n: datetime(2020, 1, n)


def test_a_check_counts_only_where_its_prerequisites_passed(spark):
    rows = spark.createDataFrame(
        [(1, False, False, False), (2, True, True, True), (3, False, True, True), (4, None, False, True), (5, False, False, None)],
        "id int, a boolean, b boolean, c boolean",
    )
    checks = [Check("A", F.col("a")), Check("B", F.col("b"), needs=("A",)),
              Check("C", F.col("c"), F.lit("C:x"), needs=("A", "B"))]
    got = rows.select("id", F.transform(governance.failures(checks), lambda x: x["reason"]).alias("r")).collect()
    assert {r.id: r.r for r in got} == {1: [], 2: ["A"], 3: ["B"], 4: ["A"], 5: ["C:x"]}


def test_first_reason_is_that_of_the_first_level_and_row(spark):
    keys = spark.createDataFrame([(k,) for k in "abc"], "k string")
    head = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "k string, bad boolean")
    rows = spark.createDataFrame(
        [("a", 1, True, True), ("b", 10, False, True), ("b", 9, True, False), ("b", 2, False, False)],
        "k string, id int, x boolean, y boolean",
    )
    got = governance.first_reasons(keys, "k", [
        (head, None, [Check("HEAD", F.col("bad"))]),
        (rows, "id", [Check("X", F.col("x")), Check("Y", F.col("y"))]),
    ])
    assert {r.k: (r.level, r.reason, r.item, r.failing) for r in got.collect()} == {
        "a": (0, "HEAD", "0", 1), "b": (1, "X", "9", 2), "c": (None, None, None, 0),
    }


@pytest.fixture
def versions(spark):
    return spark.createDataFrame(
        [("p", 1, "x", D(1), D(5)), ("p", 1, "y", D(5), None), ("p", 2, "z", D(1), D(9)), ("q", 3, "x", D(3), None),
         ("p", 2, "z", D(12), None)],
        "owner string, id int, v string, valid_from timestamp, valid_to timestamp",
    )


def test_version_at_the_own_time(spark, versions):
    asked = spark.createDataFrame([(1, D(4)), (1, D(5)), (2, D(10)), (3, D(1)), (9, D(4))], "k int, at timestamp")
    got = governance.version_at(asked, versions, {"k": "id"}, "at", "held").collect()
    assert sorted((r.k, r.at.day, r.held and r.held.v) for r in got) == [
        (1, 4, "x"), (1, 5, "y"), (2, 10, None), (3, 1, None), (9, 4, None)]


def test_digests_follow_the_rows_that_hold(spark, versions):
    history = governance.digest_history(versions, ["owner"], ["id", "v"])
    days = [2, 5, 9, 12, 20]
    asked = spark.createDataFrame([("p", D(n), D(1)) for n in days] + [("q", D(2), D(3)), (None, D(2), D(3))],
                                  "o string, at timestamp, other timestamp")
    got = governance.digest_at(asked, history, {"o": "owner"}, {"at": "d", "other": "e"}).collect()
    p = {r.at.day: r.d for r in got if r.o == "p"}
    assert len(got) == 7 and p[2] != p[5] != p[9] and p[9] != p[12]
    assert p[12] == p[20] == p[5]  # the same rows hold again
    assert [r.e for r in got if r.o == "p"] == [p[2]] * 5
    assert [(r.d, r.e is None) for r in got if r.o == "q"] == [(None, False)]
    assert [(r.d, r.e) for r in got if r.o is None] == [(None, None)]
    # The order of rows and of changes doesn't matter.
    again = governance.digest_history(versions.orderBy(F.desc("v")), ["owner"], ["v", "id"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in history.collect()}


def test_reasons_keep_order_without_a_filter_by_a_function(spark):
    from tidemark.operators import gates

    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, x boolean")
    codes = gates.reasons(("A", F.col("x")), ("B", F.col("id") > 1), ("A", F.lit(True)))
    assert [r.codes for r in df.orderBy("id").select(codes.alias("codes")).collect()] == [["A"], ["A", "B"], ["B", "A"]]
    assert "lambdafunction" not in df.select(codes)._jdf.queryExecution().optimizedPlan().toString()
