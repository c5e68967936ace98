"""Missing values block, raise or are kept apart; they never pass a gate in silence."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.clocks import CLOCKS
from tidemark.functions.hashing import row_hash
from tidemark.operators import alerts, backtest, gates, ledger


def test_a_missing_clock_fails_the_backtest(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, *[d] * 5) for d in days]
    rows[1] = (1, days[1], days[1], days[1], None, days[1])
    facts = spark.createDataFrame(rows, "instrument_id long, " + ", ".join(f"{c} timestamp" for c in CLOCKS))
    times = backtest.time_index(facts)
    with pytest.raises(Exception, match="lacks one of its clocks"):
        backtest.visibility(facts, times, 30).collect()
    assert backtest.visibility(facts.dropna(), times, 30).count() == 2


def test_model_rules_need_every_field(spark):
    fields = "model_name version feature_version status governance_scope real_data_candidate_gate drift_status data_mode".split()
    good = ["RuleBasedV1", "1.0.0", "rule-features-v1", "EXPERIMENTAL", "DEMO_FIXTURE_ONLY", "BLOCKED",
            "NOT_APPLICABLE_TO_FIXED_FIXTURE", "DEMO_FIXTURE"]
    rows = [tuple(good)] + [tuple(None if i == k else v for i, v in enumerate(good)) for k in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    sizes = [r[0] for r in df.select(F.size(gates.model_rules(F.col("data_mode")))).collect()]
    assert sizes[0] == 0 and all(n > 0 for n in sizes[1:])


def test_row_texts_tell_values_apart(spark):
    schema = "a double, b array<string>, c string, d string"
    rows = [
        (1e-7, ["a"], "x", "y"), (2e-7, ["a"], "x", "y"), (1.0, ["a,b"], "x", "y"), (1.0, ["b", "a"], "x", "y"), (1.0, ["a", "b"], "x", "y"),
        (1.0, ["a", None], "x", "y"), (1.0, ["a"], None, "y"), (1.0, ["a"], "\\N", "y"), (1.0, ["a"], "x\x1fy", ""), (1.0, ["a"], "x", "\x1fy"),
        (1.0, ["a"], "x\\", "u"), (1e300, [], "x", "y"), (float("nan"), None, "x", "y"), (1.0 + 1e-9, ["a"], "x", "y"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert df.select(row_hash(df).alias("h")).distinct().count() == len(rows)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert zeros.select(row_hash(zeros).alias("h")).distinct().count() == 1


def test_secrets_are_masked_whole():
    got = text.redact_text('{"token": {"a": "s3", "b": ["}"]}, "n": {"Secret":["x"], "k": 1}, "password": null, "cookie": "a\\"b", "z": "token"}')
    assert got == (
        '{"token": "[REDACTED]", "n": {"Secret":"[REDACTED]", "k": 1}, "password": "[REDACTED]", "cookie": "[REDACTED]", "z": "token"}'
    )


def test_references_and_encodings(spark):
    df = spark.createDataFrame([("&frac12;&thetasym;&copy 1 &#150; a&b",), (None,), ("plain",)], "s string")
    assert [r[0] for r in df.select(text.unescape(F.col("s"))).collect()] == ["½ϑ© 1 – a&b", None, "plain"]
    urls = spark.createDataFrame([("http://a.b/?x=~1&y=a+%zz",)], "u string")
    assert urls.select(text.normalize_url(F.col("u"))).first()[0] == "http://a.b/?x=~1&y=a+%25zz"


def test_allocation_keeps_rows_and_books_apart(spark):
    limits = SimpleNamespace(
        news_threshold=0.5, single_cap=0.3, max_turnover=1.0, asset_class_cap=1.0, industry_cap=1.0, region_cap=1.0,
        cash_floor=0.0, slippage_bps=0.0, fee_bps=0.0,
    )
    at = dt.datetime(2024, 1, 1)
    rows = [
        (p, at, 10 * p + k, k, "e", "i", "r", 1.0 - k / 10, 0.2, news, 10.0, 1.0)
        for p in (1, 2) for k, news in ((1, 0.1), (2, None), (3, -0.9))
    ]
    candidates = spark.createDataFrame(
        rows, "portfolio_id long, decided_at timestamp, signal_id long, instrument_id long, asset_class string, industry string, "
        "region string, composite_score double, risk_budget_max double, news_score double, open double, fx_rate double",
    )
    books = spark.createDataFrame(
        [(1, 100_000.0, 100_000.0, [])],
        "portfolio_id long, nav double, cash double, holdings array<struct<instrument_id: long, weight: double, asset_class: string, "
        "industry: string, region: string>>",
    )
    got = {r["signal_id"]: r["status"] for r in ledger.allocate(candidates.coalesce(1), books, limits).collect()}
    refused = "EVALUATED_NO_ALLOCATION"
    assert got == {11: "FILLED", 12: refused, 13: refused, 21: "NO_BOOK", 22: refused, 23: refused}


def test_acknowledging_again_changes_nothing(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = spark.createDataFrame([(1, "OPEN", True), (2, "OPEN", True)], "alert_id long, status string, content_ok boolean")
    acks = spark.createDataFrame([(1, t[0], "a")], "alert_id long, acked_at timestamp, actor string")
    once = alerts.acknowledge(rows, acks)
    again = alerts.acknowledge(once, spark.createDataFrame([(1, t[1], "b")], acks.schema))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_stored_error_codes_stay(spark):
    now = dt.datetime(2024, 1, 1, 12)
    runs = spark.createDataFrame(
        [(1, "FAILED", "OLD", now), (2, "RUNNING", None, now - dt.timedelta(hours=1)), (3, "RUNNING", None, now)],
        "run_id long, status string, error_code string, started_at timestamp",
    )
    got = {r["run_id"]: (r["status"], r["error_code"]) for r in alerts.expire_leases(runs, F.lit(now)).collect()}
    assert got == {1: ("FAILED", "OLD"), 2: ("FAILED", "TASK_LEASE_EXPIRED"), 3: ("RUNNING", None)}


def test_average_cost_of_nothing_and_of_no_one(spark, tmp_path):
    from tests.harness import duck, _rows
    from tidemark.plans import QUERIES
    from tidemark.sources.tables import SCHEMAS

    at = dt.datetime(2024, 1, 2)
    rows = [(1, at, 7, "purchase", 0.0, '{"k": 1}'), (2, at, None, "purchase", 5.0, '{"k": 2}'), (3, at, 8, "purchase", None, '{"k": 3}'),
            (4, at, None, "signup", 1.0, '{"k": 4}'), (5, at, 9, "purchase", 9.5, '{"k": 5}'), (6, at, 9, "purchase", -30.0, '{"k": 6}')]
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows if name == "events" else [], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, cur = QUERIES["average_cost"](spark, str(tmp_path)), con.execute(QUERIES["average_cost"].sql)
    names = [d[0] for d in cur.description]
    want = _rows(cur.fetchall(), names)
    assert len(want) == 5 and _rows(map(tuple, got.collect()), got.columns) == want
