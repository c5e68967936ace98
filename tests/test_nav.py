"""NAV by years of groups of portfolios, against marking every holding at every time."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.harness import compare
from tidemark.operators import ledger
from tidemark.plans import QUERIES
from tidemark.sources.tables import SCHEMAS

AT = dt.datetime(2004, 6, 1, tzinfo=dt.timezone.utc)
UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def books(spark):
    draw = random.Random(7)
    day = lambda n: dt.datetime(2000, 1, 3, tzinfo=UTC) + dt.timedelta(days=n)
    bars = [(i, day(n), day(n), day(n), "v1", None if draw.random() < 0.1 else round(draw.uniform(1, 9), 2), 1.0)
            for i in range(4) for n in draw.sample(range(1700), 30) if not 360 < n < 740]
    entries, number = [], 0
    for who in range(25):
        for _ in range(draw.randint(1, 12)):
            number += 1
            what = draw.choice([None, 0, 1, 2, 3, 9])
            entries.append((who, number, day(draw.randint(-400, 1700)), what, None if what is None else float(draw.randint(-2, 3)),
                            draw.choice([None, 10.0, -3.5, 0.0])))
    frame = spark.createDataFrame(entries, "portfolio_id long, entry_id long, occurred_at timestamp, instrument_id long, quantity_delta double, cash_delta double")
    return entries, bars, frame, spark.createDataFrame(
        bars, "instrument_id long, event_time timestamp, available_at timestamp, first_seen_at timestamp, revision string, close double, fx_rate double")


def brute(entries, bars):
    out = {}
    entries = [e for e in entries if e[2] <= AT]
    for who in {e[0] for e in entries}:
        own = [e for e in entries if e[0] == who]
        held = [i for i in {e[3] for e in own} - {None} if abs(sum(e[4] for e in own if e[3] == i)) > 1e-9]
        for t in sorted({b[1] for b in bars if b[0] in held}):
            nav = sum(e[5] or 0.0 for e in own if e[2] <= t)
            for i in held:
                past = [b for b in sorted(bars, key=lambda b: b[1]) if b[0] == i and b[1] <= t and b[5] is not None]
                nav += sum(e[4] for e in own if e[3] == i and e[2] <= t) * (past[-1][5] if past else 0.0)
            out[who, int(t.timestamp())] = nav
    return out


def test_nav_at_every_time(books):
    entries, bars, book, priced = books
    got = ledger.nav_history(book, priced, AT).select("portfolio_id", F.unix_seconds("valuation_time"), "nav").collect()
    want = brute(entries, bars)
    assert len(got) == len(want) > 500
    assert {(r[0], r[1]): pytest.approx(r[2], abs=1e-9) for r in got} == want


def test_track_is_that_of_the_history(books):
    entries, bars, book, priced = books
    want = {}
    for (who, t), nav in sorted(brute(entries, bars).items()):
        top, fall, _, _ = want.get(who, (nav, None, None, None))
        top = max(top, nav)
        falls = [x for x in (fall, nav / top - 1 if top else None) if x is not None]
        want[who] = (top, min(falls, default=None), t, nav)
    got = ledger.nav_track(book, priced, AT).select(
        "portfolio_id", "max_drawdown", F.unix_seconds("valuation_time"), "marked_nav").collect()
    near = lambda x: None if x is None else pytest.approx(x, rel=1e-9, abs=1e-9)
    assert {r[0]: (near(r[1]), r[2], near(r[3])) for r in got} == {w: x[1:] for w, x in want.items()}


def test_prices_go_to_groups_not_to_holders(books):
    _, bars, book, priced = books
    rows = ledger.nav_rows(book, priced, AT).filter("portfolio_id is null and t is not null")
    assert rows.count() <= len(bars) and rows.select("part").distinct().count() == 1


def test_gate_judges_a_book_whose_value_never_left_zero_by_its_nav(spark, tmp_path):
    """Opened with a debt after the first mark, so the highest value is zero and no drawdown is known; its NAV still is."""
    at = lambda day: dt.datetime(2024, 1, day)
    kinds = ["signup", "purchase", "click"]
    events = [(1, at(20), 1, kinds[0], 1.0, '{"k": 1}'), (2, at(21), 1, kinds[1], 30.0, '{"k": 1}'),  # 1 % 7 = 1: a debt of 500
              (3, at(1), 3, kinds[0], 1.0, '{"k": 1}'), (4, at(1), 3, kinds[1], 30.0, '{"k": 1}'),
              (5, at(1), 8, kinds[0], 1.0, '{"k": 1}'), (6, at(1), 8, kinds[1], 30.0, '{"k": 1}'), (7, at(2), 8, kinds[1], 30.0, '{"k": 2}')]
    month = lambda n: dt.datetime(1995 + n // 12, n % 12 + 1, 3)
    lines = [(n, 5, 1, 1, 3.0, 90.0, 0.05, 0.02, "N", "O", month(n)) for n in range(77)] + [(99, 5, 2, 1, 3.0, 90.0, 0.05, 0.02, "N", "O", month(1))]
    rows = {"events": events, "lineitem": lines, "supplier": [(k, f"s{k}", 0, 1.0) for k in (1, 2)],
            "nation": [(0, "N", 0)], "region": [(0, "AFRICA")]}
    con = duckdb.connect()
    for name, r in rows.items():
        frame = spark.createDataFrame(r, SCHEMAS[name])
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query = QUERIES["portfolio_gate"]
    got = {r["portfolio_id"]: r for r in query(spark, str(tmp_path)).collect()}
    assert got[1]["max_drawdown"] is None and got[1]["nav"] < 0
    assert "PORTFOLIO_OPENING_CAPITAL_INVALID" in got[1]["rules"] and "PORTFOLIO_VALUATION_UNAVAILABLE" in got[1]["rules"]
    assert got[8]["nav"] is None and got[8]["rules"] == "PORTFOLIO_VALUATION_UNAVAILABLE"
    assert compare(spark, con, str(tmp_path), query)[2] is None
