"""The study panel: percentiles in a symbol's past, large trades, leaders and paths, against plain code; the query against its oracle."""

import datetime
import os
import random

import duckdb
import numpy as np
import pytest
from test_oracles import rows as sorted_rows

from tapeloom.operators import panel
from tapeloom.plans.catalogue import ORACLES, QUERIES

DAY = datetime.date(2020, 1, 6)


@pytest.fixture(scope="module")
def sessions(spark):
    """Two symbols, one of 400 sessions and one of 30; ties, a null, a NaN, and a column whose name clashes."""
    draw = random.Random(3)
    rows = [(s, i, float(draw.randint(0, 20)), draw.random(), i % 5 == 0, -1.0) for s, n in (("A", 400), ("B", 30)) for i in range(n)]
    rows[7] = ("A", 7, None, float("nan"), False, -1.0)
    return rows, spark.createDataFrame(rows, "symbol string, i int, x double, y double, on_grid boolean, p_x double").repartition(3)


@pytest.mark.parametrize("lookback, only", [(250, None), (40, "on_grid"), (7, "on_grid")])
def test_ranks_in_the_past(sessions, lookback, only):
    rows, frame = sessions
    least = min(lookback, 20)
    found = {(r.symbol, r.i): r for r in panel.ranked_in_past(frame, ["x", "y"], lookback, least, only).collect()}
    assert set(found) == {(s, i) for s, i, _, _, grid, _ in rows if grid or not only}
    for s in "AB":
        of = [r for r in rows if r[0] == s]
        for c, at in (("x", 2), ("y", 3)):
            v = [0.0 if r[at] is None or r[at] != r[at] else r[at] for r in of]
            for i in range(len(v)):
                past = v[max(0, i - lookback) : i]
                wanted = 100 * (sum(p < v[i] for p in past) + 0.5 * sum(p == v[i] for p in past)) / len(past) if len(past) >= least else None
                if (s, i) in found:
                    assert found[s, i][f"p_{c}"] == (None if wanted is None else pytest.approx(wanted))


def test_ranks_of_an_empty_table(sessions):
    assert panel.ranked_in_past(sessions[1].limit(0), ["x"]).count() == 0


def test_large_quantity_knows_only_the_past(spark):
    draw = random.Random(4)
    rows = [("A", i, draw.randint(1, 50), draw.choice([100.0, 250.5, 900.0, draw.random() * 1000])) for i in range(70) for _ in range(draw.randint(1, 6))]
    found = {r.i: r.large_qty for r in panel.large_quantity(spark.createDataFrame(rows, "symbol string, i int, qty long, amt double").repartition(3)).collect()}
    for day in range(70):
        past = [a for _, i, _, a in rows if day - 30 <= i < day]
        assert found[day] == (sum(q for _, i, q, a in rows if i == day and a >= np.percentile(past, 90)) if past else 0)


def test_paths(spark):
    """Entry at the next open; the stop wins a day on which both are touched; no row without a whole path."""
    day = lambda i: DAY + datetime.timedelta(i)
    bars = [("UP", day(i), 100.0, 100.0 + (12 if i == 5 else 1), 99.0, 100.5) for i in range(22)] + [("BOTH", day(i), 100.0, 111.0 if i == 3 else 101.0, 92.0 if i == 3 else 99.0, 100.0) for i in range(21)]
    bars += [("FLAT", day(i), 50.0, 51.0, 49.0, 50.0 + i / 10) for i in range(21)] + [("SHORT", day(i), 1.0, 1.0, 1.0, 1.0) for i in range(20)] + [("FREE", day(i), 0.0, 1.0, 1.0, 1.0) for i in range(30)]
    b = spark.createDataFrame(bars, "symbol string, dt date, o double, h double, l double, c double")
    out = {(r.symbol, r.dt): r for r in panel.forward(b.select("symbol", "dt"), b).collect()}
    assert set(out) == {("UP", day(0)), ("UP", day(1)), ("BOTH", day(0)), ("FLAT", day(0))}
    up, both, flat = out["UP", day(0)], out["BOTH", day(0)], out["FLAT", day(0)]
    assert (up.entry, up.tt_target, up.tt_stop, up.managed, up.hold) == (100.0, 5, 0, 0.10, 5) and out["UP", day(1)].tt_target == 4
    assert (both.tt_target, both.tt_stop, both.managed, both.hold) == (3, 3, -0.07, 3)
    assert (flat.tt_target, flat.tt_stop, flat.hold) == (0, 0, 20) and flat.managed == pytest.approx(0.04) == flat.fwd_20 and flat.fwd_5 == pytest.approx(0.01)
    assert (flat.mfe, flat.mae) == (pytest.approx(0.02), pytest.approx(-0.02))


def test_leading_pair_counts_trades(spark):
    trades = [("A", i, 1, 2) for i in range(3)] + [("A", 4, 3, 1)] * 3 + [("A", 19, 9, 9)]
    t = spark.createDataFrame(trades, "symbol string, i int, buyer int, seller int")
    days = spark.createDataFrame([("A", i, i % 5 == 0) for i in range(21)], "symbol string, i int, on_grid boolean")
    found = {r.i: (r.pair_buyer, r.pair_seller, r.pair_trades) for r in panel.leading_pair(t, days).collect()}
    assert found == {0: (1, 2, 1), 5: (1, 2, 3), 10: (1, 2, 3), 15: (3, 1, 3), 20: (9, 9, 1)}


def test_rules_are_rows(spark):
    """A family fires where all its conditions hold; a null holds for none; rates need 30 occurrences."""
    draw, rules_all = random.Random(6), [*panel.RULES, ("rare", "short", "p_tilt_15", ">=", 100.0), ("rare", "short", "p_conc_7", ">=", 100.0), ("rare", "short", "p_conc_7", ">=", 100.0)]
    columns = sorted({r[2] for r in panel.RULES})
    rows = [(f"S{i % 4}", DAY + datetime.timedelta(i // 4), *(draw.choice([None, 0.0, 20.0, 30.0, 70.0, 80.0, 100.0]) for _ in columns), draw.uniform(-1, 1), 0.2, -0.1, i % 3, i % 2, 0.05, 4) for i in range(200)]
    frame = spark.createDataFrame(rows, "symbol string, dt date, " + ", ".join(f"{c} double" for c in columns) + ", fwd_20 double, mfe double, mae double, tt_target int, tt_stop int, managed double, hold int")
    found = {r.family: r for r in panel.rule_families(frame, rules_all).collect()}
    holds = lambda row, c, op, cut: row[2 + columns.index(c)] is not None and (row[2 + columns.index(c)] >= cut if op == ">=" else row[2 + columns.index(c)] <= cut)
    mean = {d: np.mean([r[2 + len(columns)] for r in rows if r[1] == d]) for d in {r[1] for r in rows}}
    for family in {r[0] for r in rules_all}:
        rules = [r for r in rules_all if r[0] == family]
        hit = [r for r in rows if all(holds(r, *x[2:]) for x in rules)]
        sign = 1 if rules[0][1] == "long" else -1
        assert (found[family].n, found[family].symbols, found[family].days) == (len(hit), len({r[0] for r in hit}), len({r[1] for r in hit}))
        if len(hit) < 30:
            assert found[family].mean_ret is None and found[family].avg_hold is None
        else:
            assert found[family].mean_excess == pytest.approx(np.mean([sign * (r[2 + len(columns)] - mean[r[1]]) for r in hit]))
            assert found[family].target_rate == pytest.approx(np.mean([r[5 + len(columns) if sign > 0 else 6 + len(columns)] > 0 for r in hit]))
    assert 0 < found["rare"].n < 30


@pytest.mark.parametrize("name", ["study_panel", "rule_families"])
def test_panel_matches_its_oracle(spark, name):
    """On tables with enough sessions: the smallest have none."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    found, wanted = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert len(found) == len(wanted) >= (1000 if name == "study_panel" else 10) and sorted(found.columns) == sorted(wanted.columns)
    assert sorted_rows(found) == sorted_rows(wanted)
    assert len(panel.FEATURES) == len(set(panel.FEATURES)) == 64
