"""Steps that had grown too large: what they shuffle or hold, and that their results are those of a plain count."""

import datetime as dt
import itertools
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators.graph import sequence
from tapeloom.operators.series import filled_minutes, minute_bars
from tapeloom.plans.catalogue import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trades_of_sequences_are_read_and_sent_once(spark):
    p = plan(QUERIES["sequence_stats"](spark, SF))
    assert sum("ReadSchema" in x and "buyer" in x for x in p.split("\n")) == 1


def longest(values):
    return max(len(list(g)) for _, g in itertools.groupby(values))


def test_sequences_over_sessions_of_one_run(spark):
    draw = random.Random(3)
    rows = []
    for symbol in ("x", "y", "z"):
        for day, ok in ((d, o) for d in range(40) for o in range(draw.choice([1, 1, 1, 2, 5]))):
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(day), draw.choice([1, 1, 1, 2]), draw.choice([1, 2]), draw.choice([9.0, 10.0]), draw.randint(1, 9), ok))
    found = {r.symbol: r for r in sequence(spark.createDataFrame(rows, "symbol string, dt date, buyer int, seller int, rate double, qty long, ok long"), ["ok"]).collect()}
    for symbol, r in found.items():
        t = sorted(x for x in rows if x[0] == symbol)
        t.sort(key=lambda x: (x[1], x[6]))
        buyers, sellers, rates, sizes = ([x[i] for x in t] for i in (2, 3, 4, 5))
        pairs = list(itertools.pairwise(rates))
        half = len(t) // 2
        assert (r.n, r.longest_buyer_run, r.longest_seller_run) == (len(t), longest(buyers), longest(sellers))
        assert (r.buyer_repeats, r.seller_repeats) == tuple(sum(a == b for a, b in itertools.pairwise(x)) for x in (buyers, sellers))
        assert (r.up, r.down, r.flat) == (sum(b > a for a, b in pairs), sum(b < a for a, b in pairs), sum(a == b for a, b in pairs))
        assert (r.early_qty, r.late_qty) == (round(sum(sizes[:half]) / half, 6), round(sum(sizes[half:]) / (len(t) - half), 6))
    assert len(found) == 3


def test_filling_minutes_moves_ticks_once_and_joins_nothing(spark):
    p = plan(QUERIES["minute_fill"](spark, SF))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_filled_minutes(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    ticks = spark.createDataFrame(
        [(1, at(9, 1), 5.0, 1), (1, at(9, 40), None, 2), (1, at(10, 1), 7.0, 3), (1, dt.datetime(2024, 1, 3, 9, 0), 8.0, 4), (None, at(9, 0), 1.0, 5), (None, at(9, 30), 2.0, 6), (2, None, 3.0, 7)], "instrument long, ts timestamp, price double, seq long"
    )
    for bars in (minute_bars(ticks, 15), minute_bars(ticks, 15, by_day=True)):
        found = filled_minutes(bars, 15).withColumn("minute", F.date_format("minute", "dd HH:mm")).collect()
        own = [(r.minute, r.o, r.h, r.l, r.c, r.n) for r in sorted((r for r in found if r.instrument == 1), key=lambda r: r.minute)]
        flat = (5.0,) * 4
        assert own == [("02 09:00", *flat, 1), ("02 09:15", *flat, 0), ("02 09:30", *flat, 1), ("02 09:45", *flat, 0), ("02 10:00", 7.0, 7.0, 7.0, 7.0, 1), ("03 09:00", 8.0, 8.0, 8.0, 8.0, 1)]
        assert sorted((r.minute, r.o, r.c, r.n) for r in found if r.instrument != 1) == [("02 09:00", None, None, 0), ("02 09:15", None, None, 0), ("02 09:30", None, None, 0)]


def test_price_stats_hold_no_list_of_a_symbols_prices(spark):
    p = plan(QUERIES["price_stats"](spark, SF))
    assert "percentile(" not in p and "median(" not in p


def test_percentiles_by_slices_are_exact(spark):
    from tapeloom.operators.stats import linear_percentiles

    draw = np.random.default_rng(1)
    values = {"many": draw.normal(size=5000).round(2), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "skewed": np.array([1.0] * 900 + [2.0] * 50 + [1e9] * 3)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("one", None), ("none", None)], "k string, v double")
    points = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}
    found = {r.k: r for r in linear_percentiles(rows.groupBy("k", "v").count(), "k", "v", "count", points).collect()}
    assert set(found) == set(values)
    for k, v in values.items():
        assert np.allclose([found[k][x] for x in points], [np.quantile(v, q) for q in points.values()], rtol=0, atol=1e-6)
