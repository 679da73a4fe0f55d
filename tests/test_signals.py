import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import signals

DAY = date(2024, 1, 1)


def decay_of(spark, points):
    return signals.decay(spark.createDataFrame([("A", d, float(v)) for d, v in points], "symbol string, d long, v double")).first()


def test_decay_of_a_falling_signal(spark):
    points = [(1, 100), (3, 82), (7, 55), (15, 21)]
    r = decay_of(spark, points)
    xs, ys = [d - 1 for d, _ in points], [math.log(v) for _, v in points]
    mx, my = sum(xs) / 4, sum(ys) / 4
    rate = -sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    assert r.rate == pytest.approx(rate) and r.half_life == pytest.approx(math.log(2) / rate)
    assert (r.days, r.day1, r.peak_day, r.latest, r.persistence, r.recovery, r.reacceleration, r.label) == (4, 100.0, 0, 21.0, 0.75, 0.0, 0.0, "decaying")


def test_decay_is_anchored_at_its_own_peak(spark):
    r = decay_of(spark, enumerate([10, 50, 100, 40, 30, 80, 70]))
    assert (r.day1, r.peak_day, r.latest) == (10.0, 2, 70.0)
    assert r.recovery == pytest.approx(0.5) and r.persistence == pytest.approx(3 / 5)  # 30 -> 80; 100, 80 and 70 of five
    assert r.reacceleration == pytest.approx(180 / 3 - 190 / 3) and r.label == "recovering"
    rising = decay_of(spark, enumerate([1, 2, 3, 10, 20, 30]))
    assert rising.label == "reaccelerating" and rising.half_life is None and rising.peak_day == 5


def test_decay_without_a_signal(spark):
    r = decay_of(spark, [(4, 0.0), (5, 0.0)])
    assert (r.days, r.peak_day, r.rate, r.half_life, r.persistence, r.label) == (2, 0, 0.0, None, 0.0, "flat")
    assert decay_of(spark, [(0, 5.0)]).label == "persistent"
    assert signals.decay(spark.createDataFrame([], "symbol string, d long, v double")).count() == 0


def marks_of(spark, lines, trends=None, symbol="A"):
    n = len(lines)
    trends = trends or [0.0] * n
    rows = [(symbol, DAY + timedelta(i), i + 1, n, x, t, (x > 0.001) - (x < -0.001), i / 100, 5, 0.0) for i, (x, t) in enumerate(zip(lines, trends, strict=True))]
    return spark.createDataFrame(rows, "symbol string, dt date, i int, n int, line double, trend double, side int, hhi double, participants long, large_share double")


def test_freshness_dates_the_last_run_of_each_side(spark):
    m = marks_of(spark, [0.2, 0.3, -0.1, -0.2, 0.0, 0.4, 0.5, 0.0], [0.1, 0.1, 0.0, -0.2, 0.1, 0.1, 0.0005, 0.1])
    f = signals.freshness(m).first()
    assert (f.signal, f.signal_age, f.origin, f.accumulation_run, f.accumulation_active) == ("accumulation", 2, 5, 2, False)
    assert (f.days_since_distribution, f.distribution_run, f.distribution_active) == (5, 2, False)
    assert f.days_since_flow_reversal == 3  # the turn from -0.2 to 0.1; 0.0005 is within the neutral band
    e = {r.event: r for r in signals.events(m).collect()}
    assert e["concentration spike"].age == 0 and e["concentration spike"].active  # rank round(0.9 * 7) = 6 is 0.06, and 0.07 is above it
    assert "participation expansion" not in e and "large-trade emergence" not in e
    assert e["accumulation start"].level == pytest.approx(0.4) and e["distribution start"].dt == DAY + timedelta(2)


def test_freshness_without_a_side(spark):
    m = marks_of(spark, [0.0, 0.0005])
    f = signals.freshness(m).first()
    assert (f.signal, f.signal_age, f.accumulation_run, f.days_since_accumulation, f.accumulation_active) == ("none", None, 0, None, False)
    assert signals.signal_points(m, signals.freshness(m)).count() == 0


def test_percentile_between_equal_values(spark):
    rows = [("A", x) for x in (1.0, 1.0, 2.0, 4.0)] + [("B", 7.0)]
    got = {r.k: r.p for r in signals.linear_percentile(spark.createDataFrame(rows, "k string, x double"), "k", "x", 0.9, "p").collect()}
    assert got == {"A": pytest.approx(2 + 2 * 0.7), "B": 7.0}


def folded(days):
    """Streaks in turn: days of (turnover, {broker: net}) -> the streak of each buyer before each session that counts."""
    streak, found = {}, []
    for turnover, nets in days:
        if turnover < signals.MIN_TURNOVER:
            streak |= {b: 0 for b, net in nets.items() if net <= 0}
            continue
        found.append({b: streak.get(b, 0) for b, net in nets.items() if net > 0})
        streak |= {b: streak.get(b, 0) + 1 if net > 0 else 0 for b, net in nets.items()}
    return found


def test_streaks_end_on_thin_sessions_only_for_those_who_do_not_buy(spark):
    rich, thin = signals.MIN_TURNOVER, 1.0
    days = [(rich, {1: 5, 2: -5}), (rich, {1: 3, 2: -3}), (thin, {1: 4, 2: -4}), (rich, {1: 2, 2: -2}), (rich, {1: 9, 3: -9}), (thin, {1: -1, 3: 1}), (rich, {1: 6, 3: -6}), (rich, {2: 1, 1: 7, 3: -8})]
    rows = []
    for i, (turnover, nets) in enumerate(days):
        for b, net in nets.items():
            rows.append(("A", DAY + timedelta(i), b, max(net, 0) + 1, max(-net, 0) + 1, net, turnover / len(nets), 0.0, 1))
    flow = spark.createDataFrame(rows, "symbol string, dt date, broker int, bought long, sold long, net long, buy_amt double, sell_amt double, trades long")
    got = signals.streak_features(flow).orderBy("dt").collect()
    want = folded(days)
    assert [r.streak_max for r in got] == [max(w.values(), default=0) for w in want] == [0, 1, 2, 3, 0, 1]
    assert [r.persist_k > 0 for r in got] == [any(v >= signals.STREAK for v in w.values()) for w in want]
    assert got[3].persist_k == pytest.approx(9 / 11) and got[3].buyer_ratio == 1.0


def test_streaks_without_rows(spark):
    flow = spark.createDataFrame([], "symbol string, dt date, broker int, bought long, sold long, net long, buy_amt double, sell_amt double, trades long")
    assert signals.streak_features(flow).count() == 0


def test_marks_look_at_the_last_sessions_only(spark):
    rows = [("A", DAY + timedelta(i), 1, 2, 10 + i, 1.0, float(10 + i), i, 1, 1, 1) for i in range(10)]
    t = spark.createDataFrame(rows, "symbol string, dt date, buyer int, seller int, qty long, rate double, amt double, ok long, ln int, pk long, sk long")
    m = signals.marks(t, 4).orderBy("i").collect()
    assert [(r.dt, r.i, r.n) for r in m] == [(DAY + timedelta(6 + k), k + 1, 4) for k in range(4)]
    assert [r.large_share for r in m] == [0.0, 0.0, 0.0, 1.0] and m[0].tilt == 0.0 and m[0].hhi == pytest.approx(0.5)
    assert signals.marks(t.filter(F.lit(False))).count() == 0


def test_prices_before_an_ex_date_are_scaled_from_close_to_close(spark):
    from tapeloom.operators import series

    o, c = [100.0, 101.0, 50.0, 60.0, 30.0], [100.0, 100.0, 60.0, 60.0, 58.0]  # the third opens and closes lower; the last is bought back
    bars = spark.createDataFrame([("A", DAY + timedelta(i), x, max(x, y), min(x, y), y, 10, 1.0) for i, (x, y) in enumerate(zip(o, c, strict=True))], "symbol string, dt date, o double, h double, l double, c double, v long, amount double")
    assert [(r.dt, r.factor) for r in series.ex_dates(bars).collect()] == [(DAY + timedelta(2), 0.6)]
    got = series.adjusted(bars).orderBy("dt").collect()
    assert [round(r.c, 5) for r in got] == [60.0, 60.0, 60.0, 60.0, 58.0] and [round(r.o, 5) for r in got[:3]] == [60.0, 60.6, 50.0] and got[0].v == 10
