"""Hand-made cases with known answers, and what must hold for any input."""

import base64
import datetime as dt
import math
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import smoothing
from tapeloom.operators import boards, calendar, indicators, series, stats
from tapeloom.sources import files

BARS = "symbol string, dt date, o double, h double, l double, c double, v long, amount double"


def bars_of(spark, closes, o=None, h=None, l=None, symbol="A"):
    day = dt.date(2024, 1, 1)
    n = len(closes)
    return spark.createDataFrame([(symbol, day + dt.timedelta(i), (o or closes)[i], (h or closes)[i], (l or closes)[i], float(closes[i]), 10, 10.0 * closes[i]) for i in range(n)], BARS)


def test_daily_upsert_replaces_appends_and_is_idempotent(spark):
    d = lambda x: dt.date(2026, 8, x)
    bar = lambda day, c: ("A", d(day), c, c, c, c, 1, c)
    stored = spark.createDataFrame([bar(14, 100.0), bar(17, 102.0)], BARS)
    out = series.upsert_bars(stored, spark.createDataFrame([bar(17, 104.0)], BARS))
    for _ in range(2):
        out = series.upsert_bars(out, spark.createDataFrame([bar(18, 108.0)], BARS))
    got = [(r.dt.day, r.c, r.change) for r in out.orderBy("dt").collect()]
    assert got == [(14, 100.0, None), (17, 104.0, 4.0), (18, 108.0, 4.0)]


def test_session_upsert_drops_rows_that_are_gone(spark):
    schema = "dt string, broker int, net int"
    stored = spark.createDataFrame([("d1", 1, 5), ("d1", 99, 7), ("d0", 99, 1)], schema)
    out = series.upsert_partition(stored, spark.createDataFrame([("d1", 1, 150), ("d1", 2, -150)], schema))
    assert sorted(map(tuple, out.collect())) == [("d0", 99, 1), ("d1", 1, 150), ("d1", 2, -150)]


@pytest.mark.parametrize("o,c,days,found", [(50, 50, 1, True), (50, 50, 13, True), (105, 85, 1, False), (97.34, 85.02, 1, False), (80, 98, 1, False), (5, 5, 1, False), (50, 50, 365, False)])
def test_ex_dates(spark, o, c, days, found):
    day = dt.date(2024, 3, 1)
    rows = [("A", day, 100.0, 100.0, 100.0, 100.0, 1, 1.0), ("A", day + dt.timedelta(days), float(o), float(o), float(c), float(c), 1, 1.0)]
    out = series.ex_dates(spark.createDataFrame(rows, BARS)).collect()
    assert [r.factor for r in out] == ([0.5] if found else [])


def test_adjusted_bars_scale_what_came_before(spark):
    out = series.adjusted(bars_of(spark, [100.0, 50.0, 51.0])).orderBy("dt").collect()
    assert [round(r.c, 9) for r in out] == [50.0, 50.0, 51.0]


def test_rsi_extremes():
    assert np.isnan(smoothing.rsi(np.full(40, 7.0), 14)[-1])
    assert smoothing.rsi(np.arange(40.0), 14)[-1] == 100
    assert smoothing.rsi(-np.arange(40.0), 14)[-1] == 0


@given(st.lists(st.floats(1, 1000), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=50, deadline=None)
def test_ema_stays_within_the_range_of_its_input(x, n):
    y = smoothing.ema(np.array(x), n)
    assert np.isnan(y[: n - 1]).all()
    good = y[~np.isnan(y)]
    assert len(good) == max(0, len(x) - n + 1) and (good >= min(x) - 1e-6).all() and (good <= max(x) + 1e-6).all()


@pytest.mark.parametrize("entry,stop,want", [(100, 90, 100), (100, 100, 0), (90, 100, 0)])
def test_position_size(spark, entry, stop, want):
    row = spark.range(1).select(boards.position_size(100_000.0, 1_000.0, F.lit(float(entry)), F.lit(float(stop))).alias("n"))
    assert row.first().n == want


def test_position_size_never_costs_more_than_the_capital(spark):
    n = spark.range(1).select(boards.position_size(100_000.0, 1_000.0, F.lit(192.83), F.lit(192.39)).alias("n")).first().n
    assert 0 < n * 192.83 <= 100_000
    assert spark.range(1).select(boards.position_size(0.0, 1_000.0, F.lit(100.0), F.lit(90.0)).alias("n")).first().n == 0


def test_a_v_bottom_has_a_demand_zone(spark):
    c = [float(x) for x in [*range(100, 40, -1), *range(40, 100)]]
    zones = boards.supply_demand(bars_of(spark, c, h=[x + 1 for x in c], l=[x - 1 for x in c])).collect()
    demand = [z for z in zones if z.kind == "demand"]
    assert demand and all(z.lo < z.hi for z in zones)
    assert any(z.state == "untested" for z in demand)


def test_a_wave_breaks_zones(spark):
    c = [50 + 0.5 * i + 8 * math.sin(i / 3) for i in range(160)]
    zones = boards.supply_demand(bars_of(spark, c, h=[x + 1 for x in c], l=[x - 1 for x in c])).collect()
    assert any(z.state == "turncoat" for z in zones)


def test_pivot_must_be_the_only_extreme(spark):
    c = [float(x) for x in (1, 2, 3, 2, 1, 2, 3, 3, 2, 1, 0, 1, 2)]
    out = indicators.pivots(bars_of(spark, c), 2, 2).orderBy("dt").collect()
    assert [i for i, r in enumerate(out) if r.ph is not None] == [2]
    assert [i for i, r in enumerate(out) if r.pl is not None] == [4, 10]


def test_statistics_without_spread_are_zero(spark):
    rows = spark.createDataFrame([("A", 1.0, 2.0)] * 5, "k string, x double, y double")
    from tapeloom.functions.nulls import pearson

    r = rows.groupBy("k").agg(pearson("x", "y").alias("p"), stats.corrected_skew("x").alias("s"), stats.corrected_kurtosis("x").alias("u"), stats.herfindahl(F.col("x")).alias("h")).first()
    assert (r.p, r.s, r.u, round(r.h, 9)) == (0.0, 0.0, 0.0, 0.2)


def test_point_in_time_ignores_the_future(spark):
    rows = [("A", i, float((i * 7) % 11)) for i in range(40)]
    schema = "symbol string, dt int, x double"
    whole = stats.point_in_time(spark.createDataFrame(rows, schema), "x", 20, 5)
    cut = stats.point_in_time(spark.createDataFrame(rows[:25], schema), "x", 20, 5)
    assert cut.exceptAll(whole.filter("dt < 25")).count() == 0


def test_text_numbers_and_codes(spark):
    r = spark.range(1).select(calendar.whole(F.lit("50.0")).alias("a"), calendar.whole(F.lit("1,250")).alias("b"), calendar.broker_code(F.lit("D01")).alias("c"), calendar.whole(F.lit("x")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (50, 1250, 900001, None)


def test_cells_of_a_board(spark):
    f = lambda x: spark.range(1).select(calendar.shown(F.lit(x).cast("double")).alias("x")).first().x
    assert [f(x) for x in (None, float("nan"), 1e-15, 1.5, 1234567.0)] == ["", "", "0", "1.5", "1.23457e+06"]


def test_next_event_is_strictly_after(spark):
    d = lambda x: dt.date(2024, 1, x)
    rows = spark.createDataFrame([("A", d(1)), ("A", d(5)), ("B", d(1))], "symbol string, dt date")
    events = spark.createDataFrame([("A", d(5)), ("A", d(9))], "symbol string, dt date")
    out = {(r.symbol, r.dt.day): (r.e and r.e.day, r.days_to_e) for r in calendar.next_event(rows, events, "e").collect()}
    assert out == {("A", 1): (5, 4), ("A", 5): (9, 4), ("B", 1): (None, None)}


def test_tape_files_and_their_quality(spark, tmp_path):
    folder = tmp_path / "ABC"
    folder.mkdir()
    (folder / "2024-01-02.txt").write_bytes(b"buyer\tseller\tquantity\trate\tamount\ttransaction\r\n1\t2\t50.0\t10\t500\tt1\r\n3 4 1,250 2 2500 t2\nD01\t2\t5\t10\t90\tt3\n1\t2\t-5\t10\t50\tt4\n1\t2\tx\t10\t50\tt5\nshort row\n")
    t = files.tape_files(spark, str(tmp_path))
    kept = t.filter("kept").orderBy("contract").collect()
    assert [(r.symbol, str(r.dt), r.buyer, r.qty, r.amount) for r in kept] == [("ABC", "2024-01-02", 1, 50, 500.0), ("ABC", "2024-01-02", 3, 1250, 2500.0), ("ABC", "2024-01-02", 900001, 5, 50.0)]
    q = files.tape_quality(t).first()
    assert (q.total, q.kept, q.mismatches, q.repeated, q.dealer_rows, q.status) == (6, 3, 1, 0, 1, "WARNING")
    assert (q.unparsable, q.not_positive, q.unknown_brokers, q.repeated_rows) == (2, 1, 0, 0) and abs(q.score - (50 - 10 / 6)) < 1e-3


def test_rows_with_tabs_keep_their_blanks_and_repeats_are_counted(spark, tmp_path):
    folder = tmp_path / "XYZ"
    folder.mkdir()
    (folder / "2024-01-03.txt").write_text("1\t2\t1 000\t10\t10000\tt 1\n1\t2\t10\t10\t100.5\tt2\n1\t2\t10\t10\t101.5\tt2\n1\t2\t10\t10\t100\tt2\n?\t2\t10\t10\t100\tt5\n")
    t = files.tape_files(spark, str(tmp_path))
    q = files.tape_quality(t).first()
    assert (q.total, q.repeated, q.repeated_rows, q.mismatches, q.unknown_brokers) == (5, 2, 2, 1, 1)
    assert "t 1" in [r.contract for r in t.collect()]


def test_bar_files(spark, tmp_path):
    folder = tmp_path / "ABC"
    folder.mkdir()
    (folder / "1D.txt").write_text("date\topen\thigh\tlow\tclose\tchange\tpercent_change\tvolume\tamount\n2024-01-02\t1\t2\t1\t2\t\t\t1,000\t\n2024-01-03\t1\t2\t1\t\t\t\t5\t\n")
    r = files.bar_files(spark, str(tmp_path)).collect()
    assert [(x.symbol, x.c, x.v, x.amount) for x in r] == [("ABC", 2.0, 1000.0, None)]


def test_frames_and_column_arrays(spark):
    text = "X$2$25.1!ABC$10:00$1^2^3\nbad line\nX$2$25.1!DEF$10:01$4^^6"
    frame = "102^" + base64.b64encode(zlib.compress(text.encode())).decode()
    df = spark.createDataFrame([(frame,), ("nonsense",), (None,)], "f string").select(files.inflate("f").alias("t")).select(files.records(F.col("t")).alias("r"))
    got = [r.r for r in df.collect()]
    assert [(x.symbol, x.fields) for x in got[0]] == [("25.1!ABC", ["1", "2", "3"]), ("25.1!DEF", ["4", "", "6"])]
    bars = spark.range(1).select(files.column_arrays(F.lit('{"t":[1,2],"o":[1.0,2.0],"h":[1.0,2.0],"l":[1.0,2.0],"c":[1.5,2.5],"v":[3,4]}')).alias("b")).first().b
    assert [(b.t, b.c) for b in bars] == [(1, 1.5), (2, 2.5)]


def test_operable_instruments(spark):
    rows = [("ABC", "Stock", "Abc"), ("ABCP", "Stock", "Abc P"), ("XP", "Stock", "no base"), ("F1", "Mutual Fund", "f"), ("PR", "Stock", "Abc Promoter Share"), ("ABCD85", "Stock", "debenture"), ("N", None, None)]
    out = files.operable(spark.createDataFrame(rows, "symbol string, type string, name string"))
    assert sorted(r.symbol for r in out.collect()) == ["ABC", "N", "XP"]


def test_board_sink_refuses_what_looks_wrong(spark, tmp_path):
    path = f"file://{tmp_path}/board"
    board = lambda n, d="2024-01-01": spark.range(n).select(F.lit(d).alias("date"), F.col("id").alias("x"))
    files.write_board(board(10), path)
    files.write_board(board(6), path)
    assert spark.read.parquet(path).count() == 6 and spark.read.parquet(path).columns[-1] == "date"
    for bad in (board(2), board(8, None), spark.range(9)):
        with pytest.raises(files.RefusedWrite):
            files.write_board(bad, path)
    assert spark.read.parquet(path).count() == 6


def test_empty_bars_give_empty_results(spark):
    none = bars_of(spark, [1.0]).filter("false")
    for f in (series.adjusted, indicators.recursive, lambda b: indicators.structure_events(b, 2, 2), boards.first_passage, boards.supply_demand):
        assert f(none).count() == 0


def test_rings_of_four_from_edges_of_two_thousandths_of_the_volume(spark):
    """The reference's least share of an edge, 0.002 of the symbol's volume, for both lengths."""
    from collections import Counter, defaultdict

    from tapeloom.plans.catalogue import QUERIES
    from tapeloom.sources.tape import tape

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    volume, qty, rings = Counter(), Counter(), Counter()
    for r in tape(spark, sf).select("symbol", "buyer", "seller", "qty").collect():
        volume[r.symbol] += r.qty
        qty[r.symbol, r.buyer, r.seller] += r.qty
    nodes = defaultdict(lambda: defaultdict(dict))
    for (s, a, b), q in qty.items():
        if a != b and q >= 0.002 * volume[s]:
            nodes[s][a][b] = q
    for s, to in nodes.items():
        for a in list(to):
            for b, c, d in ((b, c, d) for b in to[a] if a < b for c in to[b] if a < c for d in to[c] if a < d and d != b):
                if a in to[d]:
                    rings[s, a, b, c, d, min(to[a][b], to[b][c], to[c][d], to[d][a])] += 1
    assert Counter(map(tuple, QUERIES["cycles4"](spark, sf).select("symbol", "a", "b", "c", "d", "least").collect())) == rings and rings


TRADES = "symbol string, dt date, buyer int, seller int, qty long, rate double, amt double"


def test_a_session_odd_only_in_self_trades_is_flagged(spark):
    """Volume, trades, buyers, sellers and the largest trade are the same in all sessions."""
    from tapeloom.operators import graph
    from tapeloom.sources.tape import broker_flow

    rows = []
    for i, m in enumerate([0, 2] * 5 + [0, 8]):
        rows += [("A", dt.date(2024, 1, 1) + dt.timedelta(i), b, b if b < m else m + (b + 1 - m) % (10 - m), 10, 5.0, 50.0) for b in range(10)]
    trades = spark.createDataFrame(rows, TRADES)
    out = {r.dt.day: r for r in graph.session_anomaly(trades, broker_flow(trades)).collect()}
    assert sorted(out) == [11, 12]
    assert (out[12].score, out[12].oddest, out[12].flagged, out[12].metrics, out[12].baseline_sessions) == (0.333333, "self_trade_pct", ["self_trade_pct"], 15, 11)


def test_six_kinds_of_repeats(spark):
    from tapeloom.operators import graph
    from tapeloom.sources.tape import broker_flow

    d = lambda x: dt.date(2024, 1, x)
    trades = spark.createDataFrame([("A", d(1), 1, 2, 10, 5.0, 50.0), ("A", d(2), 1, 2, 10, 5.0, 50.0), ("A", d(2), 3, 2, 100, 7.0, 700.0)], TRADES)
    out = sorted(((r.kind, r["rank"], r.a, r.b, r.n, r.share) for r in graph.repeated_patterns(trades, broker_flow(trades)).collect()))
    assert out == [
        ("accumulator", 1, 1, None, 2, 1.0), ("accumulator", 2, 3, None, 1, 0.5), ("distributor", 1, 2, None, 2, 1.0), ("large", 1, 3, None, 1, 1.0), ("pair", 1, 1, 2, 2, 1.0), ("pair", 2, 3, 2, 1, 0.5),
        ("price", 1, 5, None, 2, 0.666667), ("price", 2, 7, None, 1, 0.333333), ("price_volume", 1, 5, 10, 2, 0.666667),
    ]
