"""Boards: screens a user reads as one table."""

from pyspark.sql import functions as F

from ..operators import boards as op
from ..sources.tape import FLOW_SQL, TAPE_SQL, bars, broker_flow, tape
from .bar_queries import adjusted_day_bars
from .indicator_queries import NUMBERED, TR, W, ema_sql, pivots_sql, wilder_sql
from .registry import query

AGED_TAPE = f"""{TAPE_SQL}, days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM tape)), aged AS (SELECT tape.*, age FROM tape JOIN days USING (symbol, dt))"""


@query("volume_spike_board", f"""WITH {FLOW_SQL}, bars AS (SELECT symbol, dt, max_by(rate, row(ok, ln, pk, sk, qty, amt)) AS c, sum(qty)::DOUBLE AS v FROM tape GROUP BY ALL),
b AS (SELECT symbol, dt, c, v, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars), x AS (SELECT b.*, w FROM b, (SELECT unnest([3, 10, 20]) AS w) WHERE age <= 60 + w),
a AS (SELECT symbol, w, avg(ln(1 + v)) FILTER (age <= w) AS m1, avg(ln(1 + v)) FILTER (age > w) AS m0, stddev_samp(ln(1 + v)) FILTER (age > w) AS sd, avg(v) FILTER (age <= w) AS mean_v, median(v) FILTER (age > w) AS median_v, max(c) FILTER (age = 1) AS c1, max(c) FILTER (age = w + 1) AS c0, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT symbol, w, (m1 - m0) / sd AS z, coalesce(mean_v / nullif(median_v, 0), 0) AS spike_ratio, 100 * (c1 / c0 - 1) AS pct FROM a WHERE n = 60 + w AND sd > 0), r AS (SELECT *, pct - median(pct) OVER (PARTITION BY w) AS rel FROM s),
win AS (SELECT symbol, w, broker, sum(bought)::BIGINT AS bought, sum(net)::BIGINT AS net FROM flow JOIN b USING (symbol, dt), (SELECT unnest([3, 10, 20]) AS w) WHERE age <= w GROUP BY ALL),
c AS (SELECT symbol, w, round(sum(greatest(net, 0)) / sum(bought), 6) AS net_churn, round(sum(bought::DOUBLE * bought) / (sum(bought)::DOUBLE * sum(bought)), 6) AS buy_hhi, max_by(broker, row(net, -broker)) AS top_buyer, max(net) AS buyer_net, min_by(broker, row(net, broker)) AS top_seller, min(net) AS seller_net FROM win GROUP BY ALL)
SELECT symbol, w, round(z, 6) AS z, round(spike_ratio, 6) AS spike_ratio, round(pct, 4) AS pct, round(rel, 4) AS rel, net_churn, buy_hhi, top_buyer, buyer_net, top_seller, seller_net,
  CASE WHEN abs(rel) <= CASE w WHEN 3 THEN 2 WHEN 10 THEN 3 ELSE 5 END THEN 'churn' WHEN rel > 0 THEN 'markup' ELSE 'markdown' END AS kind,
  concat_ws(',', CASE WHEN z >= CASE w WHEN 3 THEN 2.5 ELSE 2 END THEN 'SPIKE' END, CASE WHEN net_churn <= CASE w WHEN 3 THEN 0.36 WHEN 10 THEN 0.24 ELSE 0.18 END THEN 'CHURN' END, CASE WHEN buyer_net > 0 AND buyer_net >= -seller_net THEN 'BUY' WHEN seller_net < 0 THEN 'SELL' END) AS flags FROM r JOIN c USING (symbol, w)""")
def volume_spike_board(spark, sf_dir):
    t = tape(spark, sf_dir)
    return op.volume_spike(bars(t), broker_flow(t))


@query("operator_now", f"""WITH {AGED_TAPE}, legs AS (SELECT symbol, dt, age, buyer AS broker, seller AS other, qty AS x FROM aged WHERE age <= 20 AND buyer <> seller UNION ALL SELECT symbol, dt, age, seller, buyer, -qty FROM aged WHERE age <= 20 AND buyer <> seller),
net AS (SELECT symbol, w, broker, sum(x)::BIGINT AS net, sum(greatest(x, 0)) AS b FROM legs, (SELECT unnest([3, 7, 15, 20]) AS w) WHERE age <= w GROUP BY ALL),
per AS (SELECT symbol, w, sum(b) AS vol, max_by(broker, row(net, -broker)) AS bw, max(net) AS bn, min_by(broker, row(net, broker)) AS sw, min(net) AS sn FROM net GROUP BY ALL),
lead_ AS (SELECT symbol, w, 'BUY' AS side, bw AS who, 100 * abs(bn) / vol AS grip FROM per UNION ALL SELECT symbol, w, 'SELL', sw, 100 * abs(sn) / vol FROM per),
s AS (SELECT symbol, side, max(who) FILTER (w = 20) AS who, max(grip) FILTER (w = 20) AS grip, max(grip) FILTER (w = 3) - max(grip) FILTER (w = 20) AS tighten, count(DISTINCT who) AS persist FROM lead_ GROUP BY ALL),
d AS (SELECT symbol, broker, dt, sum(x) AS net FROM legs GROUP BY ALL),
reg AS (SELECT s.symbol, side, round(100 * count(*) FILTER (CASE WHEN side = 'BUY' THEN net > 0 ELSE net < 0 END) / count(*)) AS regular FROM s JOIN d ON d.symbol = s.symbol AND broker = who GROUP BY ALL),
oth AS (SELECT s.symbol, side, count(DISTINCT other) AS counterparties FROM s JOIN legs l ON l.symbol = s.symbol AND broker = who WHERE CASE WHEN side = 'BUY' THEN x > 0 ELSE x < 0 END GROUP BY ALL),
r AS (SELECT s.*, regular, counterparties FROM s JOIN reg USING (symbol, side) JOIN oth USING (symbol, side) WHERE counterparties >= 2)
SELECT symbol, side, who, round(grip, 6) AS grip, round(tighten, 6) AS tighten, persist, regular, counterparties,
  round(((grip - avg(grip) OVER p) / coalesce(nullif(stddev_pop(grip) OVER p, 0), 1) + 0.5 * (tighten - avg(tighten) OVER p) / coalesce(nullif(stddev_pop(tighten) OVER p, 0), 1) + CASE persist WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 ELSE 0 END) * (0.4 + 0.6 * regular / 100), 5) AS score FROM r WINDOW p AS (PARTITION BY side)""")
def operator_now(spark, sf_dir):
    return op.operator_now(tape(spark, sf_dir))


@query("operator_proof", f"""WITH {FLOW_SQL}, days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM flow)),
f AS (SELECT symbol, broker, sum(bought)::DOUBLE AS b, sum(net)::BIGINT AS net FROM flow JOIN days USING (symbol, dt) WHERE age <= 20 GROUP BY ALL),
g AS (SELECT *, sum(b) OVER (PARTITION BY symbol) AS vol, sum(b) OVER (PARTITION BY broker) - b AS rest, sum(b) OVER () AS market, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, broker) AS r FROM f),
h AS (SELECT *, market - vol AS rv, (b + rest) / market AS p FROM g WHERE r = 1), k AS (SELECT *, 100 * b / vol AS si, 100 * rest / rv AS so, round(coalesce((b / vol - rest / rv) / nullif(sqrt(p * (1 - p) * (1 / vol + 1 / rv)), 0), 0), 6) AS z FROM h), q AS (SELECT *, CASE WHEN so > 0.01 THEN si / so ELSE 999 END AS times FROM k)
SELECT symbol, broker AS who, round(si, 6) AS share_in, round(so, 6) AS share_out, round(times, 6) AS times, z, CASE WHEN abs(z) > 3.2905 AND times >= 2 THEN 'CONCENTRATED' WHEN abs(z) > 1.96 AND times >= 1.5 THEN 'elevated' ELSE 'just a big broker' END AS verdict FROM q""")
def operator_proof(spark, sf_dir):
    return op.operator_proof(broker_flow(tape(spark, sf_dir)))


@query("operator_verdict", f"""WITH {AGED_TAPE}, t AS (SELECT * FROM aged WHERE age <= 20), legs AS (SELECT symbol, dt, buyer AS broker, qty AS x FROM t WHERE buyer <> seller UNION ALL SELECT symbol, dt, seller, -qty FROM t WHERE buyer <> seller),
n AS (SELECT symbol, broker, sum(x)::BIGINT AS net FROM legs GROUP BY ALL), l AS (SELECT symbol, max_by(broker, row(net, -broker)) AS who, max(net) AS net FROM n GROUP BY symbol),
a AS (SELECT t.symbol, who, net, sum(qty) AS vol, coalesce(sum(qty) FILTER (buyer = who), 0) AS q, median(qty) FILTER (buyer = who) AS clip, median(qty) FILTER (buyer <> who) AS rest_clip, count(DISTINCT seller) FILTER (buyer = who) AS counterparties FROM t JOIN l ON l.symbol = t.symbol GROUP BY ALL),
d AS (SELECT legs.symbol, legs.dt, sum(x) AS d FROM legs JOIN l ON l.symbol = legs.symbol AND broker = who GROUP BY ALL), p AS (SELECT symbol, round(count(*) FILTER (d > 0) / count(*), 6) AS persist FROM d GROUP BY symbol),
r AS (SELECT *, round(100 * q / vol, 6) AS share_in FROM a JOIN p USING (symbol)), s AS (SELECT *, (share_in >= 20)::INT + coalesce((clip >= 1.5 * rest_clip)::INT, 0) + (persist >= 0.6)::INT + (counterparties >= 10)::INT AS passes FROM r)
SELECT symbol, who, net, share_in, clip, rest_clip, persist, counterparties, passes, CASE passes WHEN 4 THEN 'OPERATOR ENGAGED' WHEN 3 THEN 'LIKELY' ELSE 'NO' END AS verdict FROM s""")
def operator_verdict(spark, sf_dir):
    return op.operator_verdict(tape(spark, sf_dir))


ATR_SQL = f"{NUMBERED}, {TR}, {wilder_sql('a', 'tr', 14)}"


@query("scan_board", f"""WITH RECURSIVE {ATR_SQL}, x AS MATERIALIZED (SELECT symbol, i, c AS x FROM num), {ema_sql('e20', 'x', 20)}, g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS x FROM num WHERE i > 1), lo AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(pc - c, 0) AS x FROM num WHERE i > 1), {wilder_sql('ag', 'g', 14)}, {wilder_sql('al', 'lo', 14)}, {pivots_sql(5, 5)},
k AS (SELECT symbol, dt, c, lag(c) OVER w AS prev, last_value(ph IGNORE NULLS) OVER w AS last_high, last_value(pl IGNORE NULLS) OVER w AS last_low, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM piv WINDOW w AS ({W}))
SELECT k.symbol, dt, micro(c) AS c, round(100 * (c / prev - 1), 4) AS change_pct, CASE WHEN c >= e20.e THEN 'up' ELSE 'down' END AS trend, CASE WHEN ag.e + al.e > 0 THEN round(100 * ag.e / (ag.e + al.e), 4) END AS rsi14, micro(a.e) AS atr14,
  CASE WHEN c >= e20.e AND coalesce(c > last_high, false) THEN 'BUY' WHEN c < e20.e AND coalesce(c < last_low, false) THEN 'SELL' ELSE 'WATCH' END AS signal
FROM k JOIN e20 ON e20.symbol = k.symbol AND e20.i = k.i JOIN ag ON ag.symbol = k.symbol AND ag.i = k.i - 1 JOIN al ON al.symbol = k.symbol AND al.i = k.i - 1 JOIN a ON a.symbol = k.symbol AND a.i = k.i - 1 WHERE k.i = n""")
def scan_board(spark, sf_dir):
    return op.scan(adjusted_day_bars(spark, sf_dir))


SETUP_SQL = f"""WITH RECURSIVE {ATR_SQL.replace("symbol, dt, h, l, c,", "symbol, dt, h, l, c, v,")}, x AS MATERIALIZED (SELECT symbol, i, c AS x FROM num), {ema_sql('e20', 'x', 20)}, {ema_sql('e50', 'x', 50)}, {ema_sql('e12', 'x', 12)}, {ema_sql('e26', 'x', 26)},
mx AS MATERIALIZED (SELECT e26.symbol, e26.i - 25 AS i, e12.e - e26.e AS x FROM e12 JOIN e26 ON e12.symbol = e26.symbol AND e12.i = e26.i), {ema_sql('sg', 'mx', 9)}, g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS x FROM num WHERE i > 1), lo AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(pc - c, 0) AS x FROM num WHERE i > 1), {wilder_sql('ag', 'g', 14)}, {wilder_sql('al', 'lo', 14)},
pm AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS x FROM num WHERE i > 1), mm AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS x FROM num WHERE i > 1), {wilder_sql('wp', 'pm', 14)}, {wilder_sql('wm', 'mm', 14)},
dx AS MATERIALIZED (SELECT wp.symbol, wp.i - 13 AS i, CASE WHEN wp.e + wm.e > 0 THEN 100 * abs(wp.e - wm.e) / (wp.e + wm.e) ELSE 0 END AS x, wp.e > wm.e AS plus FROM wp JOIN wm ON wm.symbol = wp.symbol AND wm.i = wp.i), {wilder_sql('ax', 'dx', 14)},
y AS (SELECT num.symbol, num.dt, num.i, c, v, CASE WHEN count(*) OVER w50 = 50 THEN avg(c) OVER w50 END AS s50, max(h) OVER p20 AS top, avg(v) OVER p20 AS mv, e20.e AS e20, e50.e AS e50, mx.x AS macd, sg.e AS sig, mx.x - sg.e AS hist, 100 * ag.e / nullif(ag.e + al.e, 0) AS rsi, ax.e AS adx, dx.plus AS plus FROM num
  LEFT JOIN e20 ON e20.symbol = num.symbol AND e20.i = num.i LEFT JOIN e50 ON e50.symbol = num.symbol AND e50.i = num.i LEFT JOIN mx ON mx.symbol = num.symbol AND mx.i = num.i - 25 LEFT JOIN sg ON sg.symbol = num.symbol AND sg.i = num.i - 25 LEFT JOIN ag ON ag.symbol = num.symbol AND ag.i = num.i - 1
  LEFT JOIN al ON al.symbol = num.symbol AND al.i = num.i - 1 LEFT JOIN ax ON ax.symbol = num.symbol AND ax.i = num.i - 14 LEFT JOIN dx ON dx.symbol = num.symbol AND dx.i = num.i - 14
  WINDOW w50 AS (PARTITION BY num.symbol ORDER BY num.dt ROWS 49 PRECEDING), p20 AS (PARTITION BY num.symbol ORDER BY num.dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, lag(hist) OVER ({W}) AS prev_hist FROM y),
q AS (SELECT symbol, dt, (CASE WHEN c > s50 THEN 10 ELSE 0 END + CASE WHEN round(e50, 6) > round(s50, 6) THEN 10 ELSE 0 END + CASE WHEN e20 > e50 THEN 10 ELSE 0 END + CASE WHEN rsi > 50 THEN 10 ELSE 0 END + CASE WHEN macd > sig THEN 10 ELSE 0 END + CASE WHEN hist > prev_hist THEN 5 ELSE 0 END + CASE WHEN adx > 25 THEN 10 ELSE 0 END
  + CASE WHEN plus THEN 10 ELSE 0 END + CASE WHEN v > 1.5 * mv THEN 10 ELSE 0 END + CASE WHEN v > 2 * mv THEN 5 ELSE 0 END + CASE WHEN c > top THEN 10 ELSE 0 END)::INT AS score FROM z WHERE s50 IS NOT NULL AND adx IS NOT NULL AND sig IS NOT NULL)
SELECT symbol, dt, score, CASE WHEN score >= 90 THEN 'STRONG BUY' WHEN score >= 80 THEN 'BUY' WHEN score >= 60 THEN 'WATCH' ELSE 'AVOID' END AS label FROM q"""


@query("trade_setup_score", SETUP_SQL)
def trade_setup_score(spark, sf_dir):
    return op.setup_score(adjusted_day_bars(spark, sf_dir))


@query("position_sizing", f"""WITH {TAPE_SQL}, b AS (SELECT symbol, dt, max_by(rate, row(ok, ln, pk, sk, qty, amt)) AS c, min(rate) AS l FROM tape GROUP BY ALL), p AS (SELECT *, min(l) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS stop FROM b)
SELECT symbol, dt, CASE WHEN c - stop > 0 AND c > 0 THEN greatest(least(floor(1000000.0::DOUBLE / (c - stop)), floor(100000000.0::DOUBLE / c)), 0)::BIGINT ELSE 0 END AS shares FROM p""")
def position_sizing(spark, sf_dir):
    from ..operators.series import by_symbol

    b = bars(tape(spark, sf_dir)).withColumn("stop", F.min("l").over(by_symbol().rowsBetween(-10, -1)))
    return b.select("symbol", "dt", op.position_size(100_000_000.0, 1_000_000.0, F.col("c"), F.col("stop")).cast("long").alias("shares"))


@query("supply_demand_zones", f"""WITH RECURSIVE {ATR_SQL.replace('symbol, dt, h, l, c,', 'symbol, dt, o, h, l, c,')}, {pivots_sql(3, 3)}, k AS MATERIALIZED (SELECT piv.symbol, num.i, piv.o, piv.h, piv.l, piv.c, piv.ph, piv.pl, a.e AS atr FROM (SELECT symbol, dt, o, h, l, c, ph, pl FROM piv) piv JOIN num ON num.symbol = piv.symbol AND num.dt = piv.dt LEFT JOIN a ON a.symbol = num.symbol AND a.i = num.i - 1),
z AS (SELECT symbol, i AS at_, 'supply' AS kind, least(greatest(o, c), h - 0.75 * atr) AS lo, h AS hi FROM k WHERE atr IS NOT NULL AND ph IS NOT NULL UNION ALL SELECT symbol, i, 'demand', l, greatest(least(o, c), l + 0.75 * atr) FROM k WHERE atr IS NOT NULL AND pl IS NOT NULL),
m AS (SELECT z.*, k.i, k.h >= lo AND k.l <= hi AS hit, CASE WHEN kind = 'supply' THEN k.c > hi ELSE k.c < lo END AS broken FROM z JOIN k ON k.symbol = z.symbol AND k.i > at_),
n AS (SELECT *, bool_or(broken) OVER w AS dead, coalesce(bool_or(NOT hit) OVER (PARTITION BY symbol, kind, at_ ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone, coalesce(lag(hit) OVER w, false) AS was FROM m WINDOW w AS (PARTITION BY symbol, kind, at_ ORDER BY i)),
s AS (SELECT symbol, kind, at_, lo, hi, bool_or(broken) AS b, count(*) FILTER (NOT dead AND gone AND hit AND NOT was) AS visits FROM n GROUP BY ALL)
SELECT symbol, kind, at_::INT AS bar, micro(lo) AS lo, micro(hi) AS hi, visits, CASE WHEN b THEN 'turncoat' WHEN visits = 0 THEN 'untested' WHEN visits = 1 THEN 'strong' ELSE 'weak' END AS state FROM s""")
def supply_demand_zones(spark, sf_dir):
    return op.supply_demand(adjusted_day_bars(spark, sf_dir))


@query("first_passage", f"""WITH {NUMBERED}, p AS (SELECT a.symbol, a.i, a.c, min(b.i - a.i) FILTER (b.h >= a.c * 1.05) AS u, min(b.i - a.i) FILTER (b.l <= a.c * 0.95) AS d, max(b.c) FILTER (b.i = a.i + 20) AS e, count(*) AS n FROM num a JOIN num b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 20 GROUP BY ALL),
o AS (SELECT *, CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN coalesce(u, 99) < coalesce(d, 99) THEN 'up' ELSE 'down' END AS r FROM p WHERE n = 20)
SELECT symbol, count(*) AS n, round(avg((r = 'up')::INT), 6) AS p_up, round(avg((r = 'down')::INT), 6) AS p_down, round(avg((r = 'none')::INT), 6) AS p_none, count(*) FILTER (u = d) AS ambiguous,
  round(avg((r = 'up')::INT) * 5 - avg((r = 'down')::INT) * 5 + avg((r = 'none')::INT) * coalesce(avg(100 * (e / c - 1)) FILTER (r = 'none'), 0) - 0.8, 6) AS net_edge FROM o GROUP BY symbol""")
def first_passage(spark, sf_dir):
    return op.first_passage(adjusted_day_bars(spark, sf_dir))
