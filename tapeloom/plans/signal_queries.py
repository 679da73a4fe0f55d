"""Freshness and decay of flow signals, and streaks of buying."""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import signals as op
from ..sources.tape import FLOW_SQL, TAPE_SQL, broker_flow, tape
from .registry import query

#: The marks as lists of at most 120 sessions, which the oracles read by position.
MARKS_SQL = f"""{TAPE_SQL},
days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM (SELECT DISTINCT symbol, dt FROM tape)),
recent AS (SELECT tape.* FROM tape JOIN days USING (symbol, dt) WHERE back <= 120),
amounts AS (SELECT symbol, list(amt ORDER BY amt) AS a FROM recent GROUP BY symbol),
cuts AS (SELECT symbol, a[floor(0.9 * (len(a) - 1))::BIGINT + 1] + (a[ceil(0.9 * (len(a) - 1))::BIGINT + 1] - a[floor(0.9 * (len(a) - 1))::BIGINT + 1]) * (0.9 * (len(a) - 1) - floor(0.9 * (len(a) - 1))) AS large FROM amounts),
legs AS (SELECT symbol, dt, buyer AS broker, qty AS b, 0 AS s FROM recent UNION ALL SELECT symbol, dt, seller, 0, qty FROM recent),
who AS (SELECT symbol, dt, broker, sum(b) AS b, sum(s) AS s FROM legs GROUP BY ALL),
per AS (SELECT symbol, dt, sum(b) AS volume, (max(b - s) + min(b - s))::DOUBLE / sum(b) AS tilt, sum(((b + s)::DOUBLE) ** 2) / sum((b + s)::DOUBLE) ** 2 AS hhi, count(*) AS participants FROM who GROUP BY ALL),
big AS (SELECT symbol, dt, coalesce(sum(qty) FILTER (amt >= large), 0)::DOUBLE AS large_qty FROM recent JOIN cuts USING (symbol) GROUP BY ALL),
mk AS MATERIALIZED (
  SELECT symbol, dt, row_number() OVER w - 1 AS i, tilt, hhi, participants, large_qty / volume AS large_share, avg(tilt) OVER (w ROWS 2 PRECEDING) AS line, avg(tilt) OVER (w ROWS 14 PRECEDING) AS trend
  FROM per JOIN big USING (symbol, dt) WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
series AS (
  SELECT symbol, count(*) AS n, list(dt ORDER BY i) AS dts, list(line ORDER BY i) AS ln, list(CASE WHEN line > 0.001 THEN 1 WHEN line < -0.001 THEN -1 ELSE 0 END ORDER BY i) AS sides, list(trend ORDER BY i) AS tr,
         list(hhi ORDER BY i) AS hs, list(participants::DOUBLE ORDER BY i) AS ps, list(large_share ORDER BY i) AS ls FROM mk GROUP BY symbol),
posn AS (
  SELECT *, round_even(0.9 * (n - 1), 0)::BIGINT + 1 AS k,
         list_max(list_filter(range(1, n + 1), lambda j: sides[j] = 1)) AS pe, list_max(list_filter(range(1, n + 1), lambda j: sides[j] = -1)) AS ne,
         list_max(list_filter(range(2, n + 1), lambda j: tr[j] * tr[j - 1] < 0 AND abs(tr[j]) > 0.001 AND abs(tr[j - 1]) > 0.001)) AS re FROM series),
hit AS (
  SELECT *, coalesce(list_max(list_filter(range(1, pe + 1), lambda j: sides[j] <> 1)), 0) + 1 AS pb, coalesce(list_max(list_filter(range(1, ne + 1), lambda j: sides[j] <> -1)), 0) + 1 AS nb,
         list_max(list_filter(range(1, n + 1), lambda j: hs[j] > list_sort(hs)[k])) AS ce, list_max(list_filter(range(1, n + 1), lambda j: ps[j] > list_sort(ps)[k])) AS we, list_max(list_filter(range(1, n + 1), lambda j: ls[j] > list_sort(ls)[k])) AS le FROM posn),
ev AS (
  SELECT symbol, n, unnest([
    {{'event': 'accumulation start', 'p': CASE WHEN pe IS NOT NULL THEN pb END, 'level': ln[pb], 'active': pe = n, 'run': pe - pb + 1}}, {{'event': 'distribution start', 'p': CASE WHEN ne IS NOT NULL THEN nb END, 'level': ln[nb], 'active': ne = n, 'run': ne - nb + 1}},
    {{'event': 'flow reversal', 'p': re, 'level': tr[re], 'active': re = n, 'run': NULL}}, {{'event': 'concentration spike', 'p': ce, 'level': hs[ce], 'active': ce = n, 'run': NULL}},
    {{'event': 'participation expansion', 'p': we, 'level': ps[we], 'active': we = n, 'run': NULL}}, {{'event': 'large-trade emergence', 'p': le, 'level': ls[le], 'active': le = n, 'run': NULL}}]) AS e, dts FROM hit),
fresh AS (
  SELECT symbol, dts[n] AS dt, CASE WHEN pe IS NULL AND ne IS NULL THEN 'none' WHEN ne IS NULL OR (pe IS NOT NULL AND pb >= nb) THEN 'accumulation' ELSE 'distribution' END AS signal,
         n, pe, ne, pb, nb, re, ce, we, le, ln, CASE WHEN pe IS NULL AND ne IS NULL THEN NULL WHEN ne IS NULL OR (pe IS NOT NULL AND pb >= nb) THEN pb ELSE nb END AS o FROM hit)"""


@query("freshness_events", f"WITH {MARKS_SQL} SELECT symbol, e.event AS event, dts[e.p] AS dt, e.p - 1 AS idx, n - e.p AS age, micro(e.level) AS level, e.active AS active, e.run AS run FROM ev WHERE e.p IS NOT NULL")
def freshness_events(spark, sf_dir):
    return op.events(op.marks(tape(spark, sf_dir))).withColumn("level", micro(F.col("level")))


@query("freshness", f"""WITH {MARKS_SQL} SELECT symbol, dt, signal, n - o AS signal_age, CASE WHEN pe IS NOT NULL THEN n - pb END AS days_since_accumulation, CASE WHEN ne IS NOT NULL THEN n - nb END AS days_since_distribution, n - re AS days_since_flow_reversal,
  n - ce AS days_since_concentration_spike, n - we AS days_since_participation_expansion, n - le AS days_since_large_trade_emergence, coalesce(pe - pb + 1, 0) AS accumulation_run, coalesce(ne - nb + 1, 0) AS distribution_run,
  coalesce(pe = n, false) AS accumulation_active, coalesce(ne = n, false) AS distribution_active FROM fresh""")
def freshness(spark, sf_dir):
    return op.freshness(op.marks(tape(spark, sf_dir))).drop("origin")


@query("decay", f"""WITH {MARKS_SQL},
pts AS (SELECT symbol, n - o + 1 AS days, list_transform(ln[o:], lambda x: abs(x)) AS v FROM fresh WHERE o IS NOT NULL),
top AS (SELECT *, list_max(v) AS top, list_position(v, list_max(v)) AS pk FROM pts),
sc AS (SELECT *, CASE WHEN top > 0 THEN list_transform(v, lambda x: 100.0::DOUBLE * x / top) ELSE v END AS s FROM top),
tl AS (SELECT symbol, unnest(range(pk, days + 1)) AS j, s FROM sc WHERE top > 0),
fit AS (SELECT symbol, CASE WHEN count(*) FILTER (s[j] > 0) > 1 THEN regr_slope(ln(s[j]), j) FILTER (s[j] > 0) END AS slope, count(*) FILTER (s[j] >= 50) / count(*) AS persistence FROM tl GROUP BY symbol),
rec AS (SELECT symbol, max(s[j] - low) / 100 AS recovery FROM (SELECT *, min(s[j]) OVER (PARTITION BY symbol ORDER BY j) AS low FROM tl) GROUP BY symbol),
al AS (
  SELECT symbol, days, s[1] AS day1, CASE WHEN top > 0 THEN pk - 1 ELSE 0 END AS peak_day, s[-1] AS latest, coalesce(-slope, 0) AS rate, coalesce(persistence, 0) AS persistence, coalesce(recovery, 0) AS recovery,
         CASE WHEN days >= 6 AND top > 0 THEN list_avg(s[-3:]) - list_avg(s[-6:-4]) ELSE 0 END AS reacceleration, top FROM sc LEFT JOIN fit USING (symbol) LEFT JOIN rec USING (symbol))
SELECT symbol, days, peak_day, micro(day1) AS day1, micro(latest) AS latest, round(rate, 6) AS rate, round(CASE WHEN rate > 1e-9 THEN ln(2) / rate END, 4) AS half_life, round(persistence, 6) AS persistence, round(recovery, 6) AS recovery, round(reacceleration, 6) AS reacceleration,
  CASE WHEN top <= 0 THEN 'flat' WHEN reacceleration > 5 THEN 'reaccelerating' WHEN recovery > 0.25 THEN 'recovering' WHEN rate > 0.05 THEN 'decaying' WHEN persistence >= 0.5 THEN 'persistent' ELSE 'flat' END AS label FROM al""")
def decay(spark, sf_dir):
    m = op.marks(tape(spark, sf_dir))
    d = op.decay(op.signal_points(m, op.freshness(m)))
    return d.withColumns({"day1": micro(F.col("day1")), "latest": micro(F.col("latest")), "half_life": F.round("half_life", 4)} | {c: F.round(c, 6) for c in ("rate", "persistence", "recovery", "reacceleration")})


@query("streak_features", f"""WITH RECURSIVE {FLOW_SQL},
day AS (SELECT symbol, dt, sum(bought) AS volume, sum(bought) > 0 AND round(sum(buy_amt), 2) >= 500000 AS counts FROM flow GROUP BY ALL),
num AS MATERIALIZED (SELECT symbol, broker, dt, net, counts, row_number() OVER (PARTITION BY symbol, broker ORDER BY dt) AS k FROM flow JOIN day USING (symbol, dt)),
fold AS (
  SELECT symbol, broker, dt, k, net, 0::BIGINT AS before, CASE WHEN net > 0 AND counts THEN 1 ELSE 0 END::BIGINT AS streak FROM num WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.broker, n.dt, n.k, n.net, f.streak, CASE WHEN n.net <= 0 THEN 0 WHEN n.counts THEN f.streak + 1 ELSE f.streak END FROM fold f JOIN num n ON n.symbol = f.symbol AND n.broker = f.broker AND n.k = f.k + 1)
SELECT symbol, dt, micro(sum(CASE WHEN net > 0 AND before >= 3 THEN net ELSE 0 END) / any_value(volume)) AS persist_k, coalesce(max(before) FILTER (net > 0), 0) AS streak_max, micro(sum((bought::DOUBLE) ** 2) / any_value(volume)::DOUBLE ** 2) AS herfindahl,
  micro(max(net) / any_value(volume)) AS top_share, micro(count(*) FILTER (sold > 0) / greatest(count(*) FILTER (bought > 0), 1)) AS buyer_ratio
FROM flow JOIN day USING (symbol, dt) JOIN (SELECT symbol, broker, dt, before FROM fold) USING (symbol, broker, dt) WHERE counts GROUP BY symbol, dt""")
def streak_features(spark, sf_dir):
    s = op.streak_features(broker_flow(tape(spark, sf_dir)))
    return s.withColumns({c: micro(F.col(c)) for c in ("persist_k", "herfindahl", "top_share", "buyer_ratio")})
