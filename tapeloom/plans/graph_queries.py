"""The broker network: rosters, rotation, pairs, rings, sequences."""

from pyspark.sql import functions as F

from ..operators import graph as op
from ..sources.tape import FLOW_SQL, ORDER, TAPE_SQL, broker_flow, tape
from .registry import query

AGED = f"""{FLOW_SQL}, days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM flow)), aged AS (SELECT flow.*, age FROM flow JOIN days USING (symbol, dt))"""
EDGES = f"""{TAPE_SQL}, e00 AS (SELECT symbol, buyer AS src, seller AS dst, sum(qty)::BIGINT AS qty FROM tape GROUP BY ALL), e0 AS (SELECT *, sum(qty) OVER (PARTITION BY symbol) AS total FROM e00), e AS (SELECT * FROM e0 WHERE src <> dst AND qty >= 0.002 * total)"""


def flow(spark, sf_dir):
    return broker_flow(tape(spark, sf_dir))


@query("participation", f"""WITH {AGED}, p AS (SELECT symbol, broker, bool_or(bought > 0) AS b, bool_or(sold > 0) AS s, bool_or(age <= 15) AS late, bool_or(age > 15) AS early, count(*) AS days FROM aged WHERE age <= 30 GROUP BY ALL)
SELECT symbol, count(*) AS brokers, count(*) FILTER (b) AS buyers, count(*) FILTER (s) AS sellers, count(*) FILTER (b AND s) AS both, count(*) FILTER (late AND NOT early) AS expanding, count(*) FILTER (early AND NOT late) AS contracting,
  round((count(*) FILTER (late) - count(*) FILTER (early)) / count(*) FILTER (early), 6) AS growth, round(avg(days), 6) AS mean_days FROM p GROUP BY symbol""")
def participation(spark, sf_dir):
    return op.participation(flow(spark, sf_dir))


@query("churn", f"""WITH {AGED}, p AS (SELECT symbol, broker, bool_or(age <= 2) AS n, bool_or(age > 2 AND age <= 4) AS p, bool_or(age > 4) AS o FROM aged GROUP BY ALL)
SELECT symbol, count(*) FILTER (n AND NOT p AND NOT o) AS "new", count(*) FILTER (n AND NOT p AND o) AS returning, count(*) FILTER (n AND p) AS continuing, count(*) FILTER (NOT n AND p) AS exiting FROM p GROUP BY symbol""")
def churn(spark, sf_dir):
    return op.churn(flow(spark, sf_dir), 2)


@query("rotation", f"""WITH {AGED}, g AS (SELECT symbol, age <= 4 AS now, broker, sum(bought + sold)::BIGINT AS gross FROM aged WHERE age <= 8 GROUP BY ALL),
r AS (SELECT *, gross / sum(gross) OVER (PARTITION BY symbol, now) AS share, row_number() OVER (PARTITION BY symbol, now ORDER BY gross DESC, broker) AS rank FROM g),
b AS (SELECT symbol, broker, max(share) FILTER (now) AS s1, max(share) FILTER (NOT now) AS s0, max(rank) FILTER (now) AS r1, max(rank) FILTER (NOT now) AS r0 FROM r GROUP BY ALL), d AS (SELECT *, coalesce(s1, 0) - coalesce(s0, 0) AS gain FROM b)
SELECT symbol, round(1 - count(*) FILTER (s1 IS NOT NULL AND s0 IS NOT NULL) / count(*), 6) AS jaccard_distance, count(*) FILTER (gain > 1e-12) AS share_up, count(*) FILTER (gain < -1e-12) AS share_down, round(sum(greatest(gain, 0)), 6) AS share_moved,
  round(avg(abs(r1 - r0)), 6) AS mean_rank_move, max_by(broker, row(coalesce(s1, 0), -broker)) AS dominant FROM d GROUP BY symbol""")
def rotation(spark, sf_dir):
    return op.rotation(flow(spark, sf_dir), 4)


@query("rank_stability", f"""WITH {AGED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY bought + sold DESC, broker) AS rank FROM aged WHERE age <= 30),
d AS (SELECT symbol, dt, max(broker) FILTER (rank = 1) AS leader, list(broker) FILTER (rank <= 5) AS top FROM r GROUP BY ALL), l AS (SELECT *, lag(leader) OVER w AS was, lag(top) OVER w AS top_was FROM d WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
m AS (SELECT symbol, max_by(leader, row(n, -leader)) AS modal_leader, max(n) AS led FROM (SELECT symbol, leader, count(*) AS n FROM d GROUP BY ALL) GROUP BY symbol)
SELECT symbol, count(*) FILTER (leader <> was) AS flips, count(*) AS days, round(avg(len(list_intersect(top, top_was)) / 5) FILTER (top_was IS NOT NULL), 6) AS top5_kept, any_value(modal_leader) AS modal_leader, any_value(led) AS led FROM l JOIN m USING (symbol) GROUP BY symbol""")
def rank_stability(spark, sf_dir):
    return op.rank_stability(flow(spark, sf_dir))


@query("pair_stats", f"""WITH {TAPE_SQL}, p AS (SELECT symbol, buyer, seller, count(*) AS trades, sum(qty)::BIGINT AS qty, round(sum(amt), 2) AS amt, count(DISTINCT dt) AS days, max(qty) AS largest, min(dt) AS first, max(dt) AS last FROM tape GROUP BY ALL),
a AS (SELECT symbol, broker, count(DISTINCT dt) AS n FROM (SELECT symbol, dt, buyer AS broker FROM tape UNION ALL SELECT symbol, dt, seller FROM tape) GROUP BY ALL)
SELECT p.*, round(days / least(x.n, y.n), 6) AS recurrence, round(qty / sum(qty) OVER (PARTITION BY p.symbol), 8) AS share FROM p JOIN a x ON x.symbol = p.symbol AND x.broker = buyer JOIN a y ON y.symbol = p.symbol AND y.broker = seller""")
def pair_stats(spark, sf_dir):
    return op.pairs(tape(spark, sf_dir))


@query("network_metrics", f"""WITH {EDGES}, u AS (SELECT DISTINCT symbol, least(src, dst) AS a, greatest(src, dst) AS b FROM e), d AS (SELECT symbol, node, count(*) AS k FROM (SELECT symbol, a AS node FROM u UNION ALL SELECT symbol, b FROM u) GROUP BY ALL),
t AS (SELECT x.symbol, x.a, x.b, y.b AS c FROM u x JOIN u y ON y.symbol = x.symbol AND y.a = x.b JOIN u z ON z.symbol = x.symbol AND z.a = x.a AND z.b = y.b),
tn AS (SELECT symbol, node, count(*) AS t FROM (SELECT symbol, a AS node FROM t UNION ALL SELECT symbol, b FROM t UNION ALL SELECT symbol, c FROM t) GROUP BY ALL),
n AS (SELECT d.symbol, count(*) AS nodes, round(avg(k), 6) AS mean_degree, round(avg(CASE WHEN k < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (k * (k - 1)) END), 6) AS clustering, max_by(d.node, row(k, -d.node)) AS busiest FROM d LEFT JOIN tn ON tn.symbol = d.symbol AND tn.node = d.node GROUP BY d.symbol),
c AS (SELECT symbol, count(*) AS edges FROM e GROUP BY symbol), v AS (SELECT symbol, count(*) AS undirected FROM u GROUP BY symbol)
SELECT n.*, edges, undirected, round(edges / (nodes * (nodes - 1)), 6) AS density FROM n JOIN c USING (symbol) JOIN v USING (symbol)""")
def network_metrics(spark, sf_dir):
    return op.network(op.edges(tape(spark, sf_dir), 0.002))


@query("cycles3", f"""WITH {EDGES} SELECT x.symbol, x.src AS a, x.dst AS b, y.dst AS c, least(x.qty, y.qty, z.qty) AS least, x.qty + y.qty + z.qty AS qty
FROM e x JOIN e y ON y.symbol = x.symbol AND y.src = x.dst JOIN e z ON z.symbol = x.symbol AND z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst""")
def cycles3(spark, sf_dir):
    return op.cycles3(op.edges(tape(spark, sf_dir), 0.002))


@query("cycles4", f"""WITH {EDGES} SELECT x.symbol, x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d, least(x.qty, y.qty, z.qty, v.qty) AS least
FROM e x JOIN e y ON y.symbol = x.symbol AND y.src = x.dst JOIN e z ON z.symbol = x.symbol AND z.src = y.dst JOIN e v ON v.symbol = x.symbol AND v.src = z.dst AND v.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.src < z.dst AND x.dst <> z.dst""")
def cycles4(spark, sf_dir):
    return op.cycles4(op.edges(tape(spark, sf_dir), 0.002))


@query("sequence_stats", f"""WITH {TAPE_SQL}, t AS (SELECT *, row_number() OVER w AS i, lag(buyer) OVER w AS pb, lag(seller) OVER w AS ps, lag(rate) OVER w AS pr, count(*) OVER (PARTITION BY symbol) AS n FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY dt, ok, ln, pk, sk, qty, amt)),
r AS (SELECT *, sum(CASE WHEN buyer = pb THEN 0 ELSE 1 END) OVER w AS rb, sum(CASE WHEN seller = ps THEN 0 ELSE 1 END) OVER w AS rs FROM t WINDOW w AS (PARTITION BY symbol ORDER BY i)),
x AS (SELECT symbol, max(n) AS longest_buyer_run FROM (SELECT symbol, rb, count(*) AS n FROM r GROUP BY ALL) GROUP BY symbol), y AS (SELECT symbol, max(n) AS longest_seller_run FROM (SELECT symbol, rs, count(*) AS n FROM r GROUP BY ALL) GROUP BY symbol)
SELECT symbol, count(*) AS n, count(*) FILTER (buyer = pb) AS buyer_repeats, count(*) FILTER (seller = ps) AS seller_repeats, count(*) FILTER (rate > pr) AS up, count(*) FILTER (rate < pr) AS down, count(*) FILTER (rate = pr) AS flat,
  round(avg(qty) FILTER (i * 2 <= n), 6) AS early_qty, round(avg(qty) FILTER (i * 2 > n), 6) AS late_qty, any_value(longest_buyer_run) AS longest_buyer_run, any_value(longest_seller_run) AS longest_seller_run FROM r JOIN x USING (symbol) JOIN y USING (symbol) GROUP BY symbol""")
def sequence_stats(spark, sf_dir):
    return op.sequence(tape(spark, sf_dir), ORDER)


@query("affinity", f"""WITH {FLOW_SQL}, p AS (SELECT symbol, broker, sum(bought + sold)::BIGINT AS gross FROM flow GROUP BY ALL), a AS (SELECT *, gross / sum(gross) OVER (PARTITION BY broker) AS affinity FROM p)
SELECT symbol, broker, gross, round(affinity, 8) AS affinity, row_number() OVER (PARTITION BY broker ORDER BY affinity DESC, symbol)::INT AS rank, round((rank() OVER (PARTITION BY symbol ORDER BY affinity) - 1) / count(*) OVER (PARTITION BY symbol), 6) AS percentile FROM a""")
def affinity(spark, sf_dir):
    return op.affinity(flow(spark, sf_dir))


@query("repeats", f"""WITH {TAPE_SQL}, k AS (SELECT symbol, 'pair' AS kind, buyer || '>' || seller AS key FROM tape UNION ALL SELECT symbol, 'quantity', qty::VARCHAR FROM tape UNION ALL SELECT symbol, 'combination', buyer || ':' || qty FROM tape),
c AS (SELECT symbol, kind, key, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY n DESC, key)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 5""")
def repeats(spark, sf_dir):
    return op.repeats(tape(spark, sf_dir))


@query("anomaly", f"""WITH {TAPE_SQL}, s AS (SELECT symbol, dt, sum(qty)::DOUBLE AS volume, count(*)::DOUBLE AS trades, count(DISTINCT buyer)::DOUBLE AS buyers, count(DISTINCT seller)::DOUBLE AS sellers, max(qty)::DOUBLE AS largest FROM tape GROUP BY ALL),
l AS (UNPIVOT s ON volume, trades, buyers, sellers, largest INTO NAME metric VALUE x), z AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd FROM l WINDOW w AS (PARTITION BY symbol, metric ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN sd < 1e-9 THEN 0 ELSE least(abs((x - mean) / sd), 5) END AS part FROM z WHERE n >= 20) SELECT symbol, dt, round(avg(part), 6) AS score, max_by(metric, row(round(part, 6), metric)) AS oddest FROM p GROUP BY ALL""")
def anomaly(spark, sf_dir):
    s = tape(spark, sf_dir).groupBy("symbol", "dt").agg(F.sum("qty").alias("volume"), F.count("*").alias("trades"), F.count_distinct("buyer").alias("buyers"), F.count_distinct("seller").alias("sellers"), F.max("qty").alias("largest"))
    return op.anomaly(s, ["volume", "trades", "buyers", "sellers", "largest"])


@query("session_anomaly", f"""WITH {FLOW_SQL}, a AS (SELECT symbol, dt, count(*) AS trades, sum(qty)::DOUBLE AS volume, sum(amt) AS turnover, sum(CASE WHEN buyer = seller THEN qty ELSE 0 END)::DOUBLE AS self FROM tape GROUP BY ALL),
b AS (SELECT symbol, dt, count(*) AS brokers, sum((bought + sold)::DOUBLE * (bought + sold)) AS gg, sum(bought::DOUBLE * bought) AS bb, sum(sold::DOUBLE * sold) AS ss, sum(greatest(net, 0))::DOUBLE AS pos FROM flow GROUP BY ALL),
p AS (SELECT symbol, dt, sum(q * q) AS pp, max(q) AS top FROM (SELECT symbol, dt, buyer, seller, sum(qty)::DOUBLE AS q FROM tape GROUP BY ALL) GROUP BY ALL), r AS (SELECT symbol, dt, max(c) AS modal FROM (SELECT symbol, dt, rate, count(*) AS c FROM tape GROUP BY ALL) GROUP BY ALL),
m AS (SELECT symbol, dt, volume / trades AS trade_size, volume, turnover, gg / (2 * volume) ** 2 AS broker_concentration, bb / volume ** 2 AS buyer_concentration, ss / volume ** 2 AS seller_concentration, pp / volume ** 2 AS pair_concentration, pos / volume AS flow_quality, modal / trades AS price_concentration,
  trades::DOUBLE AS trade_frequency, brokers::DOUBLE AS participation, trades / brokers AS fragmentation, self / volume AS self_trade_pct, top / volume AS top_pair_share FROM a JOIN b USING (symbol, dt) JOIN p USING (symbol, dt) JOIN r USING (symbol, dt)),
l AS (UNPIVOT m ON COLUMNS(* EXCLUDE (symbol, dt)) INTO NAME metric VALUE x), z AS (SELECT symbol, dt, metric, x, count(x) OVER w AS n, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd FROM l WINDOW w AS (PARTITION BY symbol, metric ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g0 AS (SELECT a.symbol, a.dt, k.broker, coalesce(net, 0) AS net, coalesce(net, 0) / volume AS x FROM a JOIN (SELECT DISTINCT symbol, broker FROM flow) k ON k.symbol = a.symbol LEFT JOIN flow ON flow.symbol = a.symbol AND flow.dt = a.dt AND flow.broker = k.broker),
g AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd, sum(net) OVER w AS base FROM g0 WINDOW w AS (PARTITION BY symbol, broker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT * FROM z WHERE n >= 10 UNION ALL SELECT symbol, dt, 'dominant_flow', x, n, mean, sd FROM g WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY symbol, dt ORDER BY abs(base) DESC, broker) = 1), q AS (SELECT *, CASE WHEN sd < 1e-9 THEN 0 ELSE abs((x - mean) / sd) END AS z FROM y)
SELECT symbol, dt, round(avg(least(z, 5)), 6) AS score, max_by(metric, row(round(least(z, 5), 6), metric)) AS oddest, coalesce(list_sort(list(metric) FILTER (round(z, 6) >= 2)), []) AS flagged, count(*) AS metrics, max(n) AS baseline_sessions FROM q GROUP BY symbol, dt""")
def session_anomaly(spark, sf_dir):
    return op.session_anomaly(tape(spark, sf_dir), flow(spark, sf_dir))


@query("repeated_patterns", f"""WITH {FLOW_SQL}, t AS (SELECT symbol, count(*) AS trades, count(DISTINCT dt) AS sessions FROM tape GROUP BY symbol), o AS (SELECT symbol, qty, buyer, row_number() OVER (PARTITION BY symbol ORDER BY qty) - 1 AS i FROM tape),
c AS (SELECT o.symbol, qty AS cut FROM o JOIN t USING (symbol) WHERE i = least(trades - 1, floor(trades * 0.99::DOUBLE))), k AS (SELECT symbol, 'pair' AS kind, buyer::DOUBLE AS a, seller::DOUBLE AS b, count(DISTINCT dt) AS n, sum(qty)::BIGINT AS more FROM tape GROUP BY ALL
UNION ALL SELECT symbol, 'price', rate, NULL, count(*), 0 FROM tape GROUP BY ALL UNION ALL SELECT symbol, 'price_volume', rate, qty, count(*), 0 FROM tape GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT symbol, 'accumulator', broker, NULL, count(*), 0 FROM flow WHERE net > 0 GROUP BY ALL
UNION ALL SELECT symbol, 'distributor', broker, NULL, count(*), 0 FROM flow WHERE net < 0 GROUP BY ALL UNION ALL SELECT o.symbol, 'large', buyer, NULL, count(*), 0 FROM o JOIN c USING (symbol) WHERE qty >= cut GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY n DESC, more DESC, a, b)::INT AS rank, sum(n) OVER (PARTITION BY symbol, kind) AS all_n FROM k)
SELECT symbol, kind, a, b, n, round(n / CASE WHEN kind IN ('pair', 'accumulator', 'distributor') THEN sessions WHEN kind = 'large' THEN all_n ELSE trades END, 6) AS share, rank FROM r JOIN t USING (symbol) WHERE rank <= 3""")
def repeated_patterns(spark, sf_dir):
    return op.repeated_patterns(tape(spark, sf_dir), flow(spark, sf_dir))
