"""Streaming queries run to their end; the oracle is the same over all events at once."""

from ..sources.tape import TICKS_SQL
from ..streaming import ticks as st
from .registry import query


@query("stream_minute_bars", f"WITH {TICKS_SQL} SELECT instrument, date_trunc('minute', ts) AS minute, min_by(price, seq) AS o, max(price) AS h, min(price) AS l, max_by(price, seq) AS c, count(*) AS n FROM ticks GROUP BY ALL")
def stream_minute_bars(spark, sf_dir):
    return st.snapshot(spark, st.minute_bars(st.tick_stream(spark, sf_dir)), "minute-bars")


@query("stream_last_quote", f"WITH {TICKS_SQL} SELECT instrument, max(ts) FILTER (seq = m) AS ts, max(price) FILTER (seq = m) AS price, max(event_type) FILTER (seq = m) AS event_type, count(*) AS n FROM (SELECT *, max(seq) OVER (PARTITION BY instrument) AS m FROM ticks) GROUP BY instrument")
def stream_last_quote(spark, sf_dir):
    return st.snapshot(spark, st.last_quotes(st.tick_stream(spark, sf_dir)), "last-quote")


@query("stream_merged_fields", f"WITH {TICKS_SQL} SELECT instrument, event_type AS field, max(seq) AS seq, max_by(price, seq) AS price FROM ticks GROUP BY ALL")
def stream_merged_fields(spark, sf_dir):
    return st.upserted(spark, st.merged_fields(st.tick_stream(spark, sf_dir)), "merged-fields", ["instrument", "field"], "seq")
