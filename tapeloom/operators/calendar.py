"""Trading calendars, text and record decoding, and gates between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading weekdays (Monday is 0) and the session's bounds in minutes of the day.
OPEN_DAYS = (0, 1, 2, 3, 4)
PRE_OPEN, PRE_CLOSE, OPEN, CLOSE = 630, 645, 660, 900


def is_trading_day(dt: Column, days: tuple[int, ...] = OPEN_DAYS) -> Column:
    return F.weekday(dt).isin(*days)


def session_state(ts: Column) -> Column:
    """PRE-OPEN, PRE-OPEN CLOSE, LIVE or CLOSED."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return F.when(~is_trading_day(ts), "CLOSED").when((m >= PRE_OPEN) & (m < PRE_CLOSE), "PRE-OPEN").when((m >= PRE_CLOSE) & (m < OPEN), "PRE-OPEN CLOSE").when((m >= OPEN) & (m < CLOSE), "LIVE").otherwise("CLOSED")


def missed_sessions(last: Column, today: Column) -> Column:
    """Trading days after `last` up to `today`."""
    days = F.when(last < today, F.sequence(F.date_add(last, 1), today)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: is_trading_day(d)))


def number(text: Column) -> Column:
    """A number from text with commas and blanks; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def whole(text: Column) -> Column:
    """Whole numbers also when they are written with decimals, like 50.0."""
    return number(text).try_cast("bigint")


def broker_code(text: Column) -> Column:
    """Codes of dealers, D and digits, follow 900,000; others are numbers."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike("^D[0-9]+$"), 900000 + F.regexp_extract(t, "[0-9]+", 0).try_cast("bigint")).otherwise(whole(t))


def key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def shown(x: Column) -> Column:
    """A board's cell: empty for null and NaN, 0 for what is nearly 0, else six digits."""
    v = x.cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", v), r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(v.isNull() | F.isnan(v), "").when(F.abs(v) < 1e-12, "0").otherwise(short)


def html_cells(pages: DataFrame, tag: str) -> DataFrame:
    """The text of every element with this tag, in order, tags inside stripped."""
    found = F.regexp_extract_all("html", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", ""), "&nbsp;", " "), r"[\s]+", " "))
    return pages.select("page_id", F.posexplode(F.transform(found, text)).alias("pos", "text"))


def next_event(rows: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """As-of join forward: each row's first event strictly after its date, and the days until then.

    Both sides meet in one window over their union, so a symbol's rows and events are sorted once and never paired.
    """
    u = rows.withColumns({"_e": F.lit(None).cast("date"), "_k": F.lit(1)}).unionByName(events.select("symbol", "dt").withColumns({"_e": F.col("dt"), "_k": F.lit(0)}), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("dt", "_k").rowsBetween(1, Window.unboundedFollowing)
    return u.withColumn(name, F.first("_e", ignorenulls=True).over(w)).filter("_k = 1").drop("_e", "_k").withColumn(f"days_to_{name}", F.date_diff(F.col(name), F.col("dt")))


def blackout(rows: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of symbols without an event from `before` days before to `after` days after the row.

    Events are spread over the days that they black out, so the gate is an equi-join and not a range join.
    """
    days = events.select("symbol", F.explode(F.sequence(F.date_sub("dt", after), F.date_add("dt", before))).alias("dt")).distinct()
    return rows.join(days, ["symbol", "dt"], "left_anti")
