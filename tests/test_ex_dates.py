"""What reads prices over time reads adjusted bars: a market of one symbol, whose price halves twice."""

from datetime import date, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.nulls import places
from tapeloom.operators.series import exponential
from tapeloom.plans.catalogue import ORACLES, QUERIES

WEEKS, SPLITS = 220, (90, 170)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("split")
    price, rows = 400.0, []
    for week in range(WEEKS):
        price = price * (0.5 if week in SPLITS else 1 + ((week * 37) % 11 - 4) / 150)
        for n, part in enumerate((1.0, 1.01, 0.99)):
            rows.append((len(rows) + 1, 1, 1, 1, float(1 + (week * 7 + n) % 5), price * part, date(1998, 1, 5) + timedelta(7 * week + n)))
    line = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"])
    line["l_extendedprice"] *= line["l_quantity"]
    line["l_shipdate"] = pd.to_datetime(line["l_shipdate"]).astype("datetime64[us]")
    tables = {
        "lineitem": line,
        "part": pd.DataFrame({"p_partkey": [1], "p_brand": ["Brand#1"], "p_size": [10]}),
        "supplier": pd.DataFrame({"s_suppkey": [1], "s_nationkey": [1]}),
        "orders": pd.DataFrame({"o_orderkey": line["l_orderkey"], "o_custkey": 1}),
        "customer": pd.DataFrame({"c_custkey": [1], "c_nationkey": [2]}),
    }
    for name, table in tables.items():
        table.to_parquet(at / f"{name}.parquet")
    return at


@pytest.mark.parametrize("name", ["trigger_edges", "event_replay", "variant_table", "scan_board", "trade_setup_score", "supply_demand_zones", "first_passage"])
def test_prices_over_time_are_adjusted(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in folder.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found, wanted = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLES[name]).df()
    assert len(wanted)
    keys = [c for c in ("symbol", "dt", "kind", "bar", "variant", "sample") if c in wanted]
    plain = lambda x: x[sorted(x)].assign(**({"dt": x["dt"].astype(str).str[:10]} if "dt" in x else {})).sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(found), plain(wanted), check_dtype=False, rtol=1e-6)


def test_factors_are_those_of_sql_bit_by_bit(spark):
    df = spark.range(1, 1001).selectExpr("-id * 0.00731D AS power")
    found = df.select("power", exponential("power").alias("adj")).toPandas()  # noqa: F841
    assert duckdb.sql("SELECT count(*) FROM found WHERE adj <> exp(power)").fetchall() == [(0,)]


@pytest.mark.parametrize("x", [-0.00001, 0.00001, -0.0, 0.0, -1.00005, 2.34567, None])
def test_places_keep_the_sign_of_zero_as_sql_does(spark, x):
    found = spark.createDataFrame([(x,)], "x double").select(places(F.col("x"), 4)).first()[0]
    assert repr(found) == repr(duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0])
