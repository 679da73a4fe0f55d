"""The stored tape: how it is joined, and that its trades are those of its SQL."""

import os

import duckdb

from tapeloom.sources.tape import ORDER, TAPE_SQL, joined, tape

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_trades_are_joined_alike_at_any_size(spark):
    plan = joined(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 4 and "Broadcast" not in plan and "SortMergeJoin" not in plan


def test_tape_is_that_of_its_sql(spark):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ["symbol", "buyer", "seller", "rate", *ORDER]
    wanted = con.sql(f"WITH {TAPE_SQL} SELECT {', '.join(columns)} FROM tape ORDER BY {', '.join(ORDER)}").df()
    found = tape(spark, SF).select(*columns).orderBy(*ORDER).toPandas()
    assert [tuple(r) for r in found.itertuples(index=False)] == [tuple(r) for r in wanted.itertuples(index=False)]
