"""Studies of a family that may be empty."""

from tapeloom.operators import market


def test_bootstrap_of_a_family_without_rows(spark):
    r = market.cluster_bootstrap(spark.createDataFrame([], "symbol string, ex double")).collect()
    assert [x.asDict() for x in r] == [{"symbols": None, "agree": 0, "top3_share": None, "excess": None, "lo": None, "hi": None, "p_value": 1.0}]


def test_bootstrap_of_one_symbol(spark):
    r = market.cluster_bootstrap(spark.createDataFrame([("A", 0.5), ("A", 0.1)], "symbol string, ex double"), draws=50).first()
    assert (r.symbols, r.agree, r.lo, r.hi) == (1, 1, r.excess, r.excess) and r.p_value == 1 / 51
