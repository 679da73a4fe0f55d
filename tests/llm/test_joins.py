"""Joins whose sides grow with the input are never broadcast: what they would build lies in the driver, round after round."""

from tapeloom.llm import components, simhash_dedup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_broadcast_for_near_copies(spark, tmp_path):
    path = f"file://{tmp_path}/edges"
    spark.createDataFrame([(2, 1), (3, 2)], "u long, v long").write.parquet(path)
    edges = spark.read.parquet(path)
    for large in (True, False):
        assert "Broadcast" not in plan(components._stars(edges, large))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert "Broadcast" not in plan(simhash_dedup.simhash_groups(docs))
