import random

from evenkeel.functions.bounded import BROADCAST_ROWS_SETTING
from evenkeel.operators.diff import change_feed
from evenkeel.sources.bucketed import highest_plan, highest_values, keep_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(spark, seed, name):
    rng = random.Random(seed)
    rows = [(k, rng.choice("xy"), rng.choice([None, "a", "b"])) for k in rng.sample(range(300), 200)]
    rows += [(None, "x", "keyless")] * (name == "live")
    return spark.createDataFrame(rows, "id long, part string, v string")


def test_a_feed_between_bucketed_tables_has_no_shuffle(spark):
    live, declared = keyed(spark, 1, "live"), keyed(spark, 2, "declared")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = keep_bucketed(live, "bucketed_live", ["id"], 8)
        b = keep_bucketed(declared, "bucketed_declared", ["id"], 8)
        feed = change_feed(a, b, ["id"], prune=True, broadcast_rows=0)
        assert "Exchange" not in plan_of(feed)
        expected = change_feed(live, declared, ["id"], prune=True)
        assert feed.count() == expected.count() > 100 and feed.exceptAll(expected).isEmpty()
        # against a plain frame the live side still stays where it is
        plan = plan_of(change_feed(a, declared, ["id"], broadcast_rows=0))
        assert plan.count("Exchange hashpartitioning") == 1
        assert len(a.inputFiles()) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("bucketed_live", "bucketed_declared"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    assert spark.conf.get(BROADCAST_ROWS_SETTING, None) is None


def test_highest_values_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "CAST(-id AS INT) AS n", "string(id) AS s").repartition(4).write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    assert highest_values(spark, path, ["id", "n"]) == {"id": 999, "n": 0}
    assert "PushedAggregation: [MAX(id)" in highest_plan(spark, path, ["id"])
    assert before == {k: spark.conf.get(k) for k in before}
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert highest_values(spark, empty, ["id"]) == {"id": None}
