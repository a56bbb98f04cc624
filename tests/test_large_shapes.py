"""The plans for tables too large to broadcast: same results, and nothing in them that cannot scale."""

import re

import pytest

import __spark_entry__ as entry
from evenkeel.functions.bounded import BROADCAST_ROWS_SETTING, fits
from evenkeel.functions.skew import HOT_ROWS_SETTING
from oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {n: q.run for n, q in entry.REGISTERED.items()}, entry.oracle_sql()
LARGE = {BROADCAST_ROWS_SETTING: "0", HOT_ROWS_SETTING: "20", "spark.sql.autoBroadcastJoinThreshold": "-1"}
# What a broadcast may hold here: hot keys, a thousand at most, and one row per sorted range.
MAY_BROADCAST = {"c_fk_orphans", "c_fk_action", "c_fk_action_set_null", "c_fk_action_set_default"}
MAY_BROADCAST |= {"c_fk_cascade_reach", "x_refused_apply", "l_backfill_resume"}  # and a handful of counts
MAY_BROADCAST |= {"c_fk_action_restrict", "c_identity_fill", "l_record", "s_drift", "s_drift_strict", "r_pending_gate"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def large(spark):
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    yield spark
    for k in LARGE:
        spark.conf.unset(k)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows_over_one_partition(plan: str) -> list[str]:
    """What meets in one task without being a count or the first few rows."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        below = lines[i + 1] if i + 1 < len(lines) else ""
        if not re.search(r"partial_|LocalLimit|HashAggregate|SortAggregate|Aggregate", below):
            found.append(below.strip())
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_large_shape(large, con, name):
    df = QUERIES[name](large, SF)
    plan = plan_of(df)
    assert not re.search(r"EvalPython|InPandas|InArrow|PythonUDF", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in MAY_BROADCAST:
        assert "BroadcastExchange" not in plan
    if name == "r_change_feed_bucketed":
        assert "Exchange" not in plan
    columns, expected = sql_rows(con, SQL[name])
    assert spark_rows(df) == expected
    if name not in ("c_identity_fill", "l_record"):  # a window over one row per sorted range
        assert windows_over_one_partition(plan) == []


def scans(df, capsys) -> list[tuple[str, str]]:
    """(pushed filters, columns read) of every scan."""
    df.explain("formatted")
    text = capsys.readouterr().out
    found = []
    for part in re.split(r"\n\(\d+\) ", text):
        if part.startswith("Scan parquet"):
            pushed = re.search(r"PushedFilters: (.*)", part)
            found.append((pushed[1] if pushed else "", re.search(r"ReadSchema: (.*)", part)[1]))
    return found


def test_columns_and_filters_reach_the_scan(spark, capsys):
    read = scans(QUERIES["r_updates"](spark, SF), capsys)
    live = [columns for pushed, columns in read if "c_acctbal" not in pushed]
    assert live and all("c_acctbal" not in columns for columns in live)
    assert any("GreaterThanOrEqual(c_acctbal,0.0)" in pushed for pushed, _ in read)
    read = scans(QUERIES["r_deletes"](spark, SF), capsys)
    assert read and all("c_mktsegment" not in columns and "c_name" not in columns for _, columns in read)
    [(_, columns)] = set(scans(QUERIES["c_unique"](spark, SF), capsys))
    assert columns == "struct<l_orderkey:bigint,l_linenumber:int>"


def test_plan_lines_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["r_plan_lines"](spark, SF))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 20, Partial", plan)


def test_fits_measures_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS s", "array(1, 2) AS a")
    assert fits(df, 100) and not fits(df, 99) and not fits(df, 0)
    assert not fits(df, 100, 50_000) and fits(df, 100, 200_000)
