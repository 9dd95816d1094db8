"""What a task holds follows neither the input nor the number of cells."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lakewright.operators import exposure, rollup
from lakewright.plans import catalogue, incremental, marts
from lakewright.sources.tablestore import Table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_policies_on_risk_state_is_narrow_and_rolls_up(spark):
    rng = random.Random(5)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 900))
    rows = [(rng.choice([None, *range(0, 4_000_000, 40_000)]), rng.choice("xy"), rng.choice("pq"), rng.choice("mn"), day()) for _ in range(300)]
    policies = spark.createDataFrame(rows, "policy_id long, country string, partner_code string, product_code string, inception_date date")
    policies = policies.withColumns({"expiry_date": F.date_add("inception_date", 200), "term_days": F.lit(200), "policy_status": F.lit("ACTIVE"), "written_premium_thb": F.lit(1).cast("decimal(18,2)")})
    earned = exposure.earned_premium(policies, spark.createDataFrame([], "policy_id long, effective_date date, is_refund boolean"), dt.date(2030, 1, 1))
    state = marts.policies_on_risk(earned)
    assert "binary" not in dict(state.dtypes).values()  # bitmaps of numbers are nearly empty here, and took 4 KB for a policy and month
    assert state.count() <= 2 * len(rows)
    cells = earned.where("policy_id is not null").collect()
    for months, first in ((1, lambda d: d), (3, lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1)), (12, lambda d: d.replace(month=1))):
        want = {}
        for r in cells:
            want.setdefault((r["country"], first(r["month_start"])), set()).add(r["policy_id"])
        got = {(r["country"], r["span"]): r["n"] for r in rollup.span_counts(state.unionByName(state), ["country"], "policy_id", months, "span", "n").collect()}
        assert got == {k: len(v) for k, v in want.items()}


def test_orders_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(catalogue, "POLICIES_A_TASK", 300)
    assert catalogue._tasks(spark, str(tmp_path)) == 4


def test_policies_of_a_month_are_counted_without_holding_them_by_month(spark):
    rng = random.Random(6)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 500))
    rows = [(rng.choice([None, *range(40)]), d, d + dt.timedelta(rng.choice([0, 1, 20, 31, 200, 400]))) for d in (day() for _ in range(200))]
    policies = spark.createDataFrame(rows + rows[:9], "policy_id long, inception_date date, expiry_date date")
    policies = policies.withColumns({"term_days": F.lit(200), "policy_status": F.when(F.col("policy_id") % 3 == 0, "CANCELLED").otherwise("ACTIVE"), "written_premium_thb": F.lit(1).cast("decimal(18,2)")})
    paid = spark.createDataFrame([(3, dt.date(2020, 9, 9), True), (6, dt.date(2021, 1, 1), True)], "policy_id long, effective_date date, is_refund boolean")
    risk = exposure.at_risk(policies, paid, dt.date(2021, 3, 15))
    want = {r["month_start"]: r["n"] for r in exposure.earned_cells(risk).groupBy("month_start").agg(F.count_distinct("policy_id").alias("n")).collect()}
    got = {r["month_start"]: r["n"] for r in exposure.earned_cells(exposure.with_first_months(risk)).groupBy("month_start").agg(F.count_if(exposure.is_first()).alias("n")).collect()}
    assert got == want and len(got) > 12


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not found")
def test_earned_monthly_aggregates_by_month_only(spark):
    plan = catalogue.earned_monthly(spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"keys=\[([^\]]*)\]", plan)
    assert keys and not [k for k in keys if "month_start" in k and "policy_id" in k]


def test_touched_keys_are_made_once_and_follow_chains(spark, tmp_path):
    """Ties read their feed once, whatever the number of steps; the keys that later steps join are files, not plans made again."""
    table, links = Table(spark, str(tmp_path / "t")), 5
    day, late = dt.date(2024, 1, 1), dt.date(2024, 6, 1)
    rows = [(f"i{k}", f"n{k + d}", day) for k in range(links) for d in (0, 1)] + [("i90", "n90", day), (None, "n1", day), ("i91", None, day), ("i0", "n0", late)]
    table.append(spark.createDataFrame(rows, "a string, b string, _batch_date date"), ["_batch_date"])
    keyed = incremental.Keyed({"f": {"claim_id": "a", "claim_no": "b"}}, "claim_id", ("claim_id", "claim_no"))
    kept = []
    with table.scratch() as keep:
        found = incremental.touched_keys(lambda f: table, keyed, late, lambda df: kept.append(df) or keep(df))
        assert {n: sorted(r[0] for r in df.collect()) for n, df in found.items()} == {"claim_id": [f"I{k}" for k in range(links)], "claim_no": [f"N{k}" for k in range(links + 1)]}
        assert sum(any("/data/_commit" in f for f in df.inputFiles()) for df in kept) == 3  # two kinds of key and the ties
        assert all("/_scratch/" in f for df in found.values() for f in df.inputFiles())
    assert not any((tmp_path / "t" / "_scratch").iterdir())
