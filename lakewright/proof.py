"""Ten checks that a built warehouse does what it is for, as one report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions import is_valid_thai_id
from lakewright.operators.scd2 import overlapping_windows
from lakewright.plans.models import Run
from lakewright.sources.bronze import Bronze


@dataclass(frozen=True)
class Proof:
    name: str
    passed: bool
    detail: str


def prove(ctx: Run, bronze: Bronze, feed: str = "partner_policies_a", key: str = "policy_no") -> list[Proof]:
    """The checks after a run over some batches; ctx holds its frames, staged ones among them."""
    gold, staged = lambda n: ctx.table(n).read(), ctx.frames
    out: list[Proof] = []
    tell = lambda name, passed, detail: out.append(Proof(name, bool(passed), detail))
    one = lambda df, *cols: df.agg(*cols).first()

    landed = bronze.read(feed).where(F.col(key).isNotNull())
    rows, keys = one(landed, F.count("*"), F.count_distinct(F.upper(F.trim(key))))
    mine = landed.select(F.upper(F.trim(key)).alias("policy_id")).distinct()
    kept = staged["stg_partner_policies"].join(mine, "policy_id", "left_semi").count()
    tell("records sent again are kept once", rows > kept == keys, f"{rows} landed, {keys} keys, {kept} staged")
    again = landed.groupBy(key).agg(F.count_distinct("_batch_date").alias("batches")).where("batches > 1").count()
    tell("a key came again in another batch", again, f"{again} keys")

    late, worst = one(gold("silver_claims").where("is_late_reported"), F.count("*"), F.max("reporting_lag_days"))
    tell("late claims are merged into their month", late, f"{late} claims, the latest after {worst} days")
    beyond = one(gold("mart_claims_lag"), F.sum("beyond_lookback_window"))[0] or 0
    tell("the look-back covers every lag seen", beyond == 0, f"{beyond} claims beyond {ctx.lookback_days} days")

    history = gold("silver_policy_as_of")
    versions, policies = one(history, F.count("*"), F.count_distinct("policy_id"))
    tell("history keeps earlier versions", versions > policies, f"{versions} versions of {policies} policies")
    overlaps = overlapping_windows(history, ["policy_id"]).count()
    tell("validity windows do not overlap", overlaps == 0, f"{overlaps} overlaps")

    both = gold("dim_customer").join(staged["stg_customers"].select("customer_id", "national_id", "phone"), "customer_id")
    leaks = both.where((F.col("national_id_hash") == F.col("national_id")) | (F.col("phone_masked") == F.col("phone"))).count()
    tell("no raw personal data reaches gold", leaks == 0, f"{leaks} values")
    hashes, people = one(both.where("national_id is not null"), F.count_distinct("national_id_hash"), F.count_distinct(F.trim("national_id")))
    tell("hashed ids still join", hashes == people > 0, f"{hashes} hashes of {people} ids")

    thai = staged["stg_customers"].where("country = 'TH' and national_id is not null")
    n, wrong = one(thai, F.count("*"), F.count_if(~is_valid_thai_id(F.col("national_id"))))
    tell("the check digit finds ids that are wrong, and they are few", 0 < wrong < 0.15 * n, f"{wrong} of {n}")
    refused = one(bronze.quarantine_reasons(), F.sum("rows"))[0] or 0
    tell("unreadable records are in quarantine", refused, f"{refused} rows")
    return out


def business_answers(ctx: Run) -> DataFrame:
    """Earned, incurred, loss ratio and claim frequency by product over all months."""
    ratio = lambda a, b: F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0)))
    return ctx.table("mart_loss_ratio").read().groupBy("product_code", "cover_class").agg(
        F.round(F.sum("earned_premium_thb")).alias("earned_thb"), F.round(F.sum("incurred_thb")).alias("incurred_thb"),
        F.round(ratio("incurred_thb", "earned_premium_thb"), 3).alias("loss_ratio"), F.round(ratio("claim_count", "exposure_policy_years"), 3).alias("frequency"),
    )
