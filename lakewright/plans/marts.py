"""Facts, dimensions and marts as functions of their inputs; dates come as `as_of`."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import age_years, band, date_key, mask_pii, reporting_lag, year_month
from lakewright.operators import rollup

#: Days from loss to report from which a claim is late.
LATE_FROM = 21
#: What each product covers.
COVER = {
    "MOTOR_CMI": ("compulsory", "Thai compulsory motor (por ror bor): bodily injury only, statutory caps"),
    "MOTOR_VOL_C1": ("class_1", "Class 1: own damage, theft and fire, third party"),
    "MOTOR_VOL_C2": ("class_2", "Class 2: theft and fire, third party; no own damage"),
    "MOTOR_VOL_C3": ("class_3", "Class 3: third party only"),
    "HEALTH_ADJ": ("health", "Adjustable health: sum insured re-rated between periods"),
}


def _cover(code: Column, part: int) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in COVER.items() for x in (k, v[part])])
    return F.try_element_at(known, F.coalesce(code, F.lit("")))


def with_lag(claims: DataFrame) -> DataFrame:
    """claims with the days from loss to report, and whether that is late."""
    lagged = claims.withColumn("reporting_lag_days", reporting_lag(F.col("reported_date"), F.col("loss_date")))
    return lagged.withColumn("is_late_reported", F.col("reporting_lag_days") >= LATE_FROM)


def claims_fact(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per claim with its policy's keys; orphans stay, flagged.  Coverage includes both ends."""
    p = policies.select(F.col("policy_id").alias("_policy"), "product_code", "partner_code", "country", F.col("inception_date").alias("_from"), F.col("expiry_date").alias("_to"))
    known, loss = F.col("_policy").isNotNull(), F.col("loss_date")
    joined = claims.join(p, F.col("policy_id") == F.col("_policy"), "left")
    return joined.withColumns(
        {
            "loss_date_key": date_key(loss),
            "reported_date_key": date_key(F.col("reported_date")),
            "loss_year_month": year_month(loss),
            "reported_year_month": year_month(F.col("reported_date")),
            "is_orphan": ~known,
            "is_outside_coverage": known & ((loss < F.col("_from")) | (loss > F.col("_to"))),
        }
    ).drop("_policy", "_from", "_to")


_CELL = ["country", "partner_code", "product_code"]


def loss_ratio(earned: DataFrame, claims: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Incurred by loss month over earned premium, per month, country, partner and product.

    Earned cells are the base: claims of cells without earned premium do not show.  Ratios
    are null, not 0, over nothing.  `earned` has one row per policy and month (`earned_premium`), so a month's policies are
    its rows; over several months they are counted from `policies_on_risk`'s state.
    """
    e = earned.groupBy("earned_year_month", "month_start", *_CELL).agg(
        F.sum("earned_premium_thb").alias("earned_premium_thb"), F.sum("exposure_policy_years").alias("exposure_policy_years"), F.count("policy_id").alias("policies_on_risk")
    )
    c = claims.where("not is_orphan").groupBy("loss_year_month", *[F.col(k).alias(f"_{k}") for k in _CELL]).agg(
        F.count("*").alias("n"), F.sum("gross_incurred_thb").alias("incurred"), F.sum("paid_amount_thb").alias("paid"), F.count_if("is_late_reported").alias("late")
    )
    same = F.col("earned_year_month") == F.col("loss_year_month")
    for k in _CELL:
        same = same & (F.col(k) == F.col(f"_{k}"))
    j = e.join(c, same, "left").withColumns({new: F.coalesce(old, F.lit(0)) for new, old in (("claim_count", "n"), ("incurred_thb", "incurred"), ("paid_thb", "paid"), ("late_reported_claims", "late"))})
    if products is not None:
        j = j.join(products.select("product_code", "product_name_en", "cover_class", "line_of_business"), "product_code", "left")
    years, n, inc = F.col("exposure_policy_years"), F.col("claim_count"), F.col("incurred_thb")
    return j.withColumns(
        {
            "loss_ratio": F.when(F.col("earned_premium_thb") > 0, F.round(inc / F.col("earned_premium_thb"), 4)),
            "claim_frequency": F.when(years > 0, F.round(n / years, 4)),
            "claim_severity_thb": F.when(n > 0, F.round(inc / n, 2)),
            "is_credible": (years >= 5) & (n >= 3),
            "credibility_band": band(years, [1, 5, 25], ["very_low", "low", "partial", "full"]),
        }
    ).withColumnRenamed("earned_year_month", "year_month").drop("loss_year_month", "n", "incurred", "paid", "late", *[f"_{k}" for k in _CELL])


def quote_conversion(quotes: DataFrame, products: DataFrame) -> DataFrame:
    """Quotes and sales by quote month, country, partner, product and channel."""
    p = products.select(F.col("product_code").alias("_code"), "product_name_en", "cover_class")
    q = quotes.where("quoted_date is not null").join(p, F.col("product_code") == F.col("_code"), "left").drop("_code")
    sold = F.col("did_convert")
    return q.groupBy(
        year_month(F.col("quoted_date")).alias("quote_year_month"), F.date_trunc("month", "quoted_date").alias("month_start"), *_CELL, "product_name_en", "cover_class", "channel"
    ).agg(
        F.count("*").alias("quotes_issued"),
        F.count_if(sold).alias("quotes_converted"),
        F.round(F.count_if(sold) / F.count("*"), 4).alias("conversion_rate"),
        F.round(F.avg("quoted_premium"), 2).alias("avg_quoted_premium"),
        F.round(F.avg(F.when(sold, F.col("quoted_premium"))), 2).alias("avg_converted_premium"),
        F.count_if(F.col("quote_status") == "REJECTED").alias("quotes_rejected"),
        F.count_if(F.col("quote_status") == "EXPIRED").alias("quotes_expired"),
    )


def policies_on_risk(earned: DataFrame, number: str = "policy_id") -> DataFrame:
    """State of the policies on risk per cell, by months, to be rolled up to any span (`rollup.span_counts`)."""
    return rollup.span_state(earned, _CELL, number, "month_start")


_LAG_CELL = ["loss_year_month", "country", "product_code"]
_LAG_SUMS, _LAG_MOST = ("late_incurred",), ("last_loss",)


def claims_lag_state(claims: DataFrame) -> DataFrame:
    """Claims per loss month, country, product and days of lag: what `claims_lag_of` needs, to be kept and added to."""
    late = F.when(F.col("is_late_reported"), F.col("gross_incurred_thb")).otherwise(0)
    return rollup.value_state(claims.where("not is_orphan"), _LAG_CELL, "reporting_lag_days", {"late_incurred": late}, {"last_loss": F.col("loss_date")})


def claims_lag_of(state: DataFrame, lookback_days: int, as_of: dt.date, by: Sequence[str] = tuple(_LAG_CELL)) -> DataFrame:
    """Distribution of reporting lag over any of the state's columns, exact however many batches and cells it unites."""
    lag, n = F.col("reporting_lag_days"), F.col("_n")
    merged = rollup.merged_values(state, by, "reporting_lag_days", _LAG_SUMS, _LAG_MOST)
    late = F.sum(F.when(lag >= LATE_FROM, n).otherwise(0))
    plain = merged.groupBy(*by).agg(
        F.sum(n).alias("claim_count"),
        F.round(F.sum(lag * n) / F.sum(n), 1).alias("avg_lag_days"),
        F.min(lag).alias("min_lag_days"),
        F.max(lag).alias("max_lag_days"),
        late.alias("late_reported_count"),
        F.round(late / F.sum(n), 4).alias("late_reported_pct"),
        F.sum(F.when(lag > lookback_days, n).otherwise(0)).alias("beyond_lookback_window"),
        F.sum("late_incurred").alias("late_reported_incurred_thb"),
        (F.date_add(F.max("last_loss"), F.max(lag)) > F.date_sub(F.lit(as_of), lookback_days)).alias("claims_still_developing"),
    )
    shares = rollup.percentiles(merged, by, "reporting_lag_days", {f"p{p}_lag_days": p / 100 for p in (50, 90, 95, 99)})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return plain.join(shares.withColumnsRenamed({c: f"_{c}" for c in by}), same).drop(*[f"_{c}" for c in by])


def claims_lag(claims: DataFrame, lookback_days: int, as_of: dt.date) -> DataFrame:
    """Distribution of reporting lag by loss month, country and product."""
    return claims_lag_of(claims_lag_state(claims), lookback_days, as_of)


def date_dim(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day, with the Buddhist Era year."""
    d = F.col("date_day")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date_day"))
    return days.select(
        d, date_key(d).alias("date_key"), F.year(d).alias("calendar_year"), (F.year(d) + 543).alias("buddhist_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("calendar_month"),
        F.date_format(d, "MMM").alias("month_name"), F.trunc(d, "MM").alias("month_start"), F.last_day(d).alias("month_end"), year_month(d).alias("year_month"), F.dayofweek(d).alias("day_of_week"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"), (d == F.last_day(d)).alias("is_month_end"),
    )


def date_bounds(policies: DataFrame, claims: DataFrame, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Span of the calendar: 30 days before the first inception or loss to 400 after the last expiry or as_of."""
    a, z = policies.agg(F.min("inception_date"), F.max("expiry_date")).first()
    b = claims.agg(F.min("loss_date")).first()[0]
    return min(a or as_of, b or as_of) - dt.timedelta(30), max(z or as_of, as_of) + dt.timedelta(400)


def dim_customer(customers: DataFrame, as_of: dt.date, salt: str) -> DataFrame:
    """Customers with personal data masked; a null age falls in the last band."""
    masked = {"first_name_masked": ("first_name", "name"), "last_name_masked": ("last_name", "name"), "national_id_hash": ("national_id", "national_id"), "email_masked": ("email", "email"),
              "phone_masked": ("phone", "phone"), "address_masked": ("address", "address"), "birth_year": ("date_of_birth", "dob")}
    age = age_years(F.col("date_of_birth"), F.lit(as_of))
    return customers.select(
        "customer_id", *[mask_pii(F.col(c), kind, salt).alias(new) for new, (c, kind) in masked.items()], "province", "country", age.alias("age_years"),
        band(age, [25, 35, 45, 55, 65], ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]).alias("age_band"), "created_date",
    )


def dim_vehicle(vehicles: DataFrame, as_of: dt.date) -> DataFrame:
    age = F.lit(as_of.year) - F.col("manufacture_year")
    return vehicles.select(
        "vehicle_id", "customer_id", mask_pii(F.col("plate_no"), "plate").alias("plate_masked"), "plate_province", mask_pii(F.col("chassis_no"), "chassis").alias("chassis_masked"), "make", "model",
        F.concat("make", F.lit(" "), "model").alias("make_model"), "manufacture_year", age.alias("vehicle_age_years"), band(age, [3, 7, 12], ["0-3", "4-7", "8-12", "13+"], inclusive=True).alias("vehicle_age_band"),
        "engine_cc", band(F.col("engine_cc"), [1500, 2000], ["small", "medium", "large"], inclusive=True).alias("engine_class"), "vehicle_value_local", "country",
    )


def dim_product(products: DataFrame) -> DataFrame:
    code = F.col("product_code")
    return products.withColumns({"cover_class": _cover(code, 0), "is_compulsory": code == "MOTOR_CMI", "cover_description": _cover(code, 1)})


def dim_partner(partners: DataFrame, as_of: dt.date) -> DataFrame:
    return partners.select("partner_code", "partner_name", "country", "schema_variant", "commission_rate", "onboarded_date", (F.datediff(F.lit(as_of), "onboarded_date") / 365.25).alias("tenure_years"))


def dim_health_profile(declarations: DataFrame) -> DataFrame:
    """Which policies declared, when; what they declared is gone, even whether they did."""
    gone = lambda c: mask_pii(F.col(c), "health").alias(c)
    return declarations.select("policy_id", "customer_id", "declared_date", gone("pre_existing_conditions"), gone("bmi_band"), F.lit(None).cast("boolean").alias("has_declared_condition"))
