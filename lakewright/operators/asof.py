"""Half-open validity windows and joins that look up a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.functions.money import convert
from lakewright.operators.dedupe import dedupe_latest


def validity_windows(df: DataFrame, keys: Sequence[str], start: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Adds [valid_from, valid_to): each row holds until the key's next; the newest stays open (null)."""
    return df.withColumn(valid_from, F.col(start)).withColumn(valid_to, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def fx_spine(rates: DataFrame, ingested: str = "_ingested_at") -> DataFrame:
    """Rates (rate_date, from_currency, to_currency, rate), the latest landed of each day, with windows."""
    latest = dedupe_latest(rates, ["rate_date", "from_currency", "to_currency"], [ingested]) if ingested in rates.columns else rates
    return validity_windows(latest, ["from_currency", "to_currency"], "rate_date").select("from_currency", "to_currency", F.col("rate").cast("decimal(18,8)").alias("rate"), "valid_from", "valid_to")


def point_in_time(at: Column, valid_from: Column, valid_to: Column) -> Column:
    return (at >= valid_from) & (valid_to.isNull() | (at < valid_to))


def last_before(facts: DataFrame, events: DataFrame, keys: dict[str, str], on: str, at: str, value: str, into: str, bucket: str = "MM") -> DataFrame:
    """facts with, in `into`, the value of the newest event of their key at or before their time; null if there is none.

    keys names the fact's columns by the event's.  Facts and events meet as one tagged union, sorted by time inside
    each key and time bucket (a unit of date_trunc), and the last value seen is carried forward: no fact meets
    more than its own bucket, and no event is copied.  What a bucket inherits comes as one carry row, the newest
    value before it, found over the buckets alone.  A key with a third of all facts thus spreads over as many
    tasks as it has buckets.  Of events of one time the greatest value counts; facts without key or time get null.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    start = lambda c: F.date_trunc(bucket, c)
    fact = facts.select(*[F.col(f).alias(n) for n, f in zip(names, keys, strict=True)], F.col(on).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact"))
    event = events.select(*[F.col(e).alias(n) for n, e in zip(names, keys.values(), strict=True)], F.col(at).alias("_t"), F.struct(F.col(value).alias("v")).alias("_value")).where(" and ".join(f"{n} is not null" for n in [*names, "_t"]))
    kind, nothing = dict(event.dtypes)["_value"], F.lit(None)
    # One row per key and bucket of either side, with the bucket's newest event; few, whatever the facts.
    newest = event.groupBy(*names, start("_t").alias("_bucket")).agg(F.max(F.struct("_t", "_value")).alias("_new"))
    asked = fact.where(" and ".join(f"{n} is not null" for n in [*names, "_t"])).select(*names, start("_t").alias("_bucket")).distinct()
    buckets = asked.withColumn("_new", nothing.cast(dict(newest.dtypes)["_new"])).unionByName(newest).groupBy(*names, "_bucket").agg(F.max("_new").alias("_new"))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.withColumn("_value", F.last("_new", ignorenulls=True).over(earlier)["_value"]).where("_value is not null")
    tagged = fact.select(*names, start("_t").alias("_bucket"), "_t", F.lit(2).alias("_side"), nothing.cast(kind).alias("_value"), "_fact")
    kind_of_fact = dict(fact.dtypes)["_fact"]
    seen = event.select(*names, start("_t").alias("_bucket"), "_t", F.lit(1).alias("_side"), "_value", nothing.cast(kind_of_fact).alias("_fact"))
    brought = carry.select(*names, "_bucket", nothing.cast(dict(fact.dtypes)["_t"]).alias("_t"), F.lit(0).alias("_side"), "_value", nothing.cast(kind_of_fact).alias("_fact"))
    order = Window.partitionBy(*names, "_bucket").orderBy(F.col("_t").asc_nulls_first(), "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A fact without a time stands first in its null bucket, where no event is.
    out = tagged.unionByName(seen).unionByName(brought).withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_side = 2")
    return out.select("_fact.*", F.col("_value.v").alias(into))


#: Spine rows up to which the rate side is broadcast.
BROADCAST_RATES = 200_000


def fx_join(facts: DataFrame, spine: DataFrame, currency: str, on: str, reporting: str = "THB", rows: int | None = None) -> DataFrame:
    """facts with the `rate` valid on their date, null where there is none; no fact is lost or doubled.

    The spine is broadcast if `rows` (its known count) or a bounded count proves it
    small; otherwise facts and rates meet as a tagged union (`last_before`).
    """
    rates = spine.where(F.col("to_currency") == reporting).select(F.col("from_currency").alias("_cur"), F.col("rate").cast("decimal(18,8)").alias("rate"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    n = rows if rows is not None else rates.limit(BROADCAST_RATES + 1).count()
    if n <= BROADCAST_RATES:
        inside = (F.col(currency) == F.col("_cur")) & point_in_time(F.col(on), F.col("_from"), F.col("_to"))
        return facts.join(F.broadcast(rates), inside, "left").drop("_cur", "_from", "_to")
    held = rates.select("_cur", "_from", F.struct("rate", "_to").alias("_held"))
    found = last_before(facts, held, {currency: "_cur"}, on, "_from", "_held", "_held")
    still = F.col("_held._to").isNull() | (F.col(on) < F.col("_held._to"))
    return found.withColumn("rate", F.when(still, F.col("_held.rate"))).drop("_held")


def converted(facts: DataFrame, spine: DataFrame, amounts: dict[str, str], currency: str, on: str, reporting: str = "THB", rows: int | None = None) -> DataFrame:
    """facts with amounts {source: new column} in the reporting currency; `rows` as for `fx_join`."""
    joined = fx_join(facts, spine, currency, on, reporting, rows)
    return joined.withColumns({new: convert(F.col(old), F.col(currency), F.col("rate"), reporting) for old, new in amounts.items()}).drop("rate")
