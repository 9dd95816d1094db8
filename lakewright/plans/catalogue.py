"""Queries over the driver tables, one per operator, each with an independent SQL form.

Money is summed in integer cents where order could matter, and every output is cast to a
type both engines share.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright import functions as L
from lakewright import kpi, quality
from lakewright.operators import asof, cdc, dedupe, exposure, merge, rollup, scd2
from lakewright.operators.harmonise import harmonise
from lakewright.plans import marts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = dt.date(2001, 8, 1)


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- deduplication and hashes

_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"""
select l_orderkey, l_linenumber, cast(l_shipdate as date) as l_shipdate, {", ".join(_LINE)} from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last, {", ".join(f"{c} nulls first" for c in _LINE)}) = 1
""")
def dedupe_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return dedupe.dedupe_latest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"], _LINE).select("l_orderkey", "l_linenumber", "l_shipdate", *_LINE)


@query("""
select c_custkey, sha256(concat_ws('||', c_custkey::varchar, c_name, c_nationkey::varchar, coalesce(nullif(c_mktsegment, 'BUILDING'), '<null>'))) as record_hash from customer
""")
def record_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select("c_custkey", dedupe.record_hash(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("record_hash"))


# ---------------------------------------------------------------- cleaning


@query("select p_partkey, p_name as cleaned, cast(null as varchar) as blank from part")
def clean_text(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("scuffed", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("   ")))
    return rows.select("p_partkey", L.clean_text(F.col("scuffed")).alias("cleaned"), L.clean_text(F.lit("    ")).alias("blank"))


@query("select c_custkey, c_mktsegment as code from customer")
def clean_code(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("scuffed", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  ")))
    return rows.select("c_custkey", L.clean_code(F.col("scuffed")).alias("code"))


@query("""
select o_orderkey, case o_orderstatus when 'F' then 'EXPIRED' when 'O' then 'ACTIVE' when 'P' then 'CANCELLED' else 'UNKNOWN' end as status from orders
""")
def status_normalise(spark, sf_dir):
    word = F.array(F.lit(" ยกเลิก "), F.lit("canceled"), F.lit("Cancelled"))
    spoken = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "expired").otherwise("หมดอายุ"))
    spoken = spoken.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, " Active").otherwise("มีผลบังคับ"))
    spoken = spoken.when(F.col("o_orderstatus") == "P", F.element_at(word, (F.col("o_orderkey") % 3 + 1).cast("int"))).otherwise("?")
    return read(spark, sf_dir, "orders").select("o_orderkey", L.normalise_status(spoken).alias("status"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else 'PARTNER_' || (p_partkey % 7) end as partner from part")
def partner_code(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 3 == 0, "file:/events/quotes/dt=2026-01-05/a.jsonl").otherwise(
        F.concat(F.lit("file:/landing/partner_drops/partner_"), (F.col("p_partkey") % 7).cast("string"), F.lit("/dt=2026-01-05/policies_a.csv"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", L.partner_code(path).alias("partner"))


@query("select o_orderkey, case o_orderkey % 7 when 6 then null else cast(o_orderdate as date) end as parsed from orders")
def be_to_ce_roundtrip(spark, sf_dir):
    """Dates written in six surface forms of two calendars, and one broken form, read back."""
    d = F.col("o_orderdate").cast("date")
    be = (F.year(d) + 543).cast("string")
    en = F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "MAR", "apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), F.month(d))
    th = F.element_at(F.array(*[F.lit(m) for m in ("ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค.")]), F.month(d))
    day, dmy = F.dayofmonth(d).cast("string"), F.date_format(d, "dd/MM/")
    forms = F.array(
        F.date_format(d, "yyyy-MM-dd"),
        F.concat(F.lit("  "), be, F.date_format(d, "-MM-dd"), F.lit(" ")),
        F.concat(dmy, F.year(d).cast("string")),
        F.concat(dmy, be),
        F.concat_ws(" ", day, en, F.year(d).cast("string")),
        F.concat_ws(" ", day, th, be),
        F.lit("2026-02-31"),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", L.be_to_ce_date(F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("parsed"))


@query("""
select p_partkey, case when p_size < 10 then 'small' when p_size < 25 then 'medium' when p_size < 40 then 'large' else 'huge' end as size_band,
       case when p_retailprice <= 1000 then 'low' when p_retailprice <= 1500 then 'mid' else 'high' end as price_band from part
""")
def bands(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        L.band(F.col("p_size"), [10, 25, 40], ["small", "medium", "large", "huge"]).alias("size_band"),
        L.band(F.col("p_retailprice"), [1000, 1500], ["low", "mid", "high"], inclusive=True).alias("price_band"),
    )


@query("select o_orderkey, cast(floor(datediff('day', cast(o_orderdate as date), date '2001-08-01') / 365.25) as integer) as age from orders")
def age_years(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", L.age_years(F.col("o_orderdate").cast("date"), F.lit(AS_OF)).alias("age"))


@query("""
with d as (select c_custkey, lpad(c_custkey::varchar, 12, '7') as s from customer),
k as (select c_custkey, s, cast((11 - list_sum(list_transform(range(1, 13), lambda i: cast(s[i] as integer) * (14 - i))) % 11) % 10 as integer) as digit from d)
select c_custkey, digit as check_digit, true as valid, false as valid_if_changed from k
""")
def national_id_checksum(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("s", F.lpad(F.col("c_custkey").cast("string"), 12, "7"))
    rows = rows.withColumn("check_digit", L.thai_id_check_digit(F.col("s")))
    whole = F.concat(F.substring("s", 1, 1), F.lit("-"), F.substring("s", 2, 11), F.col("check_digit").cast("string"))
    wrong = F.concat("s", ((F.col("check_digit") + 1) % 10).cast("string"))
    return rows.select("c_custkey", "check_digit", L.is_valid_thai_id(whole).alias("valid"), L.is_valid_thai_id(wrong).alias("valid_if_changed"))


# ---------------------------------------------------------------- masking


@query("""
with c as (select *, '08' || lpad(c_custkey::varchar, 8, '0') as phone, 'กข' || c_custkey as plate, lower(replace(c_name, '#', '.')) || '@mail.example' as email from customer)
select c_custkey, sha256('salt' || c_custkey::varchar) as id_hash, left(c_name, 1) || '.' as name,
       case when length(phone) < 6 then '***' else left(phone, 3) || '****' || right(phone, 2) end as phone,
       case when length(plate) < 4 then '***' else '***' || right(plate, 2) end as plate,
       left(email, 1) || '***@' || split_part(email, '@', 2) as email,
       '1980-01-01' as birth_year, '[redacted]' as address, cast(null as varchar) as condition
from c
""")
def mask_pii_customer(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        L.mask_pii(key, "national_id", "salt").alias("id_hash"),
        L.mask_pii(F.col("c_name"), "name").alias("name"),
        L.mask_pii(F.concat(F.lit("08"), F.lpad(key, 8, "0")), "phone").alias("phone"),
        L.mask_pii(F.concat(F.lit("กข"), key), "plate").alias("plate"),
        L.mask_pii(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")), "email").alias("email"),
        L.mask_pii(F.lit("1980-05-17"), "dob").alias("birth_year"),
        L.mask_pii(F.lit("1 Road"), "address").alias("address"),
        L.mask_pii(F.lit("asthma"), "health").alias("condition"),
    )


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


@query(rf"""
with e as (select doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) as email from documents)
select doc_id, left(email, 1) || '***@' || split_part(email, '@', 2) as masked, count(*) as n from e group by all
""")
def mask_email_documents(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_MAIL})"), F.lit(1))).alias("email"))
    return found.groupBy("doc_id", L.mask_pii(F.col("email"), "email").alias("masked")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- currency


def _rates(spark, sf_dir):
    """A rate per region and month start, by formula; the first month is missing."""
    months = F.sequence(F.lit(dt.date(1995, 2, 1)), F.lit(dt.date(2001, 8, 1)), F.expr("interval 1 month"))
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("CUR"), F.col("r_regionkey").cast("string")).alias("from_currency"), "r_regionkey", F.explode(months).alias("rate_date"))
    rate = (F.lit(1) + F.col("r_regionkey") * 0.25 + (F.month("rate_date") + F.year("rate_date") % 7) * 0.01).cast("decimal(18,8)")
    return region.select("rate_date", "from_currency", F.lit("THB").alias("to_currency"), rate.alias("rate"))


_RATES_SQL = """
rates as (
  select cast(m as date) as rate_date, 'CUR' || r_regionkey as from_currency,
         cast(1 + r_regionkey * 0.25 + (month(m) + year(m) % 7) * 0.01 as decimal(18, 8)) as rate
  from region, generate_series(timestamp '1995-02-01', timestamp '2001-08-01', interval 1 month) as g(m)
)"""


@query(f"""
with {_RATES_SQL}
select from_currency, rate_date as valid_from, lead(rate_date) over (partition by from_currency order by rate_date) as valid_to, cast(rate as double) as rate from rates
""")
def fx_spine(spark, sf_dir):
    return asof.fx_spine(_rates(spark, sf_dir)).select("from_currency", "valid_from", "valid_to", F.col("rate").cast("double").alias("rate"))


def _orders_in_currency(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    where = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf_dir, "orders").join(where, F.col("o_custkey") == F.col("c_custkey"))
    currency = F.when(F.col("n_regionkey") == 0, "THB").otherwise(F.concat(F.lit("CUR"), F.col("n_regionkey").cast("string")))
    return orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), currency.alias("currency"), "o_orderpriority", "o_orderstatus")


@query(f"""
with {_RATES_SQL},
o as (
  select o_orderkey, cast(o_orderdate as date) as o_orderdate, cast(o_totalprice as decimal(18, 2)) as amount,
         case when n_regionkey = 0 then 'THB' else 'CUR' || n_regionkey end as currency
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)
select o_orderkey, o.currency,
       cast(case when o.currency = 'THB' then amount else round(cast(cast(amount as decimal(20, 4)) * rate as decimal(38, 12)), 2) end as double) as amount_thb
from o asof left join rates on o.currency = rates.from_currency and o.o_orderdate >= rates.rate_date
""")
def fx_convert_asof(spark, sf_dir):
    out = asof.converted(_orders_in_currency(spark, sf_dir), asof.fx_spine(_rates(spark, sf_dir)), {"amount": "amount_thb"}, "currency", "o_orderdate")
    return out.select("o_orderkey", "currency", F.col("amount_thb").cast("double").alias("amount_thb"))


@query(f"""
with {_RATES_SQL},
o as (
  select o_orderkey, cast(o_orderdate as date) as o_orderdate, cast(o_totalprice as decimal(18, 2)) as amount,
         case when n_regionkey = 0 then 'THB' else 'CUR' || n_regionkey end as currency
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
)
select o_orderkey, o.currency,
       cast(case when o.currency = 'THB' then amount else round(cast(cast(amount as decimal(20, 4)) * rate as decimal(38, 12)), 2) end as double) as amount_thb
from o asof left join rates on o.currency = rates.from_currency and o.o_orderdate >= rates.rate_date
""")
def fx_convert_union(spark, sf_dir):
    """The same conversion with a rate side that is not proven small: a tagged union by currency and month."""
    spine = asof.fx_spine(_rates(spark, sf_dir))
    out = asof.converted(_orders_in_currency(spark, sf_dir), spine, {"amount": "amount_thb"}, "currency", "o_orderdate", rows=asof.BROADCAST_RATES + 1)
    return out.select("o_orderkey", "currency", F.col("amount_thb").cast("double").alias("amount_thb"))


@query("""
select l.l_orderkey, l.l_linenumber, e.event_id as last_event
from (select l_orderkey, l_linenumber, l_suppkey % 50 as u, cast(l_shipdate as date) + interval 9000 day as at from lineitem) l
asof left join (select user_id % 50 as u, ts, max(event_id) as event_id from events group by all) e on l.u = e.u and l.at >= e.ts
""")
def last_event_before(spark, sf_dir):
    """Of every line the newest event of its group before it: both sides are large, and neither is broadcast."""
    group = F.col("l_suppkey") % 50
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", group.alias("u"), F.expr("cast(l_shipdate as timestamp_ntz) + interval 9000 day").alias("at"))
    events = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("u"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return asof.last_before(lines, events, {"u": "u"}, "at", "ts", "event_id", "last_event").select("l_orderkey", "l_linenumber", "last_event")


# ---------------------------------------------------------------- feeds


@query("select o_orderkey::varchar as order_id, o_orderstatus as status, cast(cast(o_orderdate as date) as varchar) as day, case when o_orderkey % 3 = 1 then o_orderpriority end as priority from orders")
def harmonise_union(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    part = lambda k: rows.where(F.col("o_orderkey") % 3 == k)
    a = part(0).select(F.col("o_orderkey").alias("order_no"), F.col("o_orderstatus").alias("st"), F.col("d").alias("date_a"))
    b = part(1).select(F.col("o_orderkey").alias("OrderNumber"), F.col("o_orderstatus").alias("Status"), F.col("d").alias("OrderDate"), F.col("o_orderpriority").alias("Prio"))
    c = part(2).select(F.col("d").alias("tanggal"), F.col("o_orderstatus").alias("keadaan"), F.col("o_orderkey").alias("nomor"))
    names = {
        "a": {"order_id": "order_no", "status": "st", "day": "date_a"},
        "b": {"order_id": "OrderNumber", "status": "Status", "day": "OrderDate", "priority": "Prio"},
        "c": {"order_id": "nomor", "status": "keadaan", "day": "tanggal"},
    }
    return harmonise({"a": a, "b": b, "c": c}, names)


def _changes(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return read(spark, sf_dir, "events").withColumn("op", op)


@query("""
with c as (select *, case event_type when 'signup' then 'I' when 'error' then 'D' else 'U' end as op from events)
select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value
from c group by user_id having arg_max(op, (ts, event_id)) <> 'D'
""")
def cdc_current_state(spark, sf_dir):
    return cdc.cdc_current(_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
select c_custkey as key, 'customer' as source from customer where c_custkey % 3 <> 0
union all select p_partkey, 'part' from part where p_partkey not in (select c_custkey from customer where c_custkey % 3 <> 0)
""")
def anti_join_fill(spark, sf_dir):
    first = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source"))
    return cdc.fill_from(first, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("part").alias("source")), ["key"])


_TAKEN = "select o_orderkey, o_orderstatus, round(o_totalprice * 2, 2) as price, 2 as batch from orders where o_orderkey % 4 < 2"


@query(f"""
select o_orderkey, arg_max(o_orderstatus, batch) as o_orderstatus, arg_max(price, batch) as price, max(batch) as batch
from (select o_orderkey, o_orderstatus, o_totalprice as price, 1 as batch from orders where o_orderkey % 4 > 0 union all {_TAKEN} )
group by o_orderkey having not (max(batch) = 2 and arg_max(o_orderstatus, batch) = 'P')
""")
def merge_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    old = rows.where("o_orderkey % 4 > 0").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.lit(1).alias("batch"))
    new = rows.where("o_orderkey % 4 < 2").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 2, 2).alias("price"), F.lit(2).alias("batch"))
    return merge.merge_upsert(old, new, ["o_orderkey"], deleted=F.col("o_orderstatus") == "P")


@query("""
select o_orderkey, cast(o_orderdate as date) as batch_date from orders
where cast(o_orderdate as date) >= (select max(cast(o_orderdate as date)) from orders) - interval 60 day
""")
def lookback_window(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("batch_date"))
    return merge.lookback(rows, rows.agg(F.max("batch_date")).first()[0])


# ---------------------------------------------------------------- history

_VERSIONS = """
v as (
  select user_id, event_type, ts, event_id, lag(event_type) over w as before, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)
), h as (
  select user_id, event_type, ts as valid_from, event_id from v where k = 1 or event_type is distinct from before
), x as (
  select user_id, event_type, valid_from, lead(valid_from) over (partition by user_id order by valid_from, event_id) as valid_to, event_id from h
)"""


def _history(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return scd2.history_of_changes(rows, ["user_id"], ["event_type"], ["ts", "event_id"], "ts")


@query(f"with {_VERSIONS} select user_id, event_type, event_id, cast(valid_from as date) as from_date, cast(valid_to as date) as to_date, valid_to is null as is_current from x")
def scd2_history(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.select("user_id", "event_type", "event_id", F.col("valid_from").cast("date").alias("from_date"), F.col("valid_to").cast("date").alias("to_date"), F.col("valid_to").isNull().alias("is_current"))


@query(f"""
with {_VERSIONS}
select user_id, count(*) as total_versions, count(*) filter (valid_to is null) as open_versions, max(cast(valid_from as date)) as newest from x group by user_id
""")
def scd2_as_of(spark, sf_dir):
    v = scd2.as_of_view(_history(spark, sf_dir), ["user_id"])
    return v.groupBy("user_id").agg(F.max("total_versions").alias("total_versions"), F.count_if("is_current").alias("open_versions"), F.max("valid_from").alias("newest"))


@query(f"""
with {_VERSIONS}
select user_id, event_id, row_number() over (partition by user_id order by valid_from) as version_number, count(*) over (partition by user_id) as total_versions from x
""")
def scd2_version_numbers(spark, sf_dir):
    return scd2.as_of_view(_history(spark, sf_dir), ["user_id"]).select("user_id", "event_id", F.col("version_number").cast("long").alias("version_number"), "total_versions")


@query(f"with {_VERSIONS} select user_id, event_type from x where valid_from <= timestamp '2024-01-15' and (valid_to is null or valid_to > timestamp '2024-01-15')")
def point_in_time_lookup(spark, sf_dir):
    at = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    return _history(spark, sf_dir).where(asof.point_in_time(at, F.col("valid_from"), F.col("valid_to"))).select("user_id", "event_type")


@query(f"""
with {_VERSIONS}, b as (
  select user_id, event_id, valid_from, case when event_id % 7 = 0 then valid_to + interval 40 day when event_id % 7 = 1 then valid_from - interval 1 hour when event_id % 701 = 2 then null else valid_to end as e from x where valid_to is not null
), r as (select *, row_number() over (partition by user_id order by valid_from, e nulls last) as k from b)
select i.user_id, i.event_id, case when i.e < i.valid_from then 'inverted' else 'overlap' end as problem
from r i where i.e < i.valid_from or ((i.e is null or i.e > i.valid_from) and exists (
  select 1 from r j where j.user_id = i.user_id and j.k < i.k and (j.e is null or (j.e > j.valid_from and j.e > i.valid_from))))
""")
def scd2_overlap_sweep(spark, sf_dir):
    """Every version inside a longer earlier one, found in one sweep; some versions last long or never end."""
    h = _history(spark, sf_dir).where("valid_to is not null")
    ends = "case when event_id % 7 = 0 then valid_to + interval 40 day when event_id % 7 = 1 then valid_from - interval 1 hour when event_id % 701 = 2 then null else valid_to end"
    return scd2.overlapping_windows(h.withColumn("valid_to", F.expr(ends)), ["user_id"]).select("user_id", "event_id", "problem")


@query(f"""
with {_VERSIONS}, b as (select *, case when event_id % 10 = 0 then valid_to + interval 1 hour when event_id % 10 = 1 then valid_from - interval 1 hour else valid_to end as e from x where valid_to is not null),
n as (select *, lead(valid_from) over (partition by user_id order by valid_from, event_id) as nxt from b)
select case when e < valid_from then 'inverted' else 'overlap' end as problem, count(*) as n from n where e < valid_from or (nxt is not null and e > nxt) group by 1
""")
def scd2_overlaps(spark, sf_dir):
    h = _history(spark, sf_dir).where("valid_to is not null")
    spoilt = h.withColumn("valid_to", F.expr("case when event_id % 10 = 0 then valid_to + interval 1 hour when event_id % 10 = 1 then valid_from - interval 1 hour else valid_to end"))
    return scd2.overlapping_windows(spoilt, ["user_id"], adjacent=True).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
with old as (select c_custkey as k, c_mktsegment as seg from customer where c_custkey % 5 > 0),
new as (select c_custkey as k, case when c_custkey % 2 = 0 then c_mktsegment else 'MOVED' end as seg from customer where c_custkey % 7 > 0),
j as (select coalesce(old.k, new.k) as k, old.seg as a, new.seg as b, old.k is not null as ho, new.k is not null as hn from old full join new on old.k = new.k)
select k, a as seg, date '2024-01-01' as valid_from, case when not hn or a <> b then date '2024-02-01' end as valid_to from j where ho
union all select k, b, date '2024-02-01', null from j where hn and (not ho or a <> b)
""")
def scd2_snapshot(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    start = F.lit(dt.date(2024, 1, 1))
    old = rows.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    new = rows.where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("MOVED").alias("seg"))
    return scd2.scd2_apply(old, new, ["k"], ["seg"], dt.date(2024, 2, 1))


# ---------------------------------------------------------------- premium and marts


#: Policies that a task takes at once with all their months, so that its memory does not follow the input.
POLICIES_A_TASK = 1 << 17


def _tasks(spark, sf_dir) -> int:
    """Into how many tasks the orders go; their number stands in the files' footers."""
    return max(1, -(-read(spark, sf_dir, "orders").count() // POLICIES_A_TASK))


def _by_policy(rows: DataFrame, tasks: int, key: str) -> DataFrame:
    """rows dealt by their policy: joins, windows and aggregates within a policy need no further shuffle."""
    return rows.repartition(tasks, key)


def _policies(spark, sf_dir):
    """Orders as one-year policies; cancelled if an item came back on or after inception."""
    day = F.col("o_orderdate").cast("date")
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("policy_id"), day.alias("inception_date"), F.date_add(day, 365).alias("expiry_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("written_premium_thb"), F.lit(365).alias("term_days")
    )
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_shipdate").cast("date").alias("effective_date"))
    tasks = _tasks(spark, sf_dir)
    orders, back = _by_policy(orders, tasks, "policy_id"), _by_policy(back, tasks, "l_orderkey")
    paid = orders.select("policy_id", "inception_date").join(back, F.col("policy_id") == F.col("l_orderkey")).where("effective_date >= inception_date")
    paid = paid.select("policy_id", "effective_date", F.lit(True).alias("is_refund"))
    refunded = paid.select(F.col("policy_id").alias("_p")).distinct()
    policies = orders.join(refunded, F.col("policy_id") == F.col("_p"), "left").withColumn("policy_status", F.when(F.col("_p").isNotNull(), "CANCELLED").otherwise("ACTIVE")).drop("_p")
    return policies, paid


@query("""
with p as (
  select o_orderkey as id, cast(o_orderdate as date) as inc, cast(o_totalprice as decimal(18, 2)) as prem,
         (select min(cast(l_shipdate as date)) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and cast(l_shipdate as date) >= cast(o_orderdate as date)) as refund
  from orders
), e as (
  select id, inc, prem, least(cast(inc + interval 365 day as date), date '2001-08-01', refund) as fin from p
), d as (
  select id, prem, date_trunc('month', unnest(generate_series(inc::timestamp, fin::timestamp - interval 1 day, interval 1 day))) as m from e where fin > inc
), c as (
  select id, any_value(prem) as prem, cast(m as date) as month_start, count(*) as n from d group by id, m
)
select month_start, count(distinct id) as policies, cast(sum(n) as bigint) as days_on_risk,
       cast(sum(cast(round(cast(prem * n as decimal(30, 8)) / 365, 2) * 100 as bigint)) as bigint) as earned_cents
from c group by month_start
""")
def earned_monthly(spark, sf_dir):
    policies, paid = _policies(spark, sf_dir)
    cells = exposure.earned_cells(exposure.with_first_months(exposure.at_risk(policies, paid, AS_OF)))
    return cells.groupBy("month_start").agg(
        F.count_if(exposure.is_first()).alias("policies"), F.sum("days_on_risk").cast("bigint").alias("days_on_risk"), F.sum((F.col("earned_premium_thb") * 100).cast("bigint")).alias("earned_cents")
    )


@query("""
select strftime(cast(o_orderdate as date), '%Y-%m') as written_year_month, count(*) as policies, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as written_cents,
       min(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::integer as first_key
from orders group by 1
""")
def written_premium(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("inception_date", F.col("o_orderdate").cast("date"))
    w = exposure.written_premium(rows)
    return w.groupBy("written_year_month").agg(F.count("*").alias("policies"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("written_cents"), F.min("inception_date_key").alias("first_key"))


def _claims(spark, sf_dir):
    """Line items as claims of the orders; those of every eleventh order have lost theirs."""
    rows = read(spark, sf_dir, "lineitem")
    lost = F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"),
        lost.alias("policy_id"), F.col("l_shipdate").cast("date").alias("loss_date"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_quantity") % 40).cast("int")).alias("reported_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("gross_incurred_thb"), (F.floor(F.round(F.col("l_extendedprice") * 100) / 2).cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("paid_amount_thb"),
    )


def _policy_dim(spark, sf_dir):
    return _orders_in_currency(spark, sf_dir).select(
        F.col("o_orderkey").alias("policy_id"), F.col("currency").alias("country"), F.col("o_orderdate").alias("inception_date"), F.date_add("o_orderdate", 365).alias("expiry_date"),
        F.col("o_orderpriority").alias("product_code"), F.col("o_orderstatus").alias("partner_code"), F.col("amount").alias("written_premium_thb"),
    )


_CLAIMS_SQL = """
pol as (
  select o_orderkey as policy_id, case when n_regionkey = 0 then 'THB' else 'CUR' || n_regionkey end as country, o_orderpriority as product_code, o_orderstatus as partner_code,
         cast(o_orderdate as date) as inception_date, cast(cast(o_orderdate as date) + interval 365 day as date) as expiry_date
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
), cl as (
  select case when l_orderkey % 11 = 0 then -l_orderkey else l_orderkey end as policy_id, cast(l_shipdate as date) as loss_date, cast(cast(l_quantity as bigint) % 40 as integer) as lag,
         cast(l_extendedprice as decimal(18, 2)) as gross, cast(cast(round(l_extendedprice * 100) as bigint) // 2 / 100 as decimal(18, 2)) as paid
  from lineitem
), f as (
  select cl.*, pol.country, pol.product_code, pol.partner_code, strftime(loss_date, '%Y-%m') as ym, lag >= 21 as late, pol.policy_id is null as orphan,
         pol.policy_id is not null and (loss_date < inception_date or loss_date > expiry_date) as outside
  from cl left join pol on cl.policy_id = pol.policy_id
)"""


def _facts(spark, sf_dir):
    return marts.claims_fact(marts.with_lag(_claims(spark, sf_dir)), _policy_dim(spark, sf_dir))


@query(f"""
with {_CLAIMS_SQL} select ym as loss_year_month, count(*) as claims, count(*) filter (orphan) as orphans, count(*) filter (outside) as outside, count(*) filter (late) as late,
 cast(sum(cast(gross * 100 as bigint)) as bigint) as cents from f group by 1
""")
def claims_fact_flags(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("loss_year_month").agg(
        F.count("*").alias("claims"), F.count_if("is_orphan").alias("orphans"), F.count_if("is_outside_coverage").alias("outside"), F.count_if("is_late_reported").alias("late"),
        F.sum((F.col("gross_incurred_thb") * 100).cast("bigint")).alias("cents"),
    )


@query(f"""
with {_CLAIMS_SQL}, g as (select ym, country, product_code, list(lag order by lag) as l, sum(lag) as s, count(*) filter (late) as late, count(*) filter (lag > 60) as beyond,
  cast(sum(case when late then cast(gross * 100 as bigint) else 0 end) as bigint) as late_cents, max(loss_date) as last from f where not orphan and lag is not null group by all)
select ym as loss_year_month, country, product_code, len(l)::bigint as claim_count, round(s / len(l), 1)::double as avg_lag_days, l[1] as min_lag_days, l[len(l)] as max_lag_days,
  l[greatest(1, ceil(0.5 * len(l)))::bigint] as p50_lag_days, l[greatest(1, ceil(0.9 * len(l)))::bigint] as p90_lag_days,
  l[greatest(1, ceil(0.95 * len(l)))::bigint] as p95_lag_days, l[greatest(1, ceil(0.99 * len(l)))::bigint] as p99_lag_days,
  late as late_reported_count, round(late / len(l), 4)::double as late_reported_pct, beyond as beyond_lookback_window, late_cents as late_reported_cents,
  last + l[len(l)] > date '2001-08-01' - 60 as claims_still_developing
from g
""")
def claims_lag_mart(spark, sf_dir):
    m = marts.claims_lag(_facts(spark, sf_dir), 60, AS_OF)
    return m.withColumn("late_reported_cents", (F.col("late_reported_incurred_thb") * 100).cast("bigint")).drop("late_reported_incurred_thb")


@query(f"""
with {_CLAIMS_SQL}, ex as (
  select country, product_code, partner_code, policy_id, date_trunc('month', unnest(generate_series(inception_date::timestamp, least(expiry_date, date '2001-08-01')::timestamp - interval 1 day, interval 1 day))) as m
  from pol where inception_date < date '2001-08-01'
), cells as (
  select country, product_code, partner_code, policy_id, cast(m as date) as month_start, count(*) as n from ex group by all
), pr as (select o_orderkey, cast(o_totalprice as decimal(18, 2)) as prem from orders), e as (
  select month_start, country, partner_code, product_code, count(distinct policy_id) as policies_on_risk,
         sum(round(cast(prem * n as decimal(30, 8)) / 365, 2)::decimal(18, 2)) as earned, sum(round(n / 365.25, 6)::decimal(18, 6)) as years
  from cells join pr on policy_id = o_orderkey group by all
), c as (
  select ym, country, partner_code, product_code, count(*) as n, sum(gross) as inc, sum(paid) as paid, count(*) filter (late) as late from f where not orphan group by all
)
select strftime(e.month_start, '%Y-%m') as year_month, e.country, e.partner_code, e.product_code, policies_on_risk, earned::double as earned_premium_thb, years::double as exposure_policy_years,
  coalesce(c.n, 0) as claim_count, coalesce(inc, 0)::double as incurred_thb, coalesce(paid, 0)::double as paid_thb, coalesce(late, 0) as late_reported_claims,
  case when earned > 0 then ((20000 * cast(coalesce(inc, 0) * 100 as hugeint) + cast(earned * 100 as hugeint)) // (2 * cast(earned * 100 as hugeint)))::double / 10000 end as loss_ratio,
  case when years > 0 then ((20000000000::hugeint * coalesce(c.n, 0)::hugeint + cast(years * 1000000 as hugeint)) // (2 * cast(years * 1000000 as hugeint)))::double / 10000 end as claim_frequency,
  case when c.n > 0 then ((2 * cast(inc * 100 as hugeint) + c.n) // (2 * c.n))::double / 100 end as claim_severity_thb,
  years >= 5 and coalesce(c.n, 0) >= 3 as is_credible, case when years < 1 then 'very_low' when years < 5 then 'low' when years < 25 then 'partial' else 'full' end as credibility_band
from e left join c on c.ym = strftime(e.month_start, '%Y-%m') and c.country = e.country and c.partner_code = e.partner_code and c.product_code = e.product_code
""")
def loss_ratio_mart(spark, sf_dir):
    dim = _policy_dim(spark, sf_dir).withColumns({"term_days": F.lit(365), "policy_status": F.lit("ACTIVE")})
    none = spark.createDataFrame([], "policy_id long, effective_date date, is_refund boolean")
    m = marts.loss_ratio(exposure.earned_premium(dim, none, AS_OF), _facts(spark, sf_dir))
    amounts = ["earned_premium_thb", "exposure_policy_years", "incurred_thb", "paid_thb", "loss_ratio", "claim_frequency", "claim_severity_thb"]
    return m.select("year_month", "country", "partner_code", "product_code", "policies_on_risk", "claim_count", "late_reported_claims", "is_credible", "credibility_band", *[F.col(c).cast("double").alias(c) for c in amounts])


@query(f"""
with {_CLAIMS_SQL}, g as (select country, list(lag order by lag) as l, sum(lag) as s, count(*) filter (late) as late from f where not orphan and lag is not null group by all)
select country, len(l)::bigint as claim_count, round(s / len(l), 1)::double as avg_lag_days, l[greatest(1, ceil(0.5 * len(l)))::bigint] as p50_lag_days, l[greatest(1, ceil(0.9 * len(l)))::bigint] as p90_lag_days,
  l[greatest(1, ceil(0.95 * len(l)))::bigint] as p95_lag_days, l[greatest(1, ceil(0.99 * len(l)))::bigint] as p99_lag_days, late as late_reported_count
from g
""")
def claims_lag_rollup(spark, sf_dir):
    """Percentiles per country from the stored states of two batches of claims, without going back to the claims."""
    facts, batch = _facts(spark, sf_dir), F.crc32(F.col("claim_id").cast("binary")) % 2
    states = [marts.claims_lag_state(facts.where(batch == b)) for b in (0, 1)]
    m = marts.claims_lag_of(states[0].unionByName(states[1]), 60, AS_OF, ["country"])
    return m.select("country", "claim_count", "avg_lag_days", *[f"p{p}_lag_days" for p in (50, 90, 95, 99)], "late_reported_count")


@query(f"""
with {_CLAIMS_SQL}, ex as (
  select country, product_code, policy_id, date_trunc('month', unnest(generate_series(inception_date::timestamp, least(expiry_date, date '2001-08-01')::timestamp - interval 1 day, interval 1 day))) as m
  from pol where inception_date < date '2001-08-01'
)
select cast(date_trunc('quarter', m) as date) as quarter, country, product_code, count(distinct policy_id) as policies_on_risk from ex group by all
""")
def policies_on_risk_quarterly(spark, sf_dir):
    """Different policies on risk per quarter, country and product, rolled up from the months of each policy."""
    dim = _by_policy(_policy_dim(spark, sf_dir), _tasks(spark, sf_dir), "policy_id").withColumns({"term_days": F.lit(365), "policy_status": F.lit("ACTIVE")})
    none = spark.createDataFrame([], "policy_id long, effective_date date, is_refund boolean")
    state = marts.policies_on_risk(exposure.earned_premium(dim, none, AS_OF))
    counts = rollup.span_counts(state, ["country", "product_code"], "policy_id", 3, "quarter", "policies_on_risk")
    return counts.select("quarter", "country", "product_code", "policies_on_risk")


@query(f"""
with {_CLAIMS_SQL}, ex as (
  select policy_id, date_trunc('month', unnest(generate_series(inception_date::timestamp, least(expiry_date, date '2001-08-01')::timestamp - interval 1 day, interval 1 day))) as m
  from pol where inception_date < date '2001-08-01'
), cells as (select policy_id, m, count(*) as n from ex group by all),
per as (
  select policy_id, sum(round(cast(cast(o_totalprice as decimal(18, 2)) * n as decimal(30, 8)) / 365, 2)::decimal(18, 2)) as earned,
         max(cast(o_totalprice as decimal(18, 2)) * case when policy_id % 10 = 3 then 0.5 else 1 end) as written
  from cells join orders on policy_id = o_orderkey group by all
)
select 'earned_within_written' as test, 'error' as severity, count(*) filter (earned > written + greatest(1.0, written / 1000)) as failures from per
union all select 'premium_not_negative', 'error', (select count(*) from lineitem where l_extendedprice - 20000 < 0 and not (l_returnflag = 'R'))
""")
def premium_checks(spark, sf_dir):
    """No policy earns more than was written, no payment but a refund is negative; a tenth of the policies and some payments break it."""
    dim = _policy_dim(spark, sf_dir).withColumns({"term_days": F.lit(365), "policy_status": F.lit("ACTIVE")})
    none = spark.createDataFrame([], "policy_id long, effective_date date, is_refund boolean")
    earned = exposure.earned_premium(dim, none, AS_OF)
    less = F.when(F.col("policy_id") % 10 == 3, F.lit(0.5)).otherwise(F.lit(1.0)).cast("decimal(2,1)")
    payments = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") - 20000).alias("amount"), (F.col("l_returnflag") == "R").alias("is_refund"))
    return quality.summary([quality.earned_within_written(earned.withColumn("written_premium_thb", F.col("written_premium_thb") * less)), quality.premium_not_negative(payments)])


@query("""
select strftime(ts, '%Y-%m') as quote_year_month, event_type as channel, user_id % 5 as partner, count(*) as quotes_issued, count(*) filter (value > 50) as quotes_converted,
  round(count(*) filter (value > 50) / count(*), 4)::double as conversion_rate, count(*) filter (event_id % 10 = 0) as quotes_rejected, count(*) filter (event_id % 10 = 1) as quotes_expired
from events group by all
""")
def conversion_mart(spark, sf_dir):
    status = F.when(F.col("event_id") % 10 == 0, "REJECTED").when(F.col("event_id") % 10 == 1, "EXPIRED").otherwise("ISSUED")
    quotes = read(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("quoted_date"), F.lit("TH").alias("country"), (F.col("user_id") % 5).alias("partner_code"), F.lit("X").alias("product_code"), F.col("event_type").alias("channel"),
        status.alias("quote_status"), (F.col("value") > 50).alias("did_convert"), F.col("value").cast("decimal(18,2)").alias("quoted_premium"),
    )
    products = spark.createDataFrame([("X", "x", "c")], "product_code string, product_name_en string, cover_class string")
    m = marts.quote_conversion(quotes, products)
    return m.select("quote_year_month", "channel", F.col("partner_code").alias("partner"), "quotes_issued", "quotes_converted", "conversion_rate", "quotes_rejected", "quotes_expired")


@query("""
select cast(d as date) as date_day, (year(d) * 10000 + month(d) * 100 + day(d))::integer as date_key, year(d)::integer as calendar_year, (year(d) + 543)::integer as buddhist_year, quarter(d)::integer as calendar_quarter,
  month(d)::integer as calendar_month, strftime(d, '%b') as month_name, cast(date_trunc('month', d) as date) as month_start, last_day(d) as month_end, strftime(d, '%Y-%m') as year_month,
  (dayofweek(d) + 1)::integer as day_of_week, dayofweek(d) in (0, 6) as is_weekend, cast(d as date) = last_day(d) as is_month_end
from (select min(cast(o_orderdate as date)) - 30 as a, max(cast(o_orderdate as date)) + 400 as b from orders), generate_series(a::timestamp, b::timestamp, interval 1 day) as g(d)
""")
def date_dim(spark, sf_dir):
    lo, hi = read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    return marts.date_dim(spark, lo - dt.timedelta(30), hi + dt.timedelta(400))


# ---------------------------------------------------------------- data quality


@query("""
select 'unique' as test, 'error' as severity, (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))::bigint as failures
union all select 'not_null', 'warn', (select count(*) from orders where o_orderkey % 9 = 0)
union all select 'accepted_values', 'error', (select count(*) from orders where o_orderstatus = 'P')
union all select 'relationships', 'warn', (select count(*) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0))
union all select 'accepted_range', 'error', (select count(*) from lineitem where l_discount < 0.02 or l_discount > 0.08)
union all select 'expression', 'error', (select count(*) from lineitem where l_linestatus = 'O' and not l_quantity > 5)
""")
def dq_suite(spark, sf_dir):
    orders, lines, customers = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    tests = [
        quality.unique(lines, ["l_orderkey", "l_linenumber"]),
        quality.not_null(orders.withColumn("x", F.when(F.col("o_orderkey") % 9 != 0, 1)), "x", severity="warn"),
        quality.accepted_values(orders, "o_orderstatus", ["F", "O"]),
        quality.relationships(orders, "o_custkey", customers.where("c_custkey % 2 = 0"), "c_custkey", severity="warn"),
        quality.accepted_range(lines, "l_discount", 0.02, 0.08),
        quality.expression(lines, "l_quantity > 5", where="l_linestatus = 'O'"),
    ]
    return quality.summary(tests)


@query("""
select case when event_id % 13 = 0 then 'unparseable_record' when event_id % 17 = 0 then 'missing_primary_key' else 'landed' end as reason, count(*) as n from events group by 1
""")
def quarantine_split(spark, sf_dir):
    from lakewright.sources.bronze import quarantine_reason

    rows = read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 == 0, F.lit("{not json")).alias("_corrupt_record"), F.when(F.col("event_id") % 17 == 0, F.lit("  ")).otherwise(F.col("event_id").cast("string")).alias("event_id")
    )
    return rows.groupBy(F.coalesce(quarantine_reason(rows.columns, ["event_id"]), F.lit("landed")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
select event_type, case when hours > 50 then 'error' when hours > 26 then 'warn' else 'pass' end as status
from (select event_type, datediff('hour', max(ts), timestamp '2024-02-01') as hours from events group by 1)
""")
def freshness(spark, sf_dir):
    return quality.freshness(read(spark, sf_dir, "events"), "ts", dt.datetime(2024, 2, 1), 26, 50, by=["event_type"]).select("event_type", "status")


# ---------------------------------------------------------------- KPI intake


@query("""
select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') is not null as has_k from events
""")
def kpi_json_validate(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return kpi.validate_json(rows, "props", "k bigint").select("event_id", F.col("record.k").alias("k"), F.col("record.k").isNotNull().alias("has_k"))


@query("""
select company, case when arg_max(state, seq) = 'draft' then arg_max(value, seq) end as draft_value, max(seq) as seq
from (select user_id as company, event_id as seq, value, case when event_type in ('click', 'view') then 'draft' else 'finalized' end as state from events) group by company
""")
def kpi_latest_draft(spark, sf_dir):
    state = F.when(F.col("event_type").isin("click", "view"), "draft").otherwise("finalized")
    reports = read(spark, sf_dir, "events").select(F.col("user_id").alias("company"), F.col("event_id").alias("seq"), "value", state.alias("state"))
    return kpi.latest_draft(reports, ["company"], ["value"]).select("company", F.col("value").alias("draft_value"), "seq")


@query("""
with m as (select user_id as company, date_trunc('week', ts) as period, sum(cast(round(value * 100) as bigint)) as revenue from events group by all),
l as (select *, lag(revenue) over (partition by company order by period) as before from m)
select company, cast(period as date) as period, cast(revenue as bigint) as revenue, before is not null and before > 0 and revenue < before * 0.6 as revenue_drop from l
""")
def kpi_anomalies(spark, sf_dir):
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    m = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company"), week.alias("period")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("revenue"))
    return kpi.anomalies(m, ["company"], "period").select("company", "period", "revenue", "revenue_drop")


# ---------------------------------------------------------------- shared shapes: top-k, totals, scalar subqueries


@query("select p_partkey, p_retailprice from part order by p_retailprice desc nulls last, p_partkey limit 10")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "part").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("""
select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents,
  min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day
from lineitem group by all having count(*) > 10
""")
def grouped_totals(spark, sf_dir):
    return (
        read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
             F.min(F.col("l_shipdate").cast("date")).alias("first_day"), F.max(F.col("l_shipdate").cast("date")).alias("last_day"))
        .where("n > 10")
    )


@query("""
select (select count(*) from lineitem) as n_lines, (select count(*) from orders) as n_orders,
  (select sum(cast(round(o_totalprice * 100) as bigint)) // count(*) from orders) as guarded, cast(-1 as bigint) as guarded_over_none
""")
def scalar_totals(spark, sf_dir):
    """Counts, and a ratio guarded against an empty divisor: over all orders, and over those of a status none has."""
    lines = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_lines"))
    cents, none = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_orderstatus") == "none"
    guarded = lambda n: F.coalesce(F.floor(F.sum(cents) / F.nullif(n, F.lit(0))).cast("bigint"), F.lit(-1))
    orders = read(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"), guarded(F.count("*")).alias("guarded"), guarded(F.count_if(none)).alias("guarded_over_none"))
    return lines.join(orders, F.lit(True))