"""The layered models as queries: raw feeds made from the driver tables, each with an independent SQL form.

Feeds have the form files land in: all columns text, with the landing metadata beside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright import governance
from lakewright.operators import asof
from lakewright.plans import models
from lakewright.plans.catalogue import _RATES_SQL, AS_OF, _rates, query, read
from lakewright.sources.tablestore import Table
from lakewright.streaming import windowed_counts

_AT = dt.datetime(2001, 8, 1)


def built(spark, name: str, *inputs: DataFrame) -> DataFrame:
    """A model over given inputs, with the run parameters that all queries here share."""
    return models.MODELS[name].build(models.Run(spark, "", lambda n: None, AS_OF, _AT, salt="pepper"), *inputs)


def feed(rows: DataFrame, file: Column | str = "landing/x.csv", at: Column | None = None, **columns: Column) -> DataFrame:
    """rows as a landed feed: the columns as text, and metadata."""
    meta = {"_ingested_at": at if at is not None else F.lit(_AT), "_batch_date": F.lit(AS_OF), "_source_file": F.lit(file) if isinstance(file, str) else file}
    out = rows.select(*[c.cast("string").alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in meta.items()])
    return out.withColumn("_record_hash", F.sha2(F.to_json(F.struct(*columns)), 256))


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# ---------------------------------------------------------------- customers, vehicles, reference data


def _phone(k: Column) -> Column:
    return F.concat(F.lit("08"), (k % 10).cast("string"), F.lit("-"), (k * 31).cast("string"))


def _customers(spark, sf_dir):
    """Every thousandth key comes again, later; the later record counts."""
    k = F.col("c_custkey")
    return feed(
        read(spark, sf_dir, "customer"),
        customer_id=F.concat(F.lit(" c"), (k % 1000).cast("string"), F.lit(" ")), first_name=F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit("   "))), last_name=F.col("c_mktsegment"),
        national_id=k * 7919, email=F.concat(F.lit("u"), k.cast("string"), F.lit("@x"), (k % 9).cast("string"), F.lit(".org")), phone=_phone(k), address=F.lit("  "),
        province=F.col("c_mktsegment"), country=F.when(k % 3 == 0, "th").otherwise("id"), date_of_birth=F.date_add(F.lit(dt.date(1950, 1, 1)), (k % 18000).cast("int")), created_at=F.date_add(F.lit(dt.date(1990, 1, 1)), k.cast("int")),
    )


_CUSTOMERS_SQL = """
cust as (
  select 'C' || (c_custkey % 1000) as customer_id, trim(regexp_replace(replace(c_name, '#', '   '), '\\s+', ' ', 'g')) as first_name, c_mktsegment as last_name, cast(c_custkey * 7919 as varchar) as national_id,
    'u' || c_custkey || '@x' || (c_custkey % 9) || '.org' as email, '08' || (c_custkey % 10) || '-' || (c_custkey * 31) as phone, cast(null as varchar) as address, c_mktsegment as province,
    case when c_custkey % 3 = 0 then 'TH' else 'ID' end as country, date '1950-01-01' + cast(c_custkey % 18000 as integer) as date_of_birth, date '1990-01-01' + cast(c_custkey as integer) as created_date
  from customer qualify row_number() over (partition by c_custkey % 1000 order by c_custkey desc) = 1
)"""


@query(f"with {_CUSTOMERS_SQL} select * from cust")
def stg_customers(spark, sf_dir):
    return built(spark, "stg_customers", _customers(spark, sf_dir)).select("customer_id", "first_name", "last_name", "national_id", "email", "phone", "address", "province", "country", "date_of_birth", "created_date")


@query(f"""
with {_CUSTOMERS_SQL}, aged as (select *, cast(floor(datediff('day', date_of_birth, date '2001-08-01') / 365.25) as integer) as age from cust)
select customer_id, left(first_name, 1) || '.' as first_name_masked, left(last_name, 1) || '.' as last_name_masked, sha256('pepper' || national_id) as national_id_hash,
  left(email, 1) || '***@' || split_part(email, '@', 2) as email_masked, case when length(phone) < 6 then '***' else left(phone, 3) || '****' || right(phone, 2) end as phone_masked, address as address_masked, year(date_of_birth) || '-01-01' as birth_year,
  province, country, age as age_years, case when age < 25 then '18-24' when age < 35 then '25-34' when age < 45 then '35-44' when age < 55 then '45-54' when age < 65 then '55-64' else '65+' end as age_band, created_date
from aged
""")
def dim_customer(spark, sf_dir):
    return built(spark, "dim_customer", built(spark, "stg_customers", _customers(spark, sf_dir)))


@query(f"""
with {_CUSTOMERS_SQL}, m as (select left(first_name, 1) || '.' as n, left(email, 1) || '***@' || split_part(email, '@', 2) as e, case when length(phone) < 6 then '***' else left(phone, 3) || '****' || right(phone, 2) end as p, phone from cust)
select count(*) as masked, count(*) filter (n not like '_.') as names, count(*) filter (e not like '_***@%') as emails, count(*) filter (p not like '___****__' and p not like '***') as phones, count(*) filter (p like '%' || phone || '%') as leaks from m
""")
def mask_leaks(spark, sf_dir):
    """Masked values that do not have the form their mask gives, by LIKE."""
    raw = built(spark, "stg_customers", _customers(spark, sf_dir))
    both = built(spark, "dim_customer", raw).join(raw.select("customer_id", "phone"), "customer_id")
    return both.agg(
        F.count("*").alias("masked"), F.count_if(~F.col("first_name_masked").like("_.")).alias("names"), F.count_if(~F.col("email_masked").like("_***@%")).alias("emails"),
        F.count_if(~F.col("phone_masked").like("___****__") & ~F.col("phone_masked").like("***")).alias("phones"), F.count_if(F.expr("phone_masked like concat('%', phone, '%')")).alias("leaks"),
    )


def _vehicles(spark, sf_dir):
    k = F.col("p_partkey")
    return feed(
        read(spark, sf_dir, "part"), vehicle_id=F.concat(F.lit("v"), k.cast("string")), customer_id=F.concat(F.lit("c"), (k % 1000).cast("string")), plate_no=F.concat(F.lit("AB "), k.cast("string")), plate_province=F.lit(""),
        make=F.col("p_brand"), model=F.col("p_type"), chassis_no=F.concat(F.lit("CH"), k.cast("string")), manufacture_year=F.lit(1985) + F.col("p_size") % 17, engine_cc=F.lit(800) + F.col("p_size") * 40,
        vehicle_value_local=F.col("p_retailprice").cast("decimal(18,2)"), country=F.lit("th"),
    )


_VEHICLES_SQL = """
veh as (
  select 'V' || p_partkey as vehicle_id, 'C' || (p_partkey % 1000) as customer_id, 'AB ' || p_partkey as plate_no, cast(null as varchar) as plate_province, trim(regexp_replace(p_brand, '\\s+', ' ', 'g')) as make,
    trim(regexp_replace(p_type, '\\s+', ' ', 'g')) as model, 'CH' || p_partkey as chassis_no, cast(1985 + p_size % 17 as integer) as manufacture_year, cast(800 + p_size * 40 as integer) as engine_cc,
    cast(cast(p_retailprice as decimal(18, 2)) as double) as vehicle_value_local, 'TH' as country
  from part
)"""


@query(f"with {_VEHICLES_SQL} select * from veh")
def stg_vehicles(spark, sf_dir):
    out = built(spark, "stg_vehicles", _vehicles(spark, sf_dir))
    return _double(out, "vehicle_value_local").select("vehicle_id", "customer_id", "plate_no", "plate_province", "make", "model", "chassis_no", "manufacture_year", "engine_cc", "vehicle_value_local", "country")


@query(f"""
with {_VEHICLES_SQL}, a as (select *, 2001 - manufacture_year as age from veh)
select vehicle_id, customer_id, case when length(plate_no) < 4 then '***' else '***' || right(plate_no, 2) end as plate_masked, plate_province, case when length(chassis_no) < 4 then '***' else '***' || right(chassis_no, 4) end as chassis_masked,
  make, model, make || ' ' || model as make_model, manufacture_year, age as vehicle_age_years, case when age <= 3 then '0-3' when age <= 7 then '4-7' when age <= 12 then '8-12' else '13+' end as vehicle_age_band,
  engine_cc, case when engine_cc <= 1500 then 'small' when engine_cc <= 2000 then 'medium' else 'large' end as engine_class, vehicle_value_local, country
from a
""")
def dim_vehicle(spark, sf_dir):
    return _double(built(spark, "dim_vehicle", built(spark, "stg_vehicles", _vehicles(spark, sf_dir))), "vehicle_value_local")


_CODES = ("MOTOR_CMI", "MOTOR_VOL_C1", "HEALTH_ADJ", "OTHER")


def _products(spark, sf_dir):
    """Four codes, each landed many times; the record of the latest landing counts."""
    k = F.col("p_partkey")
    code = F.get(F.lit(list(_CODES)), (k % 4).cast("int"))
    return feed(
        read(spark, sf_dir, "part"), at=F.timestamp_seconds(k), product_code=F.lower(code), product_name_en=F.concat(F.lit("Product "), k.cast("string")), product_name_th=F.lit(None), line_of_business=F.upper(F.substring(code, 1, 5)),
        cover_type=F.lit("X"), base_premium_local=F.col("p_retailprice").cast("decimal(18,2)"), default_sum_insured=k * 10,
    )


_PRODUCTS_SQL = f"""
prod as (
  select code as product_code, 'Product ' || p_partkey as product_name_en, cast(null as varchar) as product_name_th, lower(left(code, 5)) as line_of_business, 'x' as cover_type,
    cast(cast(p_retailprice as decimal(18, 2)) as double) as base_premium_local, cast(p_partkey * 10 as double) as default_sum_insured
  from (select *, {list(_CODES)}[1 + p_partkey % 4] as code from part) qualify row_number() over (partition by code order by p_partkey desc) = 1
)"""


@query(f"with {_PRODUCTS_SQL} select * from prod")
def stg_products(spark, sf_dir):
    out = _double(built(spark, "stg_products", _products(spark, sf_dir)), "base_premium_local", "default_sum_insured")
    return out.select("product_code", "product_name_en", "product_name_th", "line_of_business", "cover_type", "base_premium_local", "default_sum_insured")


@query(f"""
with {_PRODUCTS_SQL} select product_code, product_name_en, line_of_business, case product_code when 'MOTOR_CMI' then 'compulsory' when 'MOTOR_VOL_C1' then 'class_1' when 'HEALTH_ADJ' then 'health' end as cover_class, product_code = 'MOTOR_CMI' as is_compulsory from prod
""")
def dim_product(spark, sf_dir):
    return built(spark, "dim_product", built(spark, "stg_products", _products(spark, sf_dir))).select("product_code", "product_name_en", "line_of_business", "cover_class", "is_compulsory")


def _partners(spark, sf_dir):
    k = F.col("s_suppkey")
    return feed(
        read(spark, sf_dir, "supplier"), partner_code=F.concat(F.lit("s"), k.cast("string")), partner_name=F.col("s_name"), country=F.lit("id"), schema_variant=F.lit("a"), commission_rate=(k % 100).cast("decimal(9,4)") / 100,
        onboarded_date=F.when(k % 10 > 0, F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 900).cast("int")).cast("string")).otherwise("soon"),
    )


@query("""
select 'S' || s_suppkey as partner_code, trim(regexp_replace(s_name, '\\s+', ' ', 'g')) as partner_name, 'ID' as country, 'a' as schema_variant, cast((s_suppkey % 100) / 100 as double) as commission_rate, d as onboarded_date,
  datediff('day', d, date '2001-08-01') / cast(365.25 as double) as tenure_years
from (select *, case when s_suppkey % 10 > 0 then date '1995-01-01' + cast(s_suppkey % 900 as integer) end as d from supplier)
""")
def dim_partner(spark, sf_dir):
    """Over the staged partners; a date that is none is null."""
    return _double(built(spark, "dim_partner", built(spark, "stg_partners", _partners(spark, sf_dir))), "commission_rate", "tenure_years")


def _declarations(spark, sf_dir):
    k = F.col("c_custkey")
    return feed(
        read(spark, sf_dir, "customer"), declaration_id=F.concat(F.lit("d"), k.cast("string")), policy_id=F.concat(F.lit("p"), k.cast("string")), customer_id=F.concat(F.lit("c"), (k % 1000).cast("string")),
        declared_at=F.date_add(F.lit(dt.date(2000, 1, 1)), (k % 300).cast("int")), pre_existing_conditions=F.when(k % 4 == 0, "none").when(k % 4 == 1, " ").otherwise("asthma"), bmi_band=F.lit("25-30"),
    )


@query("""
select 'D' || c_custkey as declaration_id, 'P' || c_custkey as policy_id, date '2000-01-01' + cast(c_custkey % 300 as integer) as declared_date, case c_custkey % 4 when 0 then 'none' when 1 then null else 'asthma' end as pre_existing_conditions,
  case c_custkey % 4 when 0 then false when 1 then null else true end as has_declared_condition
from customer
""")
def stg_health_declarations(spark, sf_dir):
    return built(spark, "stg_health_declarations", _declarations(spark, sf_dir)).select("declaration_id", "policy_id", "declared_date", "pre_existing_conditions", "has_declared_condition")


@query("""
select 'P' || c_custkey as policy_id, 'C' || (c_custkey % 1000) as customer_id, date '2000-01-01' + cast(c_custkey % 300 as integer) as declared_date, cast(null as varchar) as pre_existing_conditions, cast(null as varchar) as bmi_band,
  cast(null as boolean) as has_declared_condition
from customer
""")
def dim_health_profile(spark, sf_dir):
    return built(spark, "dim_health_profile", built(spark, "stg_health_declarations", _declarations(spark, sf_dir)))


# ---------------------------------------------------------------- policies


def _currency(k: Column) -> Column:
    return F.when(k % 3 == 0, "THB").otherwise(F.concat(F.lit("CUR"), (k % 3).cast("string")))


_CURRENCY_SQL = "case when {k} % 3 = 0 then 'THB' else 'CUR' || ({k} % 3) end"
_STATUS = ("Active", "canceled", "???")


def _status(k: Column) -> Column:
    return F.get(F.lit(list(_STATUS)), (k % 3).cast("int"))


def _changes(spark, sf_dir):
    """Orders whose key is not 4 modulo 5: an insert, for every fourth an update, for every tenth a delete."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    events = F.filter(F.array(F.struct(F.lit("I").alias("op"), F.lit(0).alias("n")), F.when(k % 4 == 0, F.struct(F.lit("U").alias("op"), F.lit(10).alias("n"))), F.when(k % 10 == 0, F.struct(F.lit("D").alias("op"), F.lit(20).alias("n")))), lambda x: x.isNotNull())
    rows = read(spark, sf_dir, "orders").where(k % 5 != 4).withColumn("e", F.explode(events))
    return feed(
        rows, op=F.lower(F.col("e.op")), policy_id=F.concat(F.lit("p"), k.cast("string")), customer_id=F.concat(F.lit("c"), F.col("o_custkey").cast("string")), vehicle_id=F.lit(""), product_code=F.col("o_orderpriority"), partner_code=F.lit("OWN"),
        country=F.when(F.col("o_custkey") % 2 == 0, "th").otherwise("id"), currency=_currency(F.col("o_custkey")), ts=F.date_add(day, F.col("e.n")), inception_date=day, expiry_date=F.date_add(day, 365), status=_status(k),
        sum_insured=(F.col("o_totalprice").cast("decimal(18,2)") * 10), written_premium=F.col("o_totalprice").cast("decimal(18,2)") + F.col("e.n"),
    )


_CHANGES_SQL = f"""
ev as (
  select *, cast(o_orderdate as date) as day from orders, (values ('I', 0), ('U', 10), ('D', 20)) as e(op, n) where o_orderkey % 5 <> 4 and (op = 'I' or (op = 'U' and o_orderkey % 4 = 0) or (op = 'D' and o_orderkey % 10 = 0))
), cdc as (
  select op, 'P' || o_orderkey as policy_id, 'C' || o_custkey as customer_id, case when o_custkey % 2 = 0 then 'TH' else 'ID' end as country, {_CURRENCY_SQL.format(k="o_custkey")} as currency,
    cast(day + n as timestamp) as change_ts, day as inception_date, day + 365 as expiry_date, ['ACTIVE', 'CANCELLED', 'UNKNOWN'][1 + o_orderkey % 3] as policy_status,
    cast(o_totalprice as decimal(18, 2)) + n as written_premium, upper(o_orderpriority) as product_code
  from ev
)"""


@query(f"with {_CHANGES_SQL} select * replace (cast(written_premium as double) as written_premium) from cdc")
def stg_policies_cdc(spark, sf_dir):
    out = _double(built(spark, "stg_policies_cdc", _changes(spark, sf_dir)), "written_premium")
    return out.select("op", "policy_id", "customer_id", "country", "currency", "change_ts", "inception_date", "expiry_date", "policy_status", "written_premium", "product_code")


def _partner_policies(spark, sf_dir) -> list[DataFrame]:
    """Orders whose key is 3 or 4 modulo 5 in three feeds of own names and calendars; an older record of each seventh comes, too."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").where(k % 5 >= 3).withColumn("older", F.explode(F.when(k % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    thai = lambda d: F.concat_ws("/", F.dayofmonth(d), F.month(d), F.year(d) + 543)
    forms = {"partner_policies_a": lambda d: d.cast("string"), "partner_policies_b": thai, "partner_policies_c": lambda d: F.date_format(d, "d MMM yyyy")}
    out = []
    for i, (name, form) in enumerate(forms.items()):
        own = {"policy_id": F.concat(F.lit("p"), k.cast("string")), "national_id": F.lit(" 1 2 "), "product_code": F.col("o_orderpriority"), "inception": form(day), "expiry": form(F.date_add(day, 365)),
               "premium": F.when(F.col("older") == 1, F.lit("1.00")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), "insured": F.lit("oops"), "currency": _currency(F.col("o_custkey")),
               "plate_no": F.lit(None), "status": _status(k), "updated": F.date_sub(day, F.col("older"))}
        path = F.lit(f"/landing/partner_drops/p{i}/dt=2001-01-01/x.csv")
        out.append(feed(rows.where(k % 3 == i), path, **{models.POLICY_NAMES[name][n]: c for n, c in own.items()}))
    return out


_PARTNER_SQL = f"""
part_pol as (
  select 'P' || o_orderkey as policy_id, 'P' || (o_orderkey % 3) as partner_code, '1 2' as national_id, upper(o_orderpriority) as product_code, cast(o_orderdate as date) as inception_date, cast(o_orderdate as date) + 365 as expiry_date,
    cast(o_totalprice as decimal(18, 2)) as written_premium, {_CURRENCY_SQL.format(k="o_custkey")} as currency, ['ACTIVE', 'CANCELLED', 'UNKNOWN'][1 + o_orderkey % 3] as policy_status
  from orders where o_orderkey % 5 >= 3
)"""


@query(f"with {_PARTNER_SQL} select * replace (cast(written_premium as double) as written_premium), cast(null as double) as sum_insured from part_pol")
def stg_partner_policies(spark, sf_dir):
    out = _double(built(spark, "stg_partner_policies", *_partner_policies(spark, sf_dir)), "written_premium", "sum_insured")
    return out.select("policy_id", "partner_code", "national_id", "product_code", "inception_date", "expiry_date", "written_premium", "sum_insured", "currency", "policy_status")


def _spine(spark, sf_dir):
    return asof.fx_spine(_rates(spark, sf_dir))


_THB_SQL = "case when {c} = 'THB' then {a} else round(cast(cast({a} as decimal(20, 4)) * rate as decimal(38, 12)), 2) end"


@query(f"""
with {_RATES_SQL}, {_CHANGES_SQL}, {_PARTNER_SQL}, own as (select * from cdc qualify row_number() over (partition by policy_id order by change_ts desc) = 1), both_ as (
  select op, policy_id, customer_id, product_code, 'OWN' as partner_code, country, currency, inception_date, expiry_date, policy_status, written_premium, 'cdc' as record_source from own
  union all select 'I', policy_id, null, product_code, partner_code, case when currency = 'THB' then 'TH' else 'ID' end, currency, inception_date, expiry_date, policy_status, written_premium, 'partner' from part_pol
    where policy_id not in (select policy_id from cdc)
)
select b.* replace (cast(written_premium as double) as written_premium), cast({_THB_SQL.format(c="b.currency", a="written_premium")} as double) as written_premium_thb, 365 as term_days
from both_ b asof left join rates on b.currency = rates.from_currency and b.inception_date >= rates.rate_date
""")
def silver_policies(spark, sf_dir):
    """Newest change of each policy, deleted ones marked, and partner policies the change feed never had."""
    out = built(spark, "silver_policies", built(spark, "stg_policies_cdc", _changes(spark, sf_dir)), built(spark, "stg_partner_policies", *_partner_policies(spark, sf_dir)), _spine(spark, sf_dir))
    out = _double(out, "written_premium", "written_premium_thb")
    return out.select("op", "policy_id", "customer_id", "product_code", "partner_code", "country", "currency", "inception_date", "expiry_date", "policy_status", "written_premium", "record_source", "written_premium_thb", "term_days")


# ---------------------------------------------------------------- claims, payments, endorsements, quotes


def _internal_claims(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    loss = F.date_add(day, (k % 50).cast("int"))
    return feed(
        read(spark, sf_dir, "orders").where(k % 3 < 2), claim_id=F.concat(F.lit("i"), k.cast("string")), claim_no=F.concat(F.lit("n"), k.cast("string")), policy_id=F.concat(F.lit("p"), k.cast("string")), loss_date=loss,
        reported_date=F.date_add(loss, (k % 40).cast("int")), settled_date=F.lit("never"), claim_cause=F.lit(" rear   end "), claim_type=F.lit("od"), status=F.lit("open"), gross_incurred=F.col("o_totalprice").cast("decimal(18,2)"),
        paid_amount=F.lit("0.5"), reserve_amount=F.lit(""), currency=_currency(F.col("o_custkey")), at_fault=F.when(k % 2 == 0, "true").otherwise("no idea"), emitted_at=loss,
    )


def _partner_claims(spark, sf_dir) -> list[DataFrame]:
    """Two of three orders, of which one is an internal claim, too, and so stays out."""
    k, loss = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").where(k % 3 > 0)
    out = []
    for i, (_, names) in enumerate(models.CLAIM_NAMES.items()):
        own = {"claim_no": F.concat(F.lit("n"), k.cast("string")), "policy_id": F.concat(F.lit("p"), k.cast("string")), "loss": loss, "reported": F.date_add(loss, 30), "incurred": F.col("o_totalprice").cast("decimal(18,2)"),
               "currency": _currency(F.col("o_custkey")), "cause": F.lit("theft"), "status": F.lit("Closed")}
        out.append(feed(rows.where(F.floor(k / 3) % 3 == i), F.lit(f"/landing/partner_drops/p{i}/x.csv"), **{names[n]: c for n, c in own.items()}))
    return out


@query(f"""
with {_RATES_SQL}, b as (
  select case when own then 'I' else 'N' end || o_orderkey as claim_id, 'N' || o_orderkey as claim_no, 'P' || o_orderkey as policy_id, cast(o_orderdate as date) + case when own then cast(o_orderkey % 50 as integer) else 0 end as loss_date,
    case when own then 'rear end' else 'theft' end as claim_cause, case when own then 'OPEN' else 'CLOSED' end as claim_status, cast(o_totalprice as decimal(18, 2)) as gross_incurred, case when own then cast(0.5 as double) end as paid_amount,
    case when own and o_orderkey % 2 = 0 then true end as at_fault, {_CURRENCY_SQL.format(k="o_custkey")} as currency, case when own then cast(o_orderkey % 40 as integer) else 30 end as reporting_lag_days,
    case when own then 'internal' else 'partner' end as record_source
  from (select *, o_orderkey % 3 < 2 as own from orders)
)
select b.* replace (cast(gross_incurred as double) as gross_incurred), reporting_lag_days >= 21 as is_late_reported, cast({_THB_SQL.format(c="b.currency", a="gross_incurred")} as double) as gross_incurred_thb
from b asof left join rates on b.currency = rates.from_currency and b.loss_date >= rates.rate_date
""")
def silver_claims(spark, sf_dir):
    out = built(spark, "silver_claims", built(spark, "stg_claims", _internal_claims(spark, sf_dir)), built(spark, "stg_partner_claims", *_partner_claims(spark, sf_dir)), _spine(spark, sf_dir))
    return claims_columns(out)


def claims_columns(out: DataFrame) -> DataFrame:
    out = _double(out, "gross_incurred", "paid_amount", "gross_incurred_thb")
    return out.select("claim_id", "claim_no", "policy_id", "loss_date", "claim_cause", "claim_status", "gross_incurred", "paid_amount", "at_fault", "currency", "reporting_lag_days", "record_source", "is_late_reported", "gross_incurred_thb")


def _payments(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return feed(
        read(spark, sf_dir, "orders"), payment_id=F.concat(F.lit("y"), k.cast("string")), policy_id=F.concat(F.lit("p"), k.cast("string")), installment_no=F.lit("1"), due_date=day,
        paid_date=F.when(k % 3 == 0, F.date_add(day, 5).cast("string")), amount=F.col("o_totalprice").cast("decimal(18,2)"), currency=_currency(F.col("o_custkey")), payment_method=F.lit("CARD "), status=F.lit("paid"),
        is_refund=F.when(k % 20 == 0, "true").otherwise("false"), emitted_at=day,
    )


@query(f"""
with {_RATES_SQL}, p as (
  select 'Y' || o_orderkey as payment_id, 'P' || o_orderkey as policy_id, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + 5 else cast(o_orderdate as date) end as effective_date, {_CURRENCY_SQL.format(k="o_custkey")} as currency,
    'card' as payment_method, 'PAID' as payment_status, o_orderkey % 20 = 0 as is_refund, cast(o_totalprice as decimal(18, 2)) as amount
  from orders
)
select p.* replace (cast(amount as double) as amount), cast({_THB_SQL.format(c="p.currency", a="amount")} as double) as amount_thb
from p asof left join rates on p.currency = rates.from_currency and p.effective_date >= rates.rate_date
""")
def silver_premium_payments(spark, sf_dir):
    out = built(spark, "silver_premium_payments", built(spark, "stg_premium_payments", _payments(spark, sf_dir)), _spine(spark, sf_dir))
    return payment_columns(out)


def payment_columns(out: DataFrame) -> DataFrame:
    return _double(out, "amount", "amount_thb").select("payment_id", "policy_id", "effective_date", "currency", "payment_method", "payment_status", "is_refund", "amount", "amount_thb")


@query("""
select 'E' || o_orderkey as endorsement_id, 'SI_CHANGE' as endorsement_type, cast(o_orderdate as date) as effective_date, cast(o_orderdate as date) + cast(o_orderkey % 40 as integer) - 10 as requested_date,
  cast(o_orderkey % 40 as integer) - 10 as backdated_days, cast(cast(o_totalprice as decimal(18, 2)) as double) as premium_delta, o_orderkey % 40 > 10 as is_backdated
from orders
""")
def stg_endorsements(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = feed(
        read(spark, sf_dir, "orders"), endorsement_id=F.concat(F.lit("e"), k.cast("string")), policy_id=F.concat(F.lit("p"), k.cast("string")), endorsement_type=F.lit("si_change"), effective_date=day,
        requested_date=F.date_add(day, (k % 40).cast("int") - 10), old_sum_insured=F.lit("1"), new_sum_insured=F.lit("2"), premium_delta=F.col("o_totalprice").cast("decimal(18,2)"), currency=F.lit("thb"), is_backdated=(k % 40 > 10),
    )
    out = _double(built(spark, "stg_endorsements", rows), "premium_delta")
    return out.select("endorsement_id", "endorsement_type", "effective_date", "requested_date", "backdated_days", "premium_delta", "is_backdated")


def _quotes(spark, sf_dir):
    k = F.col("event_id")
    return feed(
        read(spark, sf_dir, "events"), quote_id=F.concat(F.lit("q"), k.cast("string")), customer_id=F.lit("c1"), product_code=F.lower(F.get(F.lit(list(_CODES)), (k % 4).cast("int"))), partner_code=(F.col("user_id") % 5), country=F.lit("th"), currency=F.lit("thb"),
        quoted_at=F.col("ts").cast("date"), quoted_premium=F.col("value").cast("decimal(18,2)"), channel=F.upper(F.col("event_type")), status=F.when(k % 10 == 0, "rejected").when(k % 10 == 1, "Expired").otherwise("issued"),
        converted_policy_id=F.when(F.col("value") > 50, F.concat(F.lit("p"), k.cast("string"))).otherwise(" "),
    )


@query(f"""
with {_PRODUCTS_SQL}, q as (
  select strftime(ts, '%Y-%m') as ym, {list(_CODES)}[1 + event_id % 4] as code, cast(user_id % 5 as varchar) as partner, event_type as channel, cast(cast(value as decimal(18, 2)) * 100 as bigint) as cents, value > 50 as sold, event_id % 10 as r from events
)
select ym as quote_year_month, partner as partner_code, code as product_code, product_name_en, channel, count(*) as quotes_issued, count(*) filter (sold) as quotes_converted,
  ((2 * 10000 * count(*) filter (sold) + count(*)) // (2 * count(*))) / cast(10000 as double) as conversion_rate,
  ((2 * sum(cents) + count(*)) // (2 * count(*))) / cast(100 as double) as avg_quoted_premium,
  case when count(*) filter (sold) > 0 then ((2 * sum(cents) filter (sold) + count(*) filter (sold)) // (2 * count(*) filter (sold))) / cast(100 as double) end as avg_converted_premium,
  count(*) filter (r = 0) as quotes_rejected, count(*) filter (r = 1) as quotes_expired
from q join prod on code = product_code group by all
""")
def mart_quote_conversion(spark, sf_dir):
    products = built(spark, "dim_product", built(spark, "stg_products", _products(spark, sf_dir)))
    out = built(spark, "mart_quote_conversion", built(spark, "stg_quotes", _quotes(spark, sf_dir)), products)
    out = _double(out, "conversion_rate", "avg_quoted_premium", "avg_converted_premium")
    return out.select("quote_year_month", "partner_code", "product_code", "product_name_en", "channel", "quotes_issued", "quotes_converted", "conversion_rate", "avg_quoted_premium", "avg_converted_premium", "quotes_rejected", "quotes_expired")


# ---------------------------------------------------------------- table store and streams in batch form


def _in_a_table(spark, work):
    """What work returns of a table in a folder of its own, which goes again: few rows, held by the driver."""
    import uuid

    table = Table(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/table_query_{uuid.uuid4().hex}")
    try:
        return work(table)
    finally:
        path = table._Path(table.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@query("""
select 0 as version, 'APPEND' as operation, count(*) filter (n_nationkey < 10) as n, min(n_name) filter (n_nationkey < 10) as least, cast(sum(n_nationkey) filter (n_nationkey < 10) as bigint) as total from nation
union all select 1, 'MERGE', count(*), min(case when n_nationkey >= 5 then lower(n_name) else n_name end), cast(sum(n_nationkey) as bigint) from nation
union all select 2, 'DELETE', count(*), min(case when n_nationkey >= 5 then lower(n_name) else n_name end), cast(sum(n_nationkey) as bigint) from nation where n_nationkey % 7 <> 0
union all select 3, 'OPTIMIZE', count(*), min(case when n_nationkey >= 5 then lower(n_name) else n_name end), cast(sum(n_nationkey) as bigint) from nation where n_nationkey % 7 <> 0
""")
def table_time_travel(spark, sf_dir):
    """A table through append, merge, delete and z-order: its history, and each version as it was."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))

    def work(t: Table):
        t.append(nation.where("n_nationkey < 10"), ["n_regionkey"])
        t.merge(nation.where("n_nationkey >= 5").withColumn("n_name", F.lower("n_name")), ["n_nationkey"])
        t.delete_where(F.col("n_nationkey") % 7 == 0)
        t.optimize(zorder=["n_name", "n_nationkey"])
        said = {r["version"]: r["operation"] for r in t.history().collect()}
        return [(v, said[v], *t.read(v).agg(F.count("*"), F.min("n_name"), F.sum("n_nationkey")).first()) for v in t.versions()]

    return spark.createDataFrame(_in_a_table(spark, work), "version int, operation string, n long, least string, total long")


@query("""
select 1 as versions, count(*) as n, cast(sum(c_custkey) as bigint) as total, 0 as erased_left from customer where c_custkey % 13 <> 0
""")
def table_erasure(spark, sf_dir):
    """Customers erased by key from a table, with the versions that still held them."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")

    def work(t: Table):
        t.append(rows)
        governance.erase([t], "c_custkey", rows.where("c_custkey % 13 = 0").select("c_custkey"))
        return [(len(t.versions()), *t.read().agg(F.count("*"), F.sum("c_custkey"), F.count_if(F.col("c_custkey") % 13 == 0)).first())]

    return spark.createDataFrame(_in_a_table(spark, work), "versions int, n long, total long, erased_left int")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def windowed_event_counts(spark, sf_dir):
    """The counts per hour that a stream keeps, over the table as one batch."""
    counted = windowed_counts(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
