"""Layered models: staging, silver, gold and marts, each a function of a context.

`model(...)` registers a function with what it reads; `order()` sorts them so that each comes
after its inputs.  `run` materialises: staging stays a lazy frame (cleaned once, read by
several), silver facts merge into the table store with a look-back, gold and marts overwrite.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import be_to_ce_date, clean_code, clean_text, normalise_status, partner_code
from lakewright.operators import asof, cdc, dedupe, exposure, harmonise, merge, scd2
from lakewright.plans import marts
from lakewright.sources.tablestore import Table

Context = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    key: tuple[str, ...] = ()


MODELS: dict[str, Model] = {}


def model(layer: str, *inputs: str, key: Sequence[str] = ()):
    def add(f):
        MODELS[f.__name__] = Model(f.__name__, layer, inputs, f, tuple(key))
        return f

    return add


def order(names: Sequence[str] | None = None) -> list[Model]:
    graph = {m.name: {i for i in m.inputs if i in MODELS} for m in MODELS.values()}
    return [MODELS[n] for n in TopologicalSorter(graph).static_order() if not names or n in names]


@dataclass
class Run:
    """What a run depends on besides data."""

    spark: SparkSession
    warehouse: str
    bronze: Context
    as_of: dt.date
    at: dt.datetime
    reporting: str = "THB"
    lookback_days: int = 60
    salt: str = ""
    #: The landing tables by source; with them silver facts read only the history of keys that recent batches touched.
    landing: Callable[[str], Table] | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.warehouse.rstrip('/')}/{MODELS[name].layer}/{name}")


_TS = "timestamp"
_META = ["_ingested_at", "_record_hash", "_batch_date", "_source_file"]
_TIES = ["_record_hash"]


def _d(c: str) -> Column:
    return F.col(c).try_cast("date")


def _money(c: str) -> Column:
    return F.col(c).try_cast("decimal(18,2)")


def _stage(df: DataFrame, key: Sequence[str], columns: Mapping[str, Column], latest: Column | str) -> DataFrame:
    """Clean first, then keep the latest record of each cleaned key; null keys go."""
    cleaned = df.withColumn("_latest", F.col(latest).try_cast(_TS) if isinstance(latest, str) else latest)
    carried = [c for c in _META if c in df.columns]
    cleaned = cleaned.select(*[c.alias(n) for n, c in columns.items()], "_latest", *carried)
    for k in key:
        cleaned = cleaned.where(F.col(k).isNotNull())
    out = dedupe.dedupe_latest(cleaned, key, ["_latest", "_ingested_at"], _TIES).drop("_latest")
    return out.withColumnsRenamed({"_ingested_at": "ingested_at", "_record_hash": "record_hash", "_batch_date": "batch_date", "_source_file": "source_file"})


def _codes(*names: str) -> dict[str, Column]:
    return {n: clean_code(F.col(n)) for n in names}


def _texts(*names: str) -> dict[str, Column]:
    return {n: clean_text(F.col(n)) for n in names}


# ---------------------------------------------------------------- staging


@model("staging", "events_claims")
def stg_claims(run, claims):
    columns = _codes("claim_id", "claim_no", "policy_id") | {"loss_date": _d("loss_date"), "reported_date": _d("reported_date"), "settled_date": _d("settled_date")}
    columns |= {"claim_cause": clean_text(F.col("claim_cause")), "claim_type": clean_text(F.col("claim_type")), "claim_status": clean_code(F.col("status"))}
    columns |= {c: _money(c) for c in ("gross_incurred", "paid_amount", "reserve_amount")} | _codes("currency") | {"at_fault": F.col("at_fault").try_cast("boolean")}
    return _stage(claims, ["claim_id"], columns, "emitted_at")


@model("staging", "ref_customers")
def stg_customers(run, customers):
    columns = _codes("customer_id") | _texts("first_name", "last_name", "national_id", "email", "phone", "address", "province") | _codes("country") | {"date_of_birth": _d("date_of_birth"), "created_date": _d("created_at")}
    return _stage(customers, ["customer_id"], columns, "created_at")


@model("staging", "events_endorsements")
def stg_endorsements(run, rows):
    columns = _codes("endorsement_id", "policy_id", "endorsement_type") | {"effective_date": _d("effective_date"), "requested_date": _d("requested_date"), "backdated_days": F.datediff(_d("requested_date"), _d("effective_date"))}
    columns |= {c: _money(c) for c in ("old_sum_insured", "new_sum_insured", "premium_delta")} | _codes("currency") | {"is_backdated": F.col("is_backdated").try_cast("boolean")}
    return _stage(rows, ["endorsement_id"], columns, "requested_date")


@model("staging", "ref_fx_rates")
def stg_fx_rates(run, rates):
    typed = rates.select(_d("rate_date").alias("rate_date"), *[c.alias(n) for n, c in _codes("from_currency", "to_currency").items()], F.col("rate").try_cast("decimal(18,8)").alias("rate"), "_ingested_at")
    return asof.fx_spine(typed.where("rate_date is not null and rate is not null"))


@model("staging", "events_health_declarations")
def stg_health_declarations(run, rows):
    columns = _codes("declaration_id", "policy_id", "customer_id") | {"declared_date": _d("declared_at")} | _texts("pre_existing_conditions", "bmi_band")
    columns |= {"has_declared_condition": clean_text(F.col("pre_existing_conditions")) != "none"}
    return _stage(rows, ["declaration_id"], columns, "declared_at")


#: Column names of the three partner feed variants.
POLICY_NAMES = {
    "partner_policies_a": {"policy_id": "policy_no", "national_id": "cust_national_id", "product_code": "product_cd", "inception": "start_date", "expiry": "end_date", "premium": "premium_amt",
                           "insured": "sum_insured", "currency": "currency_cd", "plate_no": "plate_no", "status": "policy_status", "updated": "last_updated_at"},
    "partner_policies_b": {"policy_id": "PolicyNumber", "national_id": "IDCard", "product_code": "ProductCode", "inception": "EffectiveDate", "expiry": "ExpiryDate", "premium": "GrossPremium",
                           "insured": "SumInsured", "currency": "Curr", "plate_no": "VehiclePlate", "status": "Status", "updated": "UpdatedTimestamp"},
    "partner_policies_c": {"policy_id": "nomor_polis", "national_id": "no_ktp", "product_code": "kode_produk", "inception": "tanggal_mulai", "expiry": "tanggal_akhir", "premium": "premi",
                           "insured": "nilai_pertanggungan", "currency": "mata_uang", "plate_no": "nomor_plat", "status": "status_polis", "updated": "waktu_pembaruan"},
}
CLAIM_NAMES = {
    "partner_claims_a": {"claim_no": "claim_no", "policy_id": "policy_no", "loss": "loss_date", "reported": "reported_date", "incurred": "incurred_amt", "currency": "currency_cd", "cause": "cause_of_loss", "status": "claim_status"},
    "partner_claims_b": {"claim_no": "ClaimNumber", "policy_id": "PolicyNumber", "loss": "LossDate", "reported": "NotifiedDate", "incurred": "IncurredAmount", "currency": "Curr", "cause": "CauseOfLoss", "status": "ClaimStatus"},
    "partner_claims_c": {"claim_no": "nomor_klaim", "policy_id": "nomor_polis", "loss": "tanggal_kejadian", "reported": "tanggal_lapor", "incurred": "jumlah_klaim", "currency": "mata_uang", "cause": "penyebab", "status": "status_klaim"},
}


@model("staging", *POLICY_NAMES)
def stg_partner_policies(run, *feeds):
    rows = harmonise(dict(zip(POLICY_NAMES, feeds, strict=True)), POLICY_NAMES, _META)
    columns = _codes("policy_id") | {"partner_code": partner_code(F.col("_source_file"))} | _texts("national_id") | _codes("product_code")
    columns |= {"inception_date": be_to_ce_date(F.col("inception")), "expiry_date": be_to_ce_date(F.col("expiry")), "written_premium": _money("premium"), "sum_insured": _money("insured")}
    columns |= _codes("currency") | _texts("plate_no") | {"policy_status": normalise_status(F.col("status")), "source_updated_at": F.col("updated").try_cast(_TS)}
    return _stage(rows, ["policy_id"], columns, "updated")


@model("staging", *CLAIM_NAMES)
def stg_partner_claims(run, *feeds):
    rows = harmonise(dict(zip(CLAIM_NAMES, feeds, strict=True)), CLAIM_NAMES, _META)
    columns = _codes("claim_no", "policy_id") | {"partner_code": partner_code(F.col("_source_file")), "loss_date": be_to_ce_date(F.col("loss")), "reported_date": be_to_ce_date(F.col("reported"))}
    columns |= {"gross_incurred": _money("incurred")} | _codes("currency") | {"claim_cause": clean_text(F.col("cause")), "claim_status": clean_code(F.col("status"))}
    return _stage(rows, ["claim_no"], columns, F.col("_ingested_at"))


@model("staging", "ref_partner_insurers")
def stg_partners(run, rows):
    columns = _codes("partner_code") | _texts("partner_name") | _codes("country") | _texts("schema_variant") | {"commission_rate": F.col("commission_rate").try_cast("decimal(9,4)"), "onboarded_date": _d("onboarded_date")}
    return _stage(rows, ["partner_code"], columns, F.col("_ingested_at"))


@model("staging", "cdc_policies")
def stg_policies_cdc(run, rows):
    """Every event, typed; nothing is collapsed here."""
    columns = _codes("op", "policy_id", "customer_id", "vehicle_id", "product_code", "partner_code", "country", "currency") | {"change_ts": F.col("ts").try_cast(_TS), "inception_date": _d("inception_date"), "expiry_date": _d("expiry_date")}
    columns |= {"policy_status": normalise_status(F.col("status")), "sum_insured": _money("sum_insured"), "written_premium": _money("written_premium")}
    return rows.select(*[c.alias(n) for n, c in columns.items()], F.col("_ingested_at").alias("ingested_at"), F.col("_record_hash").alias("record_hash"), F.col("_batch_date").alias("batch_date")).where("policy_id is not null")


@model("staging", "events_premium_payments")
def stg_premium_payments(run, rows):
    columns = _codes("payment_id", "policy_id") | {"installment_no": F.col("installment_no").try_cast("int"), "due_date": _d("due_date"), "paid_date": _d("paid_date"), "effective_date": F.coalesce(_d("paid_date"), _d("due_date"))}
    columns |= {"amount": _money("amount")} | _codes("currency") | {"payment_method": F.lower(clean_text(F.col("payment_method"))), "payment_status": clean_code(F.col("status")), "is_refund": F.col("is_refund").try_cast("boolean")}
    return _stage(rows, ["payment_id"], columns, "emitted_at")


@model("staging", "ref_products")
def stg_products(run, rows):
    columns = _codes("product_code") | _texts("product_name_en", "product_name_th") | {c: F.lower(clean_text(F.col(c))) for c in ("line_of_business", "cover_type")} | {c: _money(c) for c in ("base_premium_local", "default_sum_insured")}
    return _stage(rows, ["product_code"], columns, F.col("_ingested_at"))


@model("staging", "events_quotes")
def stg_quotes(run, rows):
    columns = _codes("quote_id", "customer_id", "product_code", "partner_code", "country", "currency") | {"quoted_date": _d("quoted_at"), "quoted_premium": _money("quoted_premium"), "channel": F.lower(clean_text(F.col("channel")))}
    columns |= {"quote_status": clean_code(F.col("status")), "converted_policy_id": clean_code(F.col("converted_policy_id")), "did_convert": clean_code(F.col("converted_policy_id")).isNotNull()}
    return _stage(rows, ["quote_id"], columns, "quoted_at")


@model("staging", "ref_vehicles")
def stg_vehicles(run, rows):
    columns = _codes("vehicle_id", "customer_id") | _texts("plate_no", "plate_province", "make", "model", "chassis_no") | {c: F.col(c).try_cast("int") for c in ("manufacture_year", "engine_cc")}
    columns |= {"vehicle_value_local": _money("vehicle_value_local")} | _codes("country")
    return _stage(rows, ["vehicle_id"], columns, F.col("_ingested_at"))


# ---------------------------------------------------------------- silver


def _valued(run: Run, facts: DataFrame, spine: DataFrame, amounts: Sequence[str], on: str) -> DataFrame:
    return asof.converted(facts, spine, {a: f"{a}_thb" for a in amounts}, "currency", on, run.reporting)


@model("silver", "stg_policies_cdc", "stg_partner_policies", "stg_fx_rates", key=["policy_id"])
def silver_policies(run, changes, partner, spine):
    """Newest change of each policy, and partner policies the change feed never had.

    Deleted policies come as rows with op 'D', so that the merge removes them; a key the
    change feed ever had, deleted or not, keeps its partner row out.
    """
    current = cdc.cdc_current(changes, ["policy_id"], ["change_ts", "ingested_at"], ties=["record_hash"], keep_deleted=True)
    own = current.withColumns({"record_source": F.lit("cdc"), "national_id": F.lit(None).cast("string"), "plate_no": F.lit(None).cast("string"), "source_updated_at": F.lit(None).cast(_TS)})
    theirs = partner.withColumns({"op": F.lit("I"), "record_source": F.lit("partner"), "customer_id": F.lit(None).cast("string"), "vehicle_id": F.lit(None).cast("string"),
                                  "country": F.when(F.col("currency") == "THB", "TH").otherwise("ID"), "change_ts": F.lit(None).cast(_TS)})
    keep = ["op", "policy_id", "customer_id", "vehicle_id", "product_code", "partner_code", "country", "currency", "national_id", "plate_no", "inception_date", "expiry_date", "policy_status",
            "sum_insured", "written_premium", "record_source", "source_updated_at", "change_ts", "batch_date"]
    both = cdc.fill_from(own.select(*keep), theirs.select(*keep), ["policy_id"], known=changes)
    valued = _valued(run, both, spine, ["written_premium", "sum_insured"], "inception_date")
    return valued.withColumns({"term_days": F.datediff("expiry_date", "inception_date"), "_silver_loaded_at": F.lit(run.at)})


@model("silver", "stg_claims", "stg_partner_claims", "stg_fx_rates", key=["claim_id"])
def silver_claims(run, internal, partner, spine):
    """Internal claims; partner claims whose number no internal claim has."""
    own = internal.withColumn("record_source", F.lit("internal"))
    none = {"settled_date": "date", "claim_type": "string", "paid_amount": "decimal(18,2)", "reserve_amount": "decimal(18,2)", "at_fault": "boolean"}
    theirs = partner.withColumns({"claim_id": F.col("claim_no"), "record_source": F.lit("partner")} | {c: F.lit(None).cast(t) for c, t in none.items()})
    both = cdc.fill_from(own, theirs.select(*own.columns), ["claim_no"])
    valued = _valued(run, marts.with_lag(both), spine, ["gross_incurred", "paid_amount"], "loss_date")
    return valued.drop("record_hash", "source_file", "ingested_at").withColumn("_silver_loaded_at", F.lit(run.at))


@model("silver", "stg_premium_payments", "stg_fx_rates", key=["payment_id"])
def silver_premium_payments(run, payments, spine):
    return _valued(run, payments, spine, ["amount"], "effective_date").drop("record_hash", "source_file", "ingested_at").withColumn("_silver_loaded_at", F.lit(run.at))


CHECKED = ["sum_insured", "written_premium", "policy_status", "expiry_date", "vehicle_id", "product_code"]
_VERSIONED = ["policy_id", "customer_id", "vehicle_id", "product_code", "partner_code", "country", "currency", "inception_date", "expiry_date", "policy_status", "sum_insured", "written_premium",
              "written_premium_thb", "sum_insured_thb", "record_source"]


@model("silver", "silver_policies")
def policies_snapshot(run, policies):
    return policies.select(*_VERSIONED)


@model("silver", "policies_snapshot")
def silver_policy_as_of(run, history):
    return scd2.as_of_view(history, ["policy_id"])


# ---------------------------------------------------------------- gold and marts


@model("gold", "stg_customers")
def dim_customer(run, rows):
    return marts.dim_customer(rows, run.as_of, run.salt)


@model("gold", "stg_vehicles")
def dim_vehicle(run, rows):
    return marts.dim_vehicle(rows, run.as_of)


@model("gold", "stg_products")
def dim_product(run, rows):
    return marts.dim_product(rows)


@model("gold", "stg_partners")
def dim_partner(run, rows):
    return marts.dim_partner(rows, run.as_of)


@model("gold", "silver_policies", "silver_claims")
def dim_date(run, policies, claims):
    return marts.date_dim(run.spark, *marts.date_bounds(policies, claims, run.as_of))


@model("gold", "stg_health_declarations")
def dim_health_profile(run, rows):
    return marts.dim_health_profile(rows)


@model("gold", "silver_policies")
def fct_written_premium(run, policies):
    return exposure.written_premium(policies)


@model("gold", "silver_policies", "silver_premium_payments")
def fct_earned_premium(run, policies, payments):
    return exposure.earned_premium(policies, payments, run.as_of)


@model("gold", "silver_claims", "silver_policies")
def fct_claims(run, claims, policies):
    return marts.claims_fact(claims, policies)


@model("marts", "fct_earned_premium", "fct_claims", "dim_product")
def mart_loss_ratio(run, earned, claims, products):
    return marts.loss_ratio(earned, claims, products)


@model("marts", "stg_quotes", "dim_product")
def mart_quote_conversion(run, quotes, products):
    return marts.quote_conversion(quotes, products)


@model("marts", "fct_claims")
def mart_claims_lag(run, claims):
    return marts.claims_lag(claims, run.lookback_days, run.as_of)


def _materialise(run: Run, m: Model, build: Callable[[], DataFrame]) -> DataFrame:
    if m.layer == "staging":
        return build()
    table = run.table(m.name)
    if m.name == "policies_snapshot":
        table.snapshot(build(), ["policy_id"], CHECKED, run.at)
    elif m.key and run.landing and table.exists():
        from lakewright.plans import incremental

        incremental.refresh(run, m.name, run.landing, run.frames)
    elif m.key:
        rows = build()
        high = table.read().agg(F.max("batch_date")).first()[0] if table.exists() else None
        recent = merge.lookback(rows, high, run.lookback_days)
        if "op" in rows.columns:
            # Deletes remove their key from the table; what precedes in the feed was decided on all of it.
            table.merge(recent, list(m.key), deleted=F.col("op") == "D")
        else:
            table.merge(recent, list(m.key))
    else:
        table.overwrite(build())
    return table.read()


def run(ctx: Run, names: Sequence[str] | None = None) -> list[dict]:
    """Build the models in order; one record per model: name, layer, status, seconds, message.

    A failed model leaves those that need it skipped and does not stop the others.
    """
    import time

    results, failed = [], set()
    for m in order(names):
        began = time.monotonic()
        record = {"node": m.name, "layer": m.layer, "status": "success", "message": ""}
        if failed & set(m.inputs):
            record |= {"status": "skipped", "message": f"needs {', '.join(sorted(failed & set(m.inputs)))}"}
            failed.add(m.name)
        else:
            try:
                inputs = [ctx.frames[i] if i in ctx.frames else ctx.bronze(i) for i in m.inputs]
                ctx.frames[m.name] = _materialise(ctx, m, lambda m=m, inputs=inputs: m.build(ctx, *inputs))
            except Exception as e:  # noqa: BLE001 - reported, and dependants are skipped
                failed.add(m.name)
                record |= {"status": "error", "message": str(e).splitlines()[0][:300]}
        results.append(record | {"seconds": round(time.monotonic() - began, 3)})
    return results
