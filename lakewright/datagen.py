"""A small synthetic insurer, for fixtures: landing files day by day, with known defects.

Everything follows from (seed, policies, day); the standard library's generator suffices.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import random
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from lakewright.plans.marts import COVER
from lakewright.plans.models import CLAIM_NAMES, POLICY_NAMES

#: Partners with country and feed variant.
PARTNERS = {"SIAMGUARD": ("TH", "a"), "THAIVIVAT": ("TH", "a"), "BKKSURE": ("TH", "b"), "KRUNGSRI_GI": ("TH", "b"), "NUSANTARA": ("ID", "c"), "GARUDA_INS": ("ID", "c")}
#: How dates are written.
FORMS = ("iso", "dmy", "dmon", "be_iso", "be_dmy")
_MONTH = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
START = dt.date(2026, 1, 5)


@dataclass(frozen=True)
class Defects:
    """Which defects appear in the files."""

    duplicates: bool = True
    near_duplicates: bool = True
    malformed: bool = True
    scuffed: bool = True
    orphan_claims: bool = True
    backdated: bool = True
    late_claims: bool = True
    drift: bool = True
    deletes: bool = True
    mixed_dates: bool = True
    cancellations: bool = True
    mixed_currencies: bool = True
    mixed_language: bool = True
    #: Negative premiums in partner feeds and losses after expiry; off by default, as totals then no longer add up.
    validation_failures: bool = False


def thai_id(r: random.Random) -> str:
    d = [r.randint(1, 8)] + [r.randint(0, 9) for _ in range(11)]
    return "".join(map(str, d)) + str((11 - sum(x * (13 - i) for i, x in enumerate(d)) % 11) % 10)


def render_date(d: dt.date, form: str) -> str:
    be = d.year + 543
    return {"iso": d.isoformat(), "dmy": f"{d:%d/%m/%Y}", "dmon": f"{d.day} {_MONTH[d.month - 1]} {d.year}", "be_iso": f"{be}-{d:%m-%d}", "be_dmy": f"{d:%d/%m}/{be}"}[form]


class Universe:
    """All records that will ever be emitted, each with its day."""

    def __init__(self, seed: int = 42, policies: int = 600, days: int = 3, defects: Defects = Defects()) -> None:
        r = self.r = random.Random(seed)
        self.seed, self.days, self.defects = seed, days, defects
        self.customers = [
            {"customer_id": f"C{i:06d}", "first_name": r.choice(["Somchai", "Malee", "Budi", "Siti"]), "last_name": f"L{i % 97}", "national_id": thai_id(r), "date_of_birth": (dt.date(1950, 1, 1) + dt.timedelta(r.randrange(20000))).isoformat(),
             "email": f"user.{i}@example.invalid", "phone": f"081-{r.randrange(1000):03d}-{r.randrange(10000):04d}", "address": f"{i} Road", "province": "Bangkok", "country": "TH", "created_at": "2025-12-01"}
            for i in range(max(1, policies * 82 // 100))
        ]
        self.vehicles = [
            {"vehicle_id": f"V{i:06d}", "customer_id": r.choice(self.customers)["customer_id"], "plate_no": f"1กข {i:04d}", "plate_province": "Bangkok", "make": "Toyota", "model": r.choice(["Yaris", "Vios"]), "manufacture_year": r.randint(2008, 2025),
             "engine_cc": r.choice([1200, 1500, 1800, 2500]), "chassis_no": f"CH{i:09d}", "vehicle_value_local": r.randint(100, 900) * 1000, "country": "TH"}
            for i in range(max(1, len(self.customers) * 3 // 4))
        ]
        self.products = [{"product_code": c, "product_name_en": d.split(":")[0], "product_name_th": c, "line_of_business": "health" if c == "HEALTH_ADJ" else "motor", "cover_type": k, "base_premium_local": 645 * (i + 1), "default_sum_insured": 100_000 * (i + 1)} for i, (c, (k, d)) in enumerate(COVER.items())]
        self.policies = []
        for i in range(policies):
            partner = r.choice(list(PARTNERS))
            start = START - dt.timedelta(r.randrange(1, 330))
            v = r.choice(self.vehicles)
            self.policies.append({
                "policy_id": f"POL{i:07d}", "partner": partner, "country": PARTNERS[partner][0], "currency": "THB" if PARTNERS[partner][0] == "TH" or not defects.mixed_currencies else "IDR", "customer_id": v["customer_id"], "vehicle_id": v["vehicle_id"],
                "product_code": r.choice(list(COVER)), "inception": start, "expiry": start + dt.timedelta(365), "premium": r.randint(600, 20000), "insured": r.randint(1, 9) * 100_000, "status": "ACTIVE", "feed": r.random() < 0.5,
                "day": r.randint(1, days), "form": r.choice(FORMS) if defects.mixed_dates else "iso",
            })
        self.cancelled = {p["policy_id"] for p in self.policies if r.random() < 0.04 and defects.cancellations}
        self.deleted = {p["policy_id"] for p in self.policies if defects.deletes and not p["feed"] and p["day"] < days and r.random() < 0.05}

    def _claims(self) -> list[dict]:
        r, out = random.Random(self.seed + 1), []
        for i, p in enumerate(self.policies):
            if r.random() < 0.2:
                lag = r.choice([0, 1, 3, 10, 25, 60] if self.defects.late_claims else [0, 1, 3])
                loss = p["inception"] + dt.timedelta(r.randrange(1, 300) + (400 if self.defects.validation_failures and i % 9 == 0 else 0))
                lost = self.defects.orphan_claims and r.random() < 0.03
                out.append({"claim_id": f"CL{i:07d}", "claim_no": f"N{i:07d}", "policy_id": f"GHOST{i}" if lost else p["policy_id"], "loss_date": loss, "reported_date": loss + dt.timedelta(lag), "amount": r.randint(1, 60) * 1000, "currency": p["currency"], "partner": p["partner"], "feed": p["feed"], "day": r.randint(p["day"], self.days)})
        return out

    # ------------------------------------------------------------ files

    def emit(self, landing: str | Path, day: int) -> list[Path]:
        """Write day's files; the same arguments give the same bytes."""
        root, r, stamp = Path(landing), random.Random(self.seed * 1000 + day), (START + dt.timedelta(day - 1)).isoformat()
        done: list[Path] = []

        def to_csv(path: str, rows: list[Mapping], broken: Iterable[str] = ()) -> None:
            if rows:
                f = root / path
                f.parent.mkdir(parents=True, exist_ok=True)
                names = list(dict.fromkeys(k for x in rows for k in x))
                with f.open("w", newline="", encoding="utf-8") as out:
                    w = csv.DictWriter(out, names, lineterminator="\n")
                    w.writeheader()
                    w.writerows(rows)
                    out.writelines(x.replace("@", "," * (len(names) - 1)) + "\n" for x in broken)
                done.append(f)

        def to_json(path: str, rows: list[Mapping], broken: Iterable[str] = ()) -> None:
            if rows:
                f = root / path
                f.parent.mkdir(parents=True, exist_ok=True)
                f.write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in rows) + "".join(f"{b}\n" for b in broken), encoding="utf-8")
                done.append(f)

        scuff = lambda x: f"  {x.lower()} " if self.defects.scuffed and r.random() < 0.1 else x
        bad_csv = ["@"] if self.defects.malformed else []
        bad_json = ["{not valid json", '{"truncated": '] if self.defects.malformed else []
        for partner, (_, variant) in PARTNERS.items():
            names = POLICY_NAMES[f"partner_policies_{variant}"]
            mine = [p for p in self.policies if p["partner"] == partner and p["feed"] and (p["day"] == day or (self.defects.duplicates and p["day"] == day - 1 and p["insured"] > 700_000))]
            rows = []
            for p in mine:
                again = p["day"] != day
                premium = p["premium"] + (1 if again and self.defects.near_duplicates else 0)
                premium = -premium if self.defects.validation_failures and int(p["policy_id"][3:]) % 17 == 0 else premium
                thai = variant == "b" and self.defects.mixed_language
                status = ("ยกเลิก" if thai else "Cancelled") if p["policy_id"] in self.cancelled else ("มีผลบังคับ" if thai else "active")
                record = {"policy_id": scuff(p["policy_id"]), "national_id": thai_id(random.Random(p["policy_id"])), "product_code": scuff(p["product_code"]), "inception": render_date(p["inception"], p["form"]), "expiry": render_date(p["expiry"], p["form"]),
                          "premium": premium, "insured": p["insured"], "currency": p["currency"], "plate_no": "1กข 1234", "status": status, "updated": f"{stamp} 02:00:00"}
                row = {names[k]: v for k, v in record.items()}
                if self.defects.drift and day >= 2:
                    row |= {{"a": "distribution_channel", "b": "AgentCode", "c": "kanal_distribusi"}[variant]: "X1"}
                rows.append(row)
            to_csv(f"partner_drops/{partner}/dt={stamp}/policies_{variant}.csv", rows, bad_csv)
            names = CLAIM_NAMES[f"partner_claims_{variant}"]
            rows = [{names[k]: v for k, v in {"claim_no": c["claim_no"], "policy_id": c["policy_id"], "loss": render_date(c["loss_date"], "iso"), "reported": render_date(c["reported_date"], "dmy"), "incurred": c["amount"], "currency": c["currency"], "cause": "collision", "status": "open"}.items()} for c in self._claims() if c["partner"] == partner and c["feed"] and c["day"] == day]
            to_csv(f"partner_drops/{partner}/dt={stamp}/claims_{variant}.csv", rows)
        at = f"{stamp}T01:30:00"
        change = lambda op, p: {"op": op, "ts": at, "policy_id": p["policy_id"], "customer_id": p["customer_id"], "product_code": p["product_code"], "partner_code": p["partner"], "country": p["country"], "currency": p["currency"], "inception_date": p["inception"].isoformat(),
                                "expiry_date": p["expiry"].isoformat(), "sum_insured": p["insured"] * (2 if op == "U" else 1), "written_premium": p["premium"], "status": "CANCELLED" if p["policy_id"] in self.cancelled else "ACTIVE", "vehicle_id": p["vehicle_id"], "updated_at": at}
        own = [p for p in self.policies if not p["feed"]]
        feed = [change("I", p) for p in own if p["day"] == day]
        feed += [change("U", p) for p in own if p["day"] == day - 1 and p["insured"] >= 600_000 and p["policy_id"] not in self.deleted]
        feed += [change("D", p) for p in own if p["day"] == day - 1 and p["policy_id"] in self.deleted]
        to_json(f"cdc/policies/dt={stamp}/changes.jsonl", feed, bad_json)
        claims = [c for c in self._claims() if c["day"] == day and not c["feed"]]
        to_json(f"events/claims/dt={stamp}/claims.jsonl", [{"event_id": f"E{c['claim_id']}", "emitted_at": at, "claim_id": c["claim_id"], "claim_no": c["claim_no"], "policy_id": scuff(c["policy_id"]), "loss_date": c["loss_date"].isoformat(), "reported_date": c["reported_date"].isoformat(), "claim_cause": "collision", "claim_type": "OD",
                "status": "open", "gross_incurred": c["amount"], "paid_amount": c["amount"] / 2, "reserve_amount": 0, "currency": c["currency"], "at_fault": True, "settled_date": None} for c in claims], bad_json)
        paid = [{"event_id": f"EP{p['policy_id']}", "emitted_at": at, "payment_id": f"PAY{p['policy_id']}", "policy_id": p["policy_id"], "installment_no": 1, "due_date": p["inception"].isoformat(), "paid_date": None, "amount": p["premium"], "currency": p["currency"], "payment_method": "card", "status": "paid", "is_refund": False} for p in self.policies if p["day"] == day]
        paid += [{"event_id": f"ER{p['policy_id']}", "emitted_at": at, "payment_id": f"REF{p['policy_id']}", "policy_id": p["policy_id"], "installment_no": 2, "due_date": (p["inception"] + dt.timedelta(90)).isoformat(), "paid_date": (p["inception"] + dt.timedelta(100)).isoformat(), "amount": -p["premium"] / 2, "currency": p["currency"], "payment_method": "card", "status": "paid", "is_refund": True} for p in self.policies if p["day"] == day and p["policy_id"] in self.cancelled]
        to_json(f"events/premium_payments/dt={stamp}/payments.jsonl", paid)
        quotes = [{"event_id": f"EQ{p['policy_id']}-{k}", "emitted_at": at, "quote_id": f"Q{p['policy_id']}-{k}", "customer_id": p["customer_id"], "product_code": p["product_code"], "partner_code": p["partner"], "country": p["country"], "currency": p["currency"], "quoted_at": p["inception"].isoformat(), "quoted_premium": p["premium"] * 1.0,
                   "channel": r.choice(["Web", "agent"]), "status": "converted" if k == 0 else r.choice(["rejected", "expired"]), "converted_policy_id": p["policy_id"] if k == 0 else None} for p in self.policies if p["day"] == day for k in range(3)]
        to_json(f"events/quotes/dt={stamp}/quotes.jsonl", quotes)
        ends = [{"event_id": f"EE{p['policy_id']}", "emitted_at": at, "endorsement_id": f"EN{p['policy_id']}", "policy_id": p["policy_id"], "endorsement_type": "sum_insured", "effective_date": (START - dt.timedelta(20 if self.defects.backdated and i % 3 == 0 else 0)).isoformat(), "requested_date": START.isoformat(),
                 "is_backdated": self.defects.backdated and i % 3 == 0, "old_sum_insured": p["insured"], "new_sum_insured": p["insured"] * 2, "premium_delta": 100, "currency": p["currency"]} for i, p in enumerate(own) if p["day"] == day and i % 5 == 0]
        to_json(f"events/endorsements/dt={stamp}/endorsements.jsonl", ends)
        to_json(f"events/health_declarations/dt={stamp}/declarations.jsonl", [{"declaration_id": f"H{p['policy_id']}", "policy_id": p["policy_id"], "customer_id": p["customer_id"], "declared_at": p["inception"].isoformat(), "pre_existing_conditions": r.choice(["none", "asthma;diabetes"]), "bmi_band": "normal"} for p in self.policies if p["day"] == day and p["product_code"] == "HEALTH_ADJ"])
        if day == 1:
            to_csv(f"reference/customers/dt={stamp}/customers.csv", self.customers)
            to_csv(f"reference/vehicles/dt={stamp}/vehicles.csv", self.vehicles)
            to_csv(f"reference/products/dt={stamp}/products.csv", self.products)
            to_csv(f"reference/partner_insurers/dt={stamp}/partners.csv", [{"partner_code": k, "partner_name": k.title(), "country": c, "schema_variant": v, "commission_rate": "0.1500", "onboarded_date": "2020-01-01"} for k, (c, v) in PARTNERS.items()])
            days = [START - dt.timedelta(400 - 7 * i) for i in range(60)]
            to_csv(f"reference/fx_rates/dt={stamp}/fx.csv", [{"rate_date": d.isoformat(), "from_currency": c, "to_currency": "THB", "rate": x} for i, d in enumerate(days) for c, x in (("THB", "1.0"), ("IDR", f"{0.0022 + i * 0.000001:.6f}"))])
        return done


def registry_yaml(landing: str, bronze: str) -> str:
    """The registry of all seventeen sources."""
    import yaml

    pii = {"national_id": "national_id", "email": "email", "phone": "phone", "address": "address", "first_name": "name", "last_name": "name", "date_of_birth": "dob", "plate_no": "plate", "chassis_no": "chassis",
           "cust_national_id": "national_id", "IDCard": "national_id", "VehiclePlate": "plate", "no_ktp": "national_id", "nomor_plat": "plate", "pre_existing_conditions": "health_condition", "bmi_band": "bmi"}
    of = lambda v: "{" + ",".join(k for k, (_, x) in PARTNERS.items() if x == v) + "}"
    sources = []

    def add(name: str, fmt: str, path: str, key: list[str], columns: Iterable[str] = ()) -> None:
        s = {"name": name, "description": name.replace("_", " "), "format": fmt, "path": path, "primary_key": key, "partition_by": ["_batch_date"], "freshness": {"warn_after_hours": 26, "error_after_hours": 50}}
        found = {c: {"pii_type": pii[c], "sensitivity": "high"} for c in columns if c in pii}
        sources.append(s | ({"reader_options": {"header": "true", "mode": "PERMISSIVE", "encoding": "UTF-8"}} if fmt == "csv" else {}) | ({"pii_columns": found} if found else {}))

    for v in "abc":
        names = POLICY_NAMES[f"partner_policies_{v}"]
        add(f"partner_policies_{v}", "csv", f"partner_drops/{of(v)}/dt=*/policies_*.csv", [names["policy_id"]], names.values())
        add(f"partner_claims_{v}", "csv", f"partner_drops/{of(v)}/dt=*/claims_*.csv", [CLAIM_NAMES[f"partner_claims_{v}"]["claim_no"]])
    for n, key in (("quotes", "quote_id"), ("endorsements", "endorsement_id"), ("premium_payments", "payment_id"), ("claims", "claim_id"), ("health_declarations", "declaration_id")):
        add(f"events_{n}", "json", f"events/{n}/dt=*/*.jsonl", [key], ("pre_existing_conditions", "bmi_band") if n == "health_declarations" else ())
    add("cdc_policies", "json", "cdc/policies/dt=*/*.jsonl", ["policy_id", "ts"])
    for n, key, columns in (("customers", "customer_id", ("first_name", "last_name", "national_id", "date_of_birth", "email", "phone", "address")), ("vehicles", "vehicle_id", ("plate_no", "chassis_no")), ("products", "product_code", ()), ("partner_insurers", "partner_code", ())):
        add(f"ref_{n}", "csv", f"reference/{n}/dt=*/*.csv", [key], columns)
    add("ref_fx_rates", "csv", "reference/fx_rates/dt=*/*.csv", ["rate_date", "from_currency", "to_currency"])
    return yaml.safe_dump({"defaults": {"landing": landing, "bronze": bronze}, "sources": sources}, allow_unicode=True, sort_keys=False)
