"""Classified columns, and views that show each reader what they may see.

Spark alone has no catalog policies, so enforcement is a view: masks for classified columns
and a filter by country, both decided by the reader's groups.  The same declarations
render to SQL for catalogs that do have policies.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions import PII_TYPES, mask_pii
from lakewright.sources.registry import Registry

UNMASKED, UNMASKED_HEALTH = "data_engineers", "restricted_health"
HEALTH = ("health", "health_condition", "bmi")
#: Groups and the countries whose rows they see; UNMASKED sees all.
COUNTRY_GROUPS = {"analysts_th": "TH", "analysts_id": "ID"}
#: Cleared to read rows of all countries; what is masked stays masked.
ALL_COUNTRIES = "analysts_global"
#: Who may use which schemas: all of what analysts share, and what only engineers write.
GRANTS = {"data_engineers": ("bronze", "silver", "gold", "marts", "observability"), "analysts": ("gold", "marts", "observability"), "restricted_health": ("gold",)}


@dataclass(frozen=True, order=True)
class Classified:
    schema: str
    table: str
    column: str
    pii_type: str
    sensitivity: str = "high"


def tagged(df: DataFrame, pii: Mapping[str, str]) -> DataFrame:
    """df with pii types as column metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"pii_type": pii[c]}) if c in pii else F.col(c) for c in df.columns])


def collect(registry: Registry, models: Mapping[tuple[str, str], Mapping[str, str]] | None = None) -> list[Classified]:
    """Classified columns of the sources and models, once each (a model's entry wins)."""
    found = {(schema, table, c): Classified(schema, table, c, kind) for (schema, table), columns in (models or {}).items() for c, kind in columns.items()}
    for s in registry.sources:
        for c, meta in s.pii_columns.items():
            found.setdefault(("bronze", s.name, c), Classified("bronze", s.name, c, meta["pii_type"], meta.get("sensitivity", "high")))
    for c in found.values():
        if c.pii_type not in PII_TYPES:
            raise ValueError(f"{c.schema}.{c.table}.{c.column}: unknown pii type {c.pii_type!r}")
    return sorted(found.values())


def secure_view(df: DataFrame, pii: Mapping[str, str], groups: Iterable[str], salt: str = "", country: str | None = "country") -> DataFrame:
    """What a member of groups sees of df: classified columns masked, rows of their countries.

    UNMASKED reads everything but health data, which only UNMASKED_HEALTH reads.
    """
    mine = set(groups)
    free = lambda kind: UNMASKED_HEALTH in mine if kind in HEALTH else UNMASKED in mine
    seen = df.select(*[mask_pii(F.col(c), pii[c], salt).alias(c) if c in pii and not free(pii[c]) else F.col(c) for c in df.columns])
    if country and country in df.columns and not mine & {UNMASKED, ALL_COUNTRIES}:
        seen = seen.where(F.col(country).isin(*sorted({COUNTRY_GROUPS[g] for g in mine if g in COUNTRY_GROUPS}) or [""]))
    return seen


def _sql_mask(kind: str) -> str:
    trim = "trim(value)"
    tail = lambda keep, least: f"case when length({trim}) < {least} then '***' else concat('***', right({trim}, {keep})) end"
    return {
        "national_id": f"sha2(concat(secret('governance', 'salt'), {trim}), 256)",
        "phone": f"case when length({trim}) < 6 then '***' else concat(left({trim}, 3), '****', right({trim}, 2)) end",
        "plate": tail(2, 4),
        "chassis": tail(4, 4),
        "email": f"case when not contains({trim}, '@') then '***' else concat(left({trim}, 1), '***@', split_part({trim}, '@', 2)) end",
        "dob": f"concat(left({trim}, 4), '-01-01')",
        "name": f"concat(left({trim}, 1), '.')",
        "address": "'[redacted]'",
    }.get(kind, "cast(null as string)")


def render_sql(columns: Sequence[Classified], catalog: str = "main", filtered: Sequence[tuple[str, str]] = ()) -> str:
    """Tags, mask functions, bindings, row filter and grants for a catalog with policies."""
    kinds = sorted({c.pii_type for c in columns})
    out = [f"-- {len(columns)} classified columns"]
    for c in columns:
        out.append(f"ALTER TABLE {catalog}.{c.schema}.{c.table} ALTER COLUMN {c.column} SET TAGS ('pii_type' = '{c.pii_type}', 'sensitivity' = '{c.sensitivity}');")
    for k in kinds:
        group = UNMASKED_HEALTH if k in HEALTH else UNMASKED
        out.append(f"CREATE OR REPLACE FUNCTION {catalog}.governance.mask_{k}(value STRING) RETURNS STRING RETURN CASE WHEN value IS NULL OR is_account_group_member('{group}') THEN value ELSE {_sql_mask(k)} END;")
    out += [f"ALTER TABLE {catalog}.{c.schema}.{c.table} ALTER COLUMN {c.column} SET MASK {catalog}.governance.mask_{c.pii_type};" for c in columns]
    tests = " OR ".join([f"is_account_group_member('{g}')" for g in (UNMASKED, ALL_COUNTRIES)] + [f"(is_account_group_member('{g}') AND country = '{v}')" for g, v in sorted(COUNTRY_GROUPS.items())])
    out.append(f"CREATE OR REPLACE FUNCTION {catalog}.governance.filter_by_country(country STRING) RETURNS BOOLEAN RETURN {tests};")
    out += [f"ALTER TABLE {catalog}.{s}.{t} SET ROW FILTER {catalog}.governance.filter_by_country ON (country);" for s, t in filtered]
    for group, schemas in GRANTS.items():
        rights = "USE SCHEMA, SELECT, MODIFY, CREATE TABLE" if group == UNMASKED else "USE SCHEMA, SELECT"
        out.append(f"GRANT USE CATALOG ON CATALOG {catalog} TO `{group}`;")
        out += [f"GRANT {rights} ON SCHEMA {catalog}.{s} TO `{group}`;" for s in schemas]
    return "\n".join(out) + "\n"


def erase(tables: Iterable, column: str, values: Sequence[str] | DataFrame) -> int:
    """Right to erasure: delete the rows from every table, then drop the versions that still held
    them.  values may be a frame with that column; they are joined, so their number is not bounded."""
    done = 0
    for table in tables:
        held = table.read()
        if column in held.columns:
            named = values if isinstance(values, DataFrame) else held.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
            table.delete_keys(named.select(F.col(column).cast(held.schema[column].dataType).alias(column)).distinct())
            table.vacuum(keep=1)
            done += 1
    return done
