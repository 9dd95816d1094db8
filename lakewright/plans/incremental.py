"""Incremental silver: the keys that recent batches touched, and the whole history of these keys only.

A full build reads every landed batch.  Here the landing tables' recent folders (pruned by batch date) tell which keys
changed; from the rest, only files that hold one of these keys are read; the model is built over those rows and
replaces its table's rows of these keys.  Since a key's whole history is there, the result is that of
a full build, late records, deletes and take-overs between feeds included.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import clean_code
from lakewright.plans import models
from lakewright.sources.tablestore import Table


@dataclass(frozen=True)
class Keyed:
    """Which landed feeds a model's keys come from: of each feed the key names by raw column, and which names the table's key may be."""

    feeds: Mapping[str, Mapping[str, str]]
    target: str
    names: tuple[str, ...]


KEYED = {
    "silver_policies": Keyed({"cdc_policies": {"policy_id": "policy_id"}} | {f: {"policy_id": n["policy_id"]} for f, n in models.POLICY_NAMES.items()}, "policy_id", ("policy_id",)),
    # A partner's claim stands under its number, until an internal claim has that number.
    "silver_claims": Keyed({"events_claims": {"claim_id": "claim_id", "claim_no": "claim_no"}} | {f: {"claim_no": n["claim_no"]} for f, n in models.CLAIM_NAMES.items()}, "claim_id", ("claim_id", "claim_no")),
    "silver_premium_payments": Keyed({"events_premium_payments": {"payment_id": "payment_id"}}, "payment_id", ("payment_id",)),
}


@dataclass(frozen=True)
class Touched:
    #: How many keys of each name.
    keys: dict[str, int]
    #: Files of history read, and files there are.
    files_read: int
    files: int


def _values(rows: DataFrame, raw: str, name: str) -> DataFrame:
    return rows.select(clean_code(F.col(raw)).alias(name)).where(F.col(name).isNotNull())


def touched_keys(landing: Callable[[str], Table], keyed: Keyed, since: dt.date, keep: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The keys in batches since a date, with all that they are tied to: where a feed has two kinds of key in a row, each
    leads to the other, until nothing more is found.  `keep` stores what later steps read several times: the keys and
    the tied columns, which are thus read and cleaned once.  Each step follows the keys that the step before found."""
    there = {f: landing(f) for f in keyed.feeds if landing(f).exists()}
    found: dict[str, DataFrame] = {}
    for name in keyed.names:
        parts = [_values(there[f].since("_batch_date", since), raws[name], name) for f, raws in keyed.feeds.items() if f in there and name in raws]
        if parts:
            found[name] = keep(reduce(DataFrame.union, parts).distinct())
    ties = [keep(there[f].read().select(*[clean_code(F.col(raw)).alias(n) for n, raw in raws.items()])) for f, raws in keyed.feeds.items() if f in there and len(raws) > 1]
    fresh = dict(found) if ties else {}
    while fresh:
        led: dict[str, list[DataFrame]] = {}
        for rows in ties:
            for n in rows.columns:
                led.setdefault(n, []).extend(rows.join(fresh[other], other, "left_semi").select(n) for other in rows.columns if other != n and other in fresh)
        new = {n: keep(reduce(DataFrame.union, parts).where(F.col(n).isNotNull()).distinct().join(found[n], n, "left_anti")) for n, parts in led.items() if parts}
        fresh = {n: df for n, df in new.items() if not df.isEmpty()}
        found |= {n: found[n].union(df) for n, df in fresh.items()}
    return found


def refresh(run: models.Run, name: str, landing: Callable[[str], Table], staged: Mapping[str, DataFrame]) -> Touched:
    """Bring a silver table up to date; staged gives the inputs that are not keyed (rates)."""
    m, keyed, table = models.MODELS[name], KEYED[name], run.table(name)
    high = table.read().agg(F.max("batch_date")).first()[0]
    since = (high or dt.date(1, 1, 1)) - dt.timedelta(days=run.lookback_days)
    with table.scratch() as keep:
        keys = touched_keys(landing, keyed, since, keep)
        read, files, inputs = 0, 0, []
        for stage in m.inputs:
            feeds = models.MODELS[stage].inputs
            if not set(feeds) <= set(keyed.feeds):
                inputs.append(staged[stage])
                continue
            frames = []
            for f in feeds:
                if not landing(f).exists():
                    frames.append(run.bronze(f))
                    continue
                # A feed's first key is its stage's, rows without which are left out there; the others lead to it.
                k, raw = next(iter(keyed.feeds[f].items()))
                rows, n = landing(f).holding({k: (clean_code(F.col(raw)), keys[k])})
                frames.append(rows)
                read, files = read + n, files + len(landing(f).read().inputFiles())
            inputs.append(models.MODELS[stage].build(run, *frames))
        rows = m.build(run, *inputs)
        if "op" in rows.columns:
            rows = rows.where(~F.coalesce(F.col("op") == "D", F.lit(False)))
        affected = keep(reduce(DataFrame.union, [keys[k].select(F.col(k).alias("key")) for k in keyed.names if k in keys]).distinct())
        table.replace_keys(rows, keyed.target, affected)
        return Touched({k: df.count() for k, df in keys.items()}, read, files)
