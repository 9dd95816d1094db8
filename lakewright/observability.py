"""Run results and freshness as tables, and a static report of them."""

from __future__ import annotations

import datetime as dt
import html
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lakewright.quality import Result
from lakewright.sources.tablestore import Table

RUN_RESULTS = "run_id string, recorded_at string, kind string, node string, layer string, status string, severity string, failures string, seconds string, message string"


def records(run_id: str, models: Sequence[dict] = (), checks: Sequence[Result] = (), freshness: Sequence[dict] = (), now: dt.datetime | None = None) -> list[tuple]:
    """One all-string record per model, check and source."""
    at = (now or dt.datetime.now(dt.UTC)).isoformat()
    out = [(run_id, at, "model", m["node"], m["layer"], m["status"], "", "", str(m["seconds"]), m["message"]) for m in models]
    out += [(run_id, at, "test", c.name, "", c.status, c.severity, str(c.failures), "", "") for c in checks]
    return out + [(run_id, at, "freshness", f["node"], "", f["status"], "", "", "", str(f.get("newest", ""))) for f in freshness]


def append(spark: SparkSession, path: str, rows: Sequence[tuple]) -> DataFrame:
    table = Table(spark, path)
    table.append(spark.createDataFrame(list(rows), RUN_RESULTS).coalesce(1))
    return table.read()


def verdict(status: str) -> str:
    """pass, warn or fail of any record's status."""
    return {"success": "pass", "pass": "pass", "warn": "warn", "skipped": "warn"}.get(status, "fail")


def summary(rows: Sequence[tuple]) -> dict[str, int]:
    return dict(Counter(verdict(r[5]) for r in rows))


def slowest(rows: Sequence[tuple], n: int = 10) -> list[tuple[str, float]]:
    return sorted(((r[3], float(r[8])) for r in rows if r[8]), key=lambda x: (-x[1], x[0]))[:n]


def report(rows: Sequence[tuple], title: str = "Run report") -> str:
    """HTML page of a run: counts, every record, the slowest models."""
    e = lambda x: html.escape(str(x))
    counts = "".join(f"<li>{k}: {v}</li>" for k, v in sorted(summary(rows).items()))
    body = "".join(f'<tr class="{verdict(r[5])}">' + "".join(f"<td>{e(x)}</td>" for x in r[2:]) + "</tr>" for r in rows)
    slow = "".join(f"<li>{e(n)}: {s:.1f} s</li>" for n, s in slowest(rows))
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><ul>{counts}</ul><table>{body}</table><h2>Slowest</h2><ol>{slow}</ol>"
