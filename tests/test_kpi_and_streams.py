import json

import pytest
from pyspark.sql import functions as F

from lakewright import kpi
from lakewright.sources.tablestore import Table
from lakewright.streaming import land_stream, merge_stream, windowed_counts

TABLE = """| What | Unit | This period |
|---|---|---|
| Runway | months left | 31 |
| **Headcount** | people | n/a |
| Number of employees | heads | **17** |
| Debt | open loans | **$2,305,400** |
| Debt/EBITDA | multiple | **0.4x** |
| Revenue (LTM) | twelve months | **$8,640,250** |
| EBITDA (LTM) | twelve months | **$733,900** |
| % International sales | share | **61%** |
"""
PROSE = "Cerramos el año con un ARR de 3,9M € (antes 3,1M). Margen bruto: 58%. Los ingresos suman 2.415.300 €; churn anual de clientes del 11%. La deuda es de 640.000 € y el ratio deuda/EBITDA queda en 0,75x."


def test_extraction(spark):
    rows = spark.createDataFrame([(1, TABLE), (2, PROSE)], "id int, content string")
    a, b = (r["record"].asDict() for r in kpi.extract(rows).orderBy("id").collect())
    assert (a["number_of_employees"], float(a["revenue"]), a["runway_months"], a["percent_international_sales"], float(a["debt"]), a["debt_to_ebitda"], float(a["ebitda"])) == (17, 8640250.0, 31.0, 61.0, 2305400.0, 0.4, 733900.0)
    assert (float(b["arr"]), b["gross_margin_percent"], float(b["revenue"]), b["annual_logo_churn_percent"], float(b["debt"]), b["debt_to_ebitda"]) == (3900000.0, 58.0, 2415300.0, 11.0, 640000.0, 0.75)
    assert b["number_of_employees"] is None and len(kpi.FIELDS) == 29


def test_submitted_reports_are_numbered_on(spark, tmp_path):
    store = Table(spark, str(tmp_path / "reports"))
    first = kpi.submit(store, spark.createDataFrame([("acme", 10), ("acme", 20)], "company string, arr int"), "draft").collect()
    second = kpi.submit(store, spark.createDataFrame([("zeta", 5)], "company string, arr int")).collect()
    assert sorted((r["seq"], r["arr"], r["state"]) for r in first) == [(1, 10, "draft"), (2, 20, "draft")] and [(r["seq"], r["state"]) for r in second] == [(3, "finalized")]
    assert store.read().count() == 3
    assert [r[0] for r in spark.createDataFrame([("draft",), ("finalized",), ("?",)], "s string").select(kpi.toggled(F.col("s"))).collect()] == ["finalized", "draft", None]
    with pytest.raises(ValueError, match="unknown state"):
        kpi.submit(store, store.read(), "open")


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Number of employees</t></si><si><r><t>De</t></r><r><t>bt</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>23</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>open</t></is></c><c><v>1500.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = {r["path"][-6:]: r for r in kpi.extract(kpi.read_workbooks(spark, str(tmp_path))).collect()}
    assert got["b.xlsx"]["content"] is None and got["a.xlsx"]["content"].splitlines()[1] == "| Debt | open | 1500.5 |"
    assert got["a.xlsx"]["record"]["number_of_employees"] == 23 and float(got["a.xlsx"]["record"]["debt"]) == 1500.5


def test_numbers(spark):
    cases = {"€4,950,000": 4950000, "1.780.000 €": 1780000, "7,1M": 7100000, "1,36x": 1.36, "22%": 22, "120k": 120000, "9.000": 9000, "0.5": 0.5, "none": None}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", kpi.parse_number(F.col("c")).cast("double").alias("n")).collect()
    assert {r["c"]: r["n"] for r in rows} == cases


def test_validation_and_drafts(spark):
    rows = spark.createDataFrame([(1, '{"arr": 5.5, "number_of_clients": 3}'), (2, "{broken")], "id int, j string")
    got = kpi.validate_json(rows, "j").orderBy("id").select("record.arr", "record.number_of_clients").collect()
    assert (float(got[0][0]), got[0][1]) == (5.5, 3) and got[1][0] is None
    reports = spark.createDataFrame([("a", 1, "draft", 10), ("a", 2, "finalized", 20), ("b", 1, "finalized", 1), ("b", 2, "draft", 7)], "c string, seq int, state string, arr int")
    assert {tuple(r) for r in kpi.latest_draft(reports, ["c"], ["arr"]).select("c", "arr").collect()} == {("a", None), ("b", 7)}
    assert kpi.blank_to_null(spark.createDataFrame([("", "x")], "a string, b string")).first().asDict() == {"a": None, "b": "x"}


def test_streams(spark, tmp_path):
    d = tmp_path / "in" / "dt=2026-01-05"
    d.mkdir(parents=True)
    write = lambda n, rows: (d / n).write_text("".join(json.dumps(r) + "\n" for r in rows))
    landed = Table(spark, str(tmp_path / "landed"))
    go = lambda: land_stream(spark, "s", str(tmp_path / "in"), "id string, ts timestamp, op string, v int", "json", landed, str(tmp_path / "c1"), ["id"]).awaitTermination()
    write("a.json", [{"id": "1", "ts": "2026-01-05T00:00:00", "op": "I", "v": 1}, {"id": "2", "ts": "2026-01-05T00:00:00", "op": "I", "v": 1}, {"id": " ", "v": 3}])
    go()
    go()
    assert landed.read().count() == 2 and landed.read(part="quarantine").count() == 1
    merged = Table(spark, str(tmp_path / "merged"))
    stream = lambda: merge_stream(spark.readStream.schema("id string, ts timestamp, op string, v int").json(str(d)), merged, ["id"], ["ts"], str(tmp_path / "c2"), F.col("op") == "D").awaitTermination()
    stream()
    write("b.json", [{"id": "1", "ts": "2026-01-06T00:00:00", "op": "U", "v": 5}, {"id": "1", "ts": "2026-01-01T00:00:00", "op": "U", "v": 9}, {"id": "2", "ts": "2026-01-07T00:00:00", "op": "D", "v": 0}])
    stream()
    assert {(r["id"], r["v"]) for r in merged.read().where("trim(id) <> ''").collect()} == {("1", 5)}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    rows = [("a", "2026-01-05T00:01:00"), ("a", "2026-01-05T00:04:00"), ("b", "2026-01-05T00:59:00"), ("a", "2026-01-05T01:30:00"), ("a", "2026-01-07T00:00:00")]
    (d / "x.json").write_text("".join(json.dumps({"id": i, "ts": t}) + "\n" for i, t in rows))
    counted = windowed_counts(spark.readStream.schema("id string, ts timestamp").json(str(d)), "ts", ["id"], "1 hour")
    query = counted.writeStream.format("memory").queryName("counted_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["id"], r["window"]["start"].isoformat(), r["n"]) for r in spark.table("counted_test").collect()}
    assert got == {("a", "2026-01-05T00:00:00", 2), ("b", "2026-01-05T00:00:00", 1), ("a", "2026-01-05T01:00:00", 1), ("a", "2026-01-07T00:00:00", 1)}
