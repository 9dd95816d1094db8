"""Structured KPI reports: schema, extraction from text, validation, drafts.

Extraction is by rule, as a Column expression per field: a label in English or Spanish, then
a number in either locale, with M/k suffixes, percent or multiples.  It stands where a
language model could be plugged in (`extract(..., extractor=...)`).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakewright.sources.tablestore import Table

_MONEY, _COUNT, _RATIO = T.DecimalType(20, 4), T.LongType(), T.DoubleType()
#: Fields by kind, in the order of a report, with label patterns (English and Spanish).
FIELDS: dict[str, tuple[T.DataType, str, str]] = {
    "arr": (_MONEY, "Annual recurring revenue", r"\bARR\b"),
    "number_of_clients": (_COUNT, "Active clients", r"number of clients|n[úu]mero de clientes"),
    "leads_generated": (_COUNT, "Leads of the period", r"leads generated|leads generados"),
    "revenue": (_MONEY, "Revenue, last twelve months preferred", r"revenue \(LTM\)|ingresos \(LTM\)|revenue(?! churn)|ingresos(?: del trimestre)?"),
    "ebitda": (_MONEY, "EBITDA, last twelve months", r"(?<!/)\bEBITDA(?: \(LTM\)| últimos 12 meses)?"),
    "ebit": (_MONEY, "EBIT, last twelve months", r"\bEBIT\b(?: \(LTM\))?"),
    "corporate_tax": (_MONEY, "Corporate tax, last twelve months", r"corporate tax(?: \(LTM\))?|impuesto de sociedades"),
    "total_assets": (_MONEY, "Total assets", r"total assets|activos totales"),
    "intangible_assets": (_MONEY, "Intangible assets", r"intangible assets|activos intangibles"),
    "debt": (_MONEY, "Debt", r"\bdebt\b(?!/)|\bdeuda\b(?!/)"),
    "debt_to_ebitda": (_RATIO, "Debt over EBITDA", r"debt/ebitda|deuda/ebitda"),
    "percent_international_sales": (_RATIO, "Share of sales abroad", r"% international sales|international sales|ventas internacionales"),
    "number_of_employees": (_COUNT, "Employees", r"number of employees|n[úu]mero de empleados"),
    "number_of_female_employees": (_COUNT, "Female employees", r"number of female employees|n[úu]mero de empleadas"),
    "number_of_c_level_executives": (_COUNT, "C-level executives", r"number of c-level executives|n[úu]mero de directivos"),
    "number_of_female_c_level_executives": (_COUNT, "Female C-level executives", r"number of female c-level executives|n[úu]mero de directivas"),
    "number_of_board_members": (_COUNT, "Board members", r"number of board members|n[úu]mero de consejeros"),
    "number_of_female_board_members": (_COUNT, "Female board members", r"number of female board members|n[úu]mero de consejeras"),
    "monthly_burn": (_MONEY, "Monthly burn", r"monthly burn|burn mensual"),
    "runway_months": (_RATIO, "Runway in months", r"runway(?: \(months\))?"),
    "gross_margin_percent": (_RATIO, "Gross margin", r"gross margin|margen bruto"),
    "annual_logo_churn_percent": (_RATIO, "Annual client churn", r"annual logo churn|churn anual de clientes"),
    "annual_revenue_churn_percent": (_RATIO, "Annual revenue churn", r"annual revenue churn|churn de ingresos"),
    "net_revenue_retention_percent": (_RATIO, "Net revenue retention", r"net revenue retention|\bNRR\b"),
    "average_acv": (_MONEY, "Average contract value", r"average acv|acv promedio"),
    "payback_months": (_RATIO, "Payback in months", r"payback(?: sobre CAC)?"),
    "sales_and_marketing_expenses_percent_of_revenue": (_RATIO, "Sales and marketing over revenue", r"sales (?:and|&) marketing(?: expenses)?|gastos de ventas y marketing"),
    "general_and_administration_expenses_percent_of_revenue": (_RATIO, "General and administration over revenue", r"general (?:and|&) administration(?: expenses)?|gastos generales y administrativos"),
    "research_and_development_expenses_percent_of_revenue": (_RATIO, "Research and development over revenue", r"research (?:and|&) development(?: expenses)?|gastos de i\+d"),
}
STATES = ("draft", "finalized")


def schema() -> T.StructType:
    """Of a record: all fields nullable, their meaning as column comments."""
    return T.StructType([T.StructField(n, t, True, {"comment": meaning}) for n, (t, meaning, _) in FIELDS.items()])


_NUMBER = r"[-−]?\d[\d.,]*"


def parse_number(c: Column) -> Column:
    """Number of ``4,950,000``, ``1.780.000``, ``7,1M``, ``1,36x``, ``22%``, ``€120k``; else null.

    The last of two kinds of separator is the decimal one; a lone kind groups thousands if it is
    followed by exactly three digits each time, else it is decimal.
    """
    digits = F.regexp_replace(F.regexp_extract(c, f"({_NUMBER})", 1), r"[.,]$", "")
    digits = F.regexp_replace(digits, "−", "-")
    grouped_comma = digits.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    grouped_dot = digits.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$")
    plain = F.when(grouped_comma, F.replace(digits, F.lit(","), F.lit(""))).when(grouped_dot, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    unit = F.lower(F.regexp_extract(c, rf"{_NUMBER}\s?([MmKk])(?![A-Za-z])", 1))
    return plain.try_cast("decimal(28,6)") * F.when(unit == "m", 1_000_000).when(unit == "k", 1_000).otherwise(1)


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    out, depth = [""], 0
    for prev, ch in zip(" " + pattern, pattern, strict=False):
        depth += (ch == "(") - (ch == ")") if prev != "\\" else 0
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def extracted(text: Column) -> Column:
    """A record from free text or a table: per field the first number after its label, within a line or row."""
    flat = F.regexp_replace(text, r"\*\*", "")
    out = []
    for name, (kind, _, label) in FIELDS.items():
        # In a table row the value is the last cell, in prose the next number.
        # Alternatives are tried in their order, so that the preferred label wins wherever it stands.
        found: Column = F.lit(None).cast("string")
        for one in _alternatives(label):
            row = F.regexp_extract(flat, rf"(?im)^\s*\|?\s*(?:{one})\s*\|(?:[^|\n]*\|)*?\s*([^|\n]*\d[^|\n]*)\|?\s*$", 1)
            prose = F.regexp_extract(flat, rf"(?i)(?:{one})[^\d\n|]{{0,60}}?({_NUMBER}\s?[MmKk%x]?)", 1)
            found = F.coalesce(found, F.nullif(row, F.lit("")), F.nullif(prose, F.lit("")))
        out.append(parse_number(found).try_cast(kind.simpleString()).alias(name))
    return F.struct(*out)


def extract(reports: DataFrame, text: str = "content", extractor: Callable[[Column], Column] = extracted) -> DataFrame:
    return reports.withColumn("record", extractor(F.col(text)))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Whole text or CSV files as (path, content)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_text(content: bytes) -> str:
    """The sheets of an .xlsx file as table rows, one line each; cells as stored, so a share shown
    as 22% reads 0.22."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        xml = lambda name: ElementTree.fromstring(book.read(name))
        words = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [words(x) for x in xml("xl/sharedStrings.xml").iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []

        def cell(c) -> str:
            value = c.findtext(f"{_SHEET}v") or ""
            return shared[int(value)] if c.get("t") == "s" else words(c) if c.get("t") == "inlineStr" else value

        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        return "\n".join(f"| {' | '.join(cell(c) for c in row.iter(f'{_SHEET}c'))} |" for n in sheets for row in xml(n).iter(f"{_SHEET}row"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Whole .xlsx files as (path, content); a file that is none has null content."""

    def read(batches):
        for batch in batches:
            texts = []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(workbook_text(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, content string")


def prompt(template: str, content: Column) -> Column:
    """template with {content} filled in."""
    return F.replace(F.lit(template), F.lit("{content}"), content)


def validate_json(df: DataFrame, column: str, ddl: str | None = None) -> DataFrame:
    """column read as JSON into `record`; what does not fit is null, broken JSON is all null."""
    kind = ddl if ddl is not None else schema()
    return df.withColumn("record", F.from_json(F.col(column), kind, {"mode": "PERMISSIVE"}))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty form fields as null."""
    return df.withColumns({f.name: F.nullif(f.name, F.lit("")) for f in df.schema if isinstance(f.dataType, T.StringType)})


def toggled(state: Column) -> Column:
    """The other of the two states; null for anything else."""
    return F.when(state == STATES[0], STATES[1]).when(state == STATES[1], STATES[0])


def submit(store: Table, reports: DataFrame, state: str = STATES[1]) -> DataFrame:
    """reports appended to the store in a state, numbered on from its greatest seq; the rows as stored.

    Reports are submitted a few at a time; their order by content gives the numbers.
    """
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}; known: {', '.join(STATES)}")
    last = store.read().agg(F.max("seq")).first()[0] if store.exists() else None
    order = Window.orderBy(*[c for c in reports.columns if c not in ("seq", "state")])
    store.append(reports.drop("seq", "state").withColumns({"state": F.lit(state), "seq": F.lit(last or 0).cast("long") + F.row_number().over(order)}))
    return store.read().where(F.col("seq") > F.lit(last or 0))


def latest_draft(reports: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str = "seq", state: str = "state") -> DataFrame:
    """Per key the newest report; its fields only if it is a draft, else null."""
    newest = reports.groupBy(*keys).agg(F.max_by(F.struct(state, *fields), F.col(seq)).alias("_r"), F.max(seq).alias(seq))
    return newest.select(*keys, *[F.when(F.col(f"_r.{state}") == STATES[0], F.col(f"_r.{f}")).alias(f) for f in fields], seq)


def anomalies(history: DataFrame, keys: Sequence[str], period: str, drop: float = 0.4, runway: float = 12) -> DataFrame:
    """Flags: revenue fell by more than `drop` against the period before; runway below `runway` months; fields missing."""
    before = F.lag("revenue").over(Window.partitionBy(*keys).orderBy(period))
    flagged = history.withColumn("revenue_drop", F.coalesce((before > 0) & (F.col("revenue") < before * (1 - drop)), F.lit(False)))
    if "runway_months" in history.columns:
        flagged = flagged.withColumn("short_runway", F.coalesce(F.col("runway_months") < runway, F.lit(False)))
    known = [c for c in FIELDS if c in history.columns]
    return flagged.withColumn("missing", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in known]), lambda x: x.isNotNull())) if known else flagged
