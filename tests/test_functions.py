import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewright import functions as L
from lakewright.datagen import FORMS, render_date, thai_id

DAY = dt.date(2026, 1, 5)


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_calendar_forms(spark):
    good = ["2026-01-05", "2569-01-05", "05/01/2026", "05/01/2569", "5 Jan 2026", "5 ม.ค. 2569", "  2569-01-05 "]
    bad = ["garbage", "", "2026-13-45", None, "2026-02-31", "5 Foo 2026", "32/01/2026"]
    assert one(spark, good + bad, L.be_to_ce_date) == [DAY] * len(good) + [None] * len(bad)


def test_rendered_dates_come_back(spark):
    assert [render_date(DAY, f) for f in FORMS] == ["2026-01-05", "05/01/2026", "5 Jan 2026", "2569-01-05", "05/01/2569"]
    assert one(spark, [render_date(DAY, f) for f in FORMS], L.be_to_ce_date) == [DAY] * 5


def test_cleaning(spark):
    assert one(spark, ["  a   b ", "", "   ", None, "\ta  b "], L.clean_text) == ["a b", None, None, None, " a b"]
    assert one(spark, [" pol  1 "], L.clean_code) == ["POL 1"]
    assert one(spark, ["active", " Canceled ", "หมดอายุ", "x", None], L.normalise_status) == ["ACTIVE", "CANCELLED", "EXPIRED", "UNKNOWN", "UNKNOWN"]


def test_masks_do_not_leak(spark):
    cases = {
        "national_id": "1101700151361", "phone": "081-234-5678", "plate": "1กข 1234", "email": "somchai.5@example.invalid", "health_condition": "hypertension", "name": "Somchai", "dob": "1980-05-06", "chassis": "CH12345", "address": "1 Road",
    }
    got = {k: one(spark, [v, None], lambda c, k=k: L.mask_pii(c, k, "s"))[0] for k, v in cases.items()}
    assert len(got["national_id"]) == 64 and got["phone"] == "081****78" and got["plate"] == "***34" and got["email"] == "s***@example.invalid"
    assert got["health_condition"] is None and got["name"] == "S." and got["dob"] == "1980-01-01" and got["chassis"] == "***2345" and got["address"] == "[redacted]"
    assert one(spark, ["12345", "abc", "no at"], lambda c: L.mask_pii(c, "phone")) == ["***", "***", "***"]
    assert one(spark, [None], lambda c: L.mask_pii(c, "email")) == [None]
    with pytest.raises(ValueError, match="unknown pii type"):
        L.mask_pii(F.lit("x"), "shoe_size")


def test_thai_ids(spark):
    import random

    r = random.Random(1)
    ids = [thai_id(r) for _ in range(300)]
    broken = [i[:-1] + str((int(i[-1]) + 1) % 10) for i in ids]
    assert all(one(spark, ids, L.is_valid_thai_id)) and not any(one(spark, broken, L.is_valid_thai_id))
    assert one(spark, ["123", None, "1-1017-00151-36-x"], L.is_valid_thai_id) == [False, None, False]


def test_conversion_never_passes_through(spark):
    rows = spark.createDataFrame([("1.005", "THB", None), ("100", "IDR", "0.00225"), ("100", "XXX", None)], "a string, c string, r string")
    got = [float(r[0]) if r[0] is not None else None for r in rows.select(L.convert(F.col("a").cast("decimal(20,4)"), F.col("c"), F.col("r").cast("decimal(18,8)"))).collect()]
    assert got == [1.01, 0.23, None]
