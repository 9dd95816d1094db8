"""Landing to marts on generated files: exactly-once landing, quarantine, drift, deletes, masks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewright import governance, observability, proof, quality
from lakewright.datagen import START, Defects, Universe, registry_yaml
from lakewright.plans import models
from lakewright.sources import registry
from lakewright.sources.bronze import METADATA, Bronze, files_of
from lakewright.sources.tablestore import Table


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    import yaml

    root = tmp_path_factory.mktemp("world")
    universe = Universe(seed=7, policies=60, days=2)
    text = registry_yaml(str(root / "landing"), str(root / "bronze"))
    reg = registry.parse(yaml.safe_load(text))
    bronze = Bronze(spark, reg)
    landed, results = {}, {}
    for day in (1, 2):
        universe.emit(root / "landing", day)
        landed[day] = {r.source: r for r in bronze.ingest_all()}
        ctx = models.Run(spark, str(root / "wh"), bronze.read, START + dt.timedelta(30), dt.datetime.combine(START + dt.timedelta(day), dt.time()), salt="pepper")
        results[day] = models.run(ctx)
    return {"u": universe, "bronze": bronze, "landed": landed, "results": results, "ctx": ctx, "reg": reg, "root": root}


def test_generator_is_deterministic(tmp_path):
    a, b = (Universe(seed=7, policies=60).emit(tmp_path / n, 1) for n in "ab")
    assert [f.read_bytes() for f in a] == [f.read_bytes() for f in b] and len(a) > 10


def test_each_defect_can_be_switched(tmp_path):
    said = lambda n, **d: "".join(f.read_text(encoding="utf-8") for f in Universe(seed=7, policies=900, days=1, defects=Defects(**d)).emit(tmp_path / n, 1))
    plain, off = said("on"), said("off", cancellations=False, mixed_currencies=False, mixed_language=False, malformed=False)
    for mark in ("ยกเลิก", "มีผลบังคับ", "Cancelled", '"currency": "IDR"', "not valid json"):
        assert mark in plain and mark not in off, mark
    assert ",-" not in plain and ",-" in said("bad", validation_failures=True)


def test_registry_has_seventeen_sources(world):
    assert len(world["reg"].sources) == 17


def test_every_model_built(world):
    for day in (1, 2):
        bad = [r for r in world["results"][day] if r["status"] != "success"]
        assert not bad, bad
    assert {r["node"] for r in world["results"][2]} == set(models.MODELS) and len(models.MODELS) == 30


def test_landing_is_once(world):
    again = world["bronze"].ingest_all()
    assert {r.status for r in again} == {"UP_TO_DATE"}


def test_metadata_quarantine_and_manifest(world):
    t = world["bronze"].table("partner_policies_a").read()
    assert set(METADATA) <= set(t.columns) and t.where(F.length("_record_hash") != 64).isEmpty()
    reasons = {r[0] for r in world["bronze"].table("cdc_policies__quarantine").read().select("_quarantine_reason").distinct().collect()}
    assert reasons == {"unparseable_record"}
    blank = world["bronze"].table("partner_policies_b__quarantine").read()
    assert {r[0] for r in blank.select("_quarantine_reason").distinct().collect()} <= {"missing_primary_key", "unparseable_record"}
    m = world["bronze"].manifest.read().where("source_name = 'partner_policies_a'")
    assert m.agg(F.sum("row_count")).first()[0] == t.count()


def test_drift_is_audited(world):
    audit = {r["source_name"]: r["added_columns"] for r in world["bronze"].audit.read().collect()}
    assert audit["partner_policies_a"] == "distribution_channel" and "AgentCode" in audit["partner_policies_b"]


def test_deleted_policies_leave_and_history_closes(world):
    gone = world["u"].deleted
    now = {r[0] for r in world["ctx"].table("silver_policies").read().select("policy_id").collect()}
    before = {r[0] for r in world["ctx"].table("silver_policies").read(0).select("policy_id").collect()}
    assert gone and gone <= before and not gone & now
    history = world["ctx"].table("silver_policy_as_of").read()
    assert history.where(F.col("policy_id").isin(*gone)).where("is_current").isEmpty()
    assert quality.run([quality.no_overlaps(history, ["policy_id"])])[0].status == "pass"
    assert history.where("total_versions > 1").count() > 0


def test_quality_suite(world):
    t = lambda n: world["ctx"].table(n).read()
    results = quality.run([
        quality.unique(t("silver_policies"), ["policy_id"]), quality.unique(t("silver_claims"), ["claim_id"]), quality.earned_within_written(t("fct_earned_premium")), quality.premium_not_negative(t("silver_premium_payments")),
        quality.relationships(t("silver_claims"), "policy_id", t("silver_policies"), "policy_id", severity="warn"), quality.accepted_values(t("mart_loss_ratio"), "credibility_band", ["very_low", "low", "partial", "full"]),
    ])
    assert [r.status for r in results[:4]] == ["pass"] * 4 and results[4].status == "warn" and results[5].status == "pass"
    rows = observability.records("r1", world["results"][2], results)
    assert observability.summary(rows)["warn"] == 1 and "<table>" in observability.report(rows)
    kept = observability.append(world["ctx"].spark, str(world["root"] / "obs"), rows)
    assert kept.count() == len(rows)


def test_earned_days_add_up(world):
    e = world["ctx"].table("fct_earned_premium").read()
    off = e.groupBy("policy_id").agg(F.sum("days_on_risk").alias("n"), F.first("exposure_end_date").alias("e"), F.first("inception_date").alias("i")).where(F.col("n") != F.datediff("e", "i"))
    assert off.isEmpty() and e.count() > 100


def test_gold_has_no_raw_personal_data(world):
    raw = world["ctx"].frames["stg_customers"]
    dim = world["ctx"].table("dim_customer").read()
    j = raw.join(dim, "customer_id")
    for a, b in (("national_id", "national_id_hash"), ("phone", "phone_masked"), ("email", "email_masked"), ("address", "address_masked")):
        assert j.where(F.col(a) == F.col(b)).isEmpty()


def test_governance(world):
    columns = governance.collect(world["reg"])
    sql = governance.render_sql(columns, filtered=[("silver", "silver_policies")])
    assert sql.count("SET MASK") == len(columns) > 15 and "filter_by_country" in sql and "is_account_group_member('analysts_global')" in sql
    assert "ON SCHEMA main.observability TO `analysts`" in sql and "USE CATALOG ON CATALOG main TO `restricted_health`" in sql and "silver TO `analysts`" not in sql
    rows = world["ctx"].table("silver_policies").read()
    seen = governance.secure_view(rows, {"national_id": "national_id"}, ["analysts_id"])
    assert {r[0] for r in seen.select("country").distinct().collect()} == {"ID"}
    both = governance.secure_view(rows, {"national_id": "national_id"}, ["analysts_global"])
    assert {r[0] for r in both.select("country").distinct().collect()} == {"ID", "TH"} and both.where("length(national_id) <> 64").isEmpty()
    assert governance.secure_view(rows, {}, []).isEmpty() and governance.secure_view(rows, {}, ["data_engineers"]).count() == rows.count()


def test_table_store(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(spark.range(10).withColumn("v", F.lit("a")))
    t.merge(spark.createDataFrame([(3, "b"), (20, "c"), (4, "x")], "id long, v string"), ["id"], deleted=F.col("v") == "x")
    assert t.read().count() == 10 and t.read(0).count() == 10 and t.read().where("id = 3").first()["v"] == "b" and t.read().where("id = 4").isEmpty()
    with pytest.raises(ValueError, match="repeats"):
        t.merge(spark.createDataFrame([(1, "p"), (1, "q")], "id long, v string"), ["id"])
    assert [r["operation"] for r in t.history().collect()] == ["MERGE", "APPEND"]
    t.append(spark.range(100, 102).withColumn("w", F.lit(1)))
    assert t.read().where("w is null").count() == 10
    t.optimize()
    t.optimize(zorder=["id"])
    t.vacuum(keep=2)
    assert t.read().count() == 12
    with pytest.raises(ValueError, match="no version"):
        t.read(0)
    governance.erase([t], "v", ["b"])
    assert t.read().where("v = 'b'").isEmpty() and len(t.versions()) == 1


def test_exact_quarantine_boundary(spark, tmp_path):
    f = tmp_path / "in" / "dt=2026-01-05" / "p.csv"
    f.parent.mkdir(parents=True)
    f.write_text("policy_no,premium_amt\nPOL1,10\nPOL2,-645.00\n,\n")
    reg = registry.Registry((registry.Source("p", "p", "csv", "in/dt=*/p.csv", {"header": "true"}, ("policy_no",)),), str(tmp_path), str(tmp_path / "b"))
    got = Bronze(spark, reg).ingest("p")
    assert (got.status, got.rows, got.quarantined) == ("INGESTED", 2, 1)
    assert Bronze(spark, reg).table("p__quarantine").read().first()["_quarantine_reason"] == "missing_primary_key"


def test_registry_rejects():
    base = {"name": "a", "description": "d", "format": "csv", "path": "p"}
    cases = (([base | {"format": "parquet"}], "format: 'parquet' is not one of"), ([base, base], "used twice"), ([{"name": "a"}], "path: missing"), ([], "no sources"), ([base | {"colour": 1}], "colour: unknown"),
             ([base | {"primary_key": "id"}], "a list of names"), ([{"name": "a"}, base | {"name": "b", "format": "x"}], "(?s)source 1. a: .*source 2. b: "))
    for bad, says in cases:
        with pytest.raises(ValueError, match=says):
            registry.parse({"sources": bad})


def test_brace_patterns(spark, tmp_path):
    for n in ("a/x", "a/y", "b/x"):
        (tmp_path / n).mkdir(parents=True)
        (tmp_path / n / "p q.csv").write_text("k,v\n1,2\n")
    source = registry.Source("p", "p", "csv", "a/{x,y}/*.csv")
    got = [r["file_path"] for r in files_of(spark, source, str(tmp_path)).collect()]
    assert [p.split("/")[-2] for p in got] == ["x", "y"] and all(p.endswith("p%20q.csv") for p in got)


def test_declarations_stay_in_sync(world, tmp_path):
    f = tmp_path / "sources.yml"
    assert not registry.in_sync(f, world["reg"])
    f.write_text(registry.declarations(world["reg"]), encoding="utf-8")
    assert registry.in_sync(f, world["reg"])
    f.write_text(f.read_text().replace("partner_policies_a", "partner_policies_z"))
    assert not registry.in_sync(f, world["reg"])


def test_unreachable_landing_folder_raises(spark, world, tmp_path):
    import dataclasses

    nowhere = Bronze(spark, dataclasses.replace(world["reg"], bronze=str(tmp_path / "nowhere")))
    with pytest.raises(RuntimeError, match="nothing has landed"):
        nowhere.read("cdc_policies")
    with pytest.raises(KeyError):
        world["bronze"].read("no_such_source")


def test_quarantine_reasons_and_manifest_rollup(world):
    reasons = {(r["source_name"], r["reason"]): r["rows"] for r in world["bronze"].quarantine_reasons().collect()}
    assert reasons and set(k for _, k in reasons) <= {"unparseable_record", "missing_primary_key"}
    rolled = world["bronze"].inspect().agg(F.sum("quarantined"), F.sum("rows")).first()
    assert rolled[0] == sum(reasons.values()) and rolled[1] == sum(world["bronze"].read(s.name).count() for s in world["reg"].sources)


def test_landed_tables_in_the_catalog(spark, world):
    names = world["bronze"].register("landed_test")
    try:
        assert "`landed_test`.`partner_policies_a`" in names
        for n in ("partner_policies_a", "events_claims"):
            assert spark.table(f"landed_test.{n}").count() == world["bronze"].read(n).count()
            assert set(spark.table(f"landed_test.{n}").columns) == set(world["bronze"].read(n).columns)
        assert world["bronze"].register("landed_test") == names
    finally:
        spark.sql("drop database landed_test cascade")


def test_proof(world):
    told = {p.name: p for p in proof.prove(world["ctx"], world["bronze"])}
    assert len(told) == 10
    must = [n for n in told if "look-back" not in n and "check digit" not in n and "late claims" not in n and "another batch" not in n]
    assert all(told[n].passed for n in must), [told[n] for n in must if not told[n].passed]
    assert "loss_ratio" in proof.business_answers(world["ctx"]).columns


def test_merge_leaves_other_partitions_alone(spark, tmp_path):
    t = Table(spark, str(tmp_path / "p"))
    day = F.when(F.col("id") < 10, "2026-01-01").when(F.col("id") < 20, "a b/c:d").otherwise(F.lit(None))
    t.append(spark.range(30).select("id", F.lit("old").alias("v"), day.alias("dt")), ["dt"])
    was = set(t.version().files)
    assert len(was) == 3
    t.merge(spark.createDataFrame([(3, "new", "2026-01-01"), (99, "new", "2026-02-01")], "id long, v string, dt string"), ["id"])
    now = t.version()
    kept = was & set(now.files)
    assert len(kept) == 2 and not any("2026-01-01" in f for f in kept) and now.metrics["folders_replaced"] == 1
    assert t.read().count() == 31 and t.read().where("v = 'new'").count() == 2 and t.read(0).count() == 30
    # A key that moves to another partition leaves the one it was in.
    t.merge(spark.createDataFrame([(15, "moved", "2026-01-01")], "id long, v string, dt string"), ["id"])
    assert [(r["v"], r["dt"]) for r in t.read().where("id = 15").collect()] == [("moved", "2026-01-01")]
    t.delete_where(F.col("dt").isNull())
    assert t.read().count() == 21 and any(f in kept for f in t.version().files) is False or t.read().where("dt is null").isEmpty()
    t.optimize(files=2, zorder=["v"])
    assert t.read().count() == 21 and t.version().partition_by == ("dt",)
    t.vacuum()
    assert t.read().count() == 21 and sorted(t.read().columns) == ["dt", "id", "v"]


def test_many_appends_are_one_scan(spark, tmp_path):
    t = Table(spark, str(tmp_path / "m"))
    for i in range(6):
        t.append(spark.range(i, i + 1))
    plan = t.read()._jdf.queryExecution().toString()
    assert t.read().count() == 6 and plan.split("== Physical Plan ==")[1].count("FileScan parquet") == 1


def test_zorder_brings_text_and_numbers_together(spark, tmp_path):
    t = Table(spark, str(tmp_path / "z"))
    rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("n"), F.concat(F.lit("k"), F.lpad((F.col("id") * 31 % 2000).cast("string"), 4, "0")).alias("s"), F.when(F.col("id") % 5 > 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)).alias("far"))
    t.append(rows.repartition(8))
    t.optimize(files=8, zorder=["n", "s", "far"])
    spread = t.read().groupBy(F.col("_metadata.file_path") if False else F.input_file_name()).agg((F.max("n") - F.min("n")).alias("n"), (F.max(F.substring("s", 2, 4).cast("int")) - F.min(F.substring("s", 2, 4).cast("int"))).alias("s")).collect()
    assert t.read().count() == 2000 and len(spread) >= 6
    assert sum(r["n"] for r in spread) / len(spread) < 1500 and sum(r["s"] for r in spread) / len(spread) < 1500
