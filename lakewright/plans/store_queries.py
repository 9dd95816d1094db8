"""Table store, landing and streams as queries: what they keep of the given tables, each with an SQL form.

Tables, files and checkpoints stand in a folder of their own beside the warehouse's tables, which goes when the session ends.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lakewright.plans import model_queries, models
from lakewright.plans.catalogue import AS_OF, SQL, query, read
from lakewright.sources.bronze import Bronze
from lakewright.sources.registry import Registry, Source
from lakewright.sources.tablestore import Table
from lakewright.streaming import land_stream


def _folder(spark, name: str) -> str:
    """A new folder that all machines see, removed with the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


@query("""
select o_orderkey, cast(case o_orderstatus when 'F' then cast(floor(o_totalprice) as decimal(18, 2)) when 'O' then cast(o_totalprice as decimal(18, 2)) else cast(floor(o_totalprice) as decimal(18, 2)) end as double) as price,
  case o_orderstatus when 'F' then cast(o_custkey as varchar) when 'O' then 'C' || o_custkey else cast(o_custkey + 3000000000 as varchar) end as customer,
  case when o_orderstatus = 'O' then cast(o_orderdate as timestamp) + interval 90 minute else cast(cast(o_orderdate as date) as timestamp) end as placed,
  case when o_orderstatus = 'P' then o_orderpriority end as priority
from orders
""")
def schema_evolution(spark, sf_dir):
    """Three appends whose columns change type: whole numbers meet decimals, numbers meet text, dates meet times, a column is new."""
    orders = read(spark, sf_dir, "orders")
    price, day, key = F.col("o_totalprice"), F.col("o_orderdate").cast("date"), F.col("o_custkey")
    table = Table(spark, f"{_folder(spark, 'evolution')}/orders")
    table.append(orders.where("o_orderstatus = 'F'").select("o_orderkey", F.floor(price).cast("int").alias("price"), key.cast("int").alias("customer"), day.alias("placed")))
    later = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.expr("interval 90 minute")
    table.append(orders.where("o_orderstatus = 'O'").select("o_orderkey", price.cast("decimal(18,2)").alias("price"), F.concat(F.lit("C"), key.cast("string")).alias("customer"), later.alias("placed")))
    table.append(orders.where("o_orderstatus = 'P'").select("o_orderkey", F.floor(price).cast("long").alias("price"), (key + F.lit(3_000_000_000)).alias("customer"), day.alias("placed"), F.col("o_orderpriority").alias("PRIORITY")))
    return table.read().select("o_orderkey", F.col("price").cast("double").alias("price"), "customer", "placed", F.col("priority").alias("priority"))


@query("""
select s as source, event_type, count(*) as n, cast(sum(event_id) as bigint) as total, 0 as twice
from events, (values ('first'), ('second')) as t(s) group by all
""")
def stream_once(spark, sf_dir):
    """Two streams into one table, the first run again, then begun anew with another checkpoint: every row once for each stream."""
    folder = _folder(spark, "streams")
    files, table = read(spark, sf_dir, "events"), Table(spark, f"{folder}/events")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    for source, checkpoint in (("first", "a"), ("second", "b"), ("first", "a"), ("first", "c")):
        land_stream(spark, source, f"{sf_dir}/events.parquet", ddl, "parquet", table, f"{folder}/{checkpoint}", ["event_id"]).awaitTermination()
    landed = table.read()
    per_row = landed.groupBy("_source_name", "event_id", "event_type").agg(F.count("*").alias("k"))
    return per_row.groupBy(F.col("_source_name").alias("source"), "event_type").agg(F.sum("k").alias("n"), F.sum("event_id").alias("total"), F.count_if(F.col("k") > 1).cast("int").alias("twice"))


@query("""
select make_date(year(o_orderdate), 1, 1) as batch_date, case when year(o_orderdate) < 1998 then 1 else 2 end as landing, count(*) filter (o_orderkey % 50 <> 0) as row_count,
  count(*) filter (o_orderkey % 50 = 0) as quarantined_count, cast(sum(o_orderkey) filter (o_orderkey % 50 <> 0) as bigint) as keys_landed, case when year(o_orderdate) < 1998 then '' else 'o_orderpriority' end as added
from orders group by all
""")
def landing_manifest(spark, sf_dir):
    """Orders as CSV files of a folder per year, landed in two runs and once more: what the manifest, the rejects and the rows say.

    Every fiftieth order has a blank key and is refused; the files of later years have a column more.
    """
    folder, orders = _folder(spark, "landing"), read(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    rows = orders.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority", F.concat(year.cast("string"), F.lit("-01-01")).alias("dt"))
    source = Source("orders", "orders by year", "csv", "orders/dt=*/*.csv", {"header": "true"}, ("o_orderkey",))
    bronze = Bronze(spark, Registry((source,), f"{folder}/in", f"{folder}/bronze"))
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows.where(year < 1998).drop("o_orderpriority").write.partitionBy("dt").option("header", "true").csv(f"{folder}/in/orders")
    bronze.ingest("orders", "1", at)
    rows.where(year >= 1998).write.mode("append").partitionBy("dt").option("header", "true").csv(f"{folder}/in/orders")
    bronze.ingest("orders", "2", at)
    bronze.ingest("orders", "3", at)
    landed = bronze.read("orders").groupBy("_batch_date").agg(F.sum(F.col("o_orderkey").cast("long")).alias("keys_landed"))
    told = bronze.manifest.read().groupBy("batch_date", F.col("batch_id").cast("int").alias("landing")).agg(F.sum("row_count").alias("row_count"), F.sum("quarantined_count").alias("quarantined_count"))
    audit = bronze.audit.read().select(F.col("batch_id").cast("int").alias("landing"), F.col("added_columns").alias("added"))
    out = told.join(landed, told["batch_date"] == landed["_batch_date"]).join(audit, "landing", "left")
    return out.select("batch_date", "landing", "row_count", "quarantined_count", "keys_landed", F.coalesce("added", F.lit("")).alias("added"))


def _incremental(spark, name: str, feeds: dict, staged: dict):
    """A silver table first built from two batches, then brought up to date after a third, by the keys that the last two touched."""
    folder = _folder(spark, name)
    landing = lambda f: Table(spark, f"{folder}/bronze/{f}")
    drawn = F.crc32(F.col("_record_hash").cast("binary")) % 8
    run = models.Run(spark, f"{folder}/warehouse", lambda f: landing(f).read(), AS_OF, dt.datetime(2001, 8, 1), salt="pepper", landing=landing, frames=staged)
    for batches in ({dt.date(2000, 6, 1): drawn > 1, dt.date(2001, 1, 1): drawn == 1}, {AS_OF: drawn == 0}):
        for f, df in feeds.items():
            for batch, rows in batches.items():
                landing(f).append(df.where(rows).withColumn("_batch_date", F.lit(batch)), ["_batch_date"])
        for stage in models.MODELS[name].inputs:
            if stage not in staged:
                run.frames[stage] = models.MODELS[stage].build(run, *[landing(f).read() for f in models.MODELS[stage].inputs])
        models._materialise(run, models.MODELS[name], lambda: models.MODELS[name].build(run, *[run.frames[i] for i in models.MODELS[name].inputs]))
        run.frames = dict(staged)
    return run.table(name).read()


@query(SQL["silver_claims"])
def silver_claims_incremental(spark, sf_dir):
    """Claims by touched keys, in two batches: the same rows as the full build."""
    feeds = {"events_claims": model_queries._internal_claims(spark, sf_dir)} | dict(zip(models.CLAIM_NAMES, model_queries._partner_claims(spark, sf_dir), strict=True))
    return model_queries.claims_columns(_incremental(spark, "silver_claims", feeds, {"stg_fx_rates": model_queries._spine(spark, sf_dir)}))


@query(SQL["silver_premium_payments"])
def silver_payments_incremental(spark, sf_dir):
    feeds = {"events_premium_payments": model_queries._payments(spark, sf_dir)}
    return model_queries.payment_columns(_incremental(spark, "silver_premium_payments", feeds, {"stg_fx_rates": model_queries._spine(spark, sf_dir)}))
