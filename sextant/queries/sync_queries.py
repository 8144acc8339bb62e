"""Incremental and streaming operators (R1-R7, J12, K3, Z5, Z7, Z20) over events and changed copies of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..streaming import sync
from .base import FILES, files, query, table

E = F.expr
PATH = "'f' || (event_id % 20)"
BURSTS = f"""(SELECT user_id AS project, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, list_sort(list_distinct(list({PATH}))) AS paths FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, island)"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), "ts", E("concat('f', event_id % 20)").alias("path"))


@query(f"SELECT project, epoch_us(start) AS started, epoch_us(\"end\") AS ended, n, array_to_string(paths, '|') AS paths FROM {BURSTS}")
def r2_debounce(spark, sf_dir):
    """With R5, the dirty paths of each burst. The gap is in hours, as this table's events are far apart."""
    out = sync.bursts(events(spark, sf_dir), "6 hours")
    return out.select("project", F.unix_micros(F.col("start").cast("timestamp")).alias("started"), F.unix_micros(F.col("end").cast("timestamp")).alias("ended"), "n", F.array_join("paths", "|").alias("paths"))


@query("SELECT user_id AS project, event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def r1_event_stream(spark, sf_dir):
    """A structured stream over the events, run until the source is used up, with R4: what arrives meanwhile is the next batch's."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"events_{uuid.uuid4().hex}"
    counted = stream.groupBy(F.col("user_id").alias("project"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    base = sync.shared_folder(spark)
    counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def states(spark, sf_dir):
    """The index, and a scan in which some files are gone, touched, edited or new."""
    f = files(spark, sf_dir).select("doc_id", "path", F.length("text").cast("long").alias("size"), E(text.content_hash("path", "text")).alias("hash"))
    index = f.where("doc_id % 11 <> 0").select("path", "size", F.lit(1.0).alias("mtime_ms"), "hash")
    edited = "doc_id % 5 = 0"
    scan = f.where("doc_id % 13 <> 0").select("path", E(f"size + if({edited}, 1, 0)").alias("size"), E("if(doc_id % 3 = 0 or doc_id % 5 = 0, 2.0D, 1.0D)").alias("mtime_ms"), E(f"if({edited}, md5(hash), hash)").alias("hash"))
    return scan, index


ACTION = "CASE WHEN doc_id % 13 = 0 THEN 'drop' WHEN doc_id % 11 = 0 THEN 'add' WHEN doc_id % 5 = 0 THEN 'rechunk' WHEN doc_id % 3 = 0 THEN 'refresh' ELSE 'reuse' END"
THERE = "NOT (doc_id % 13 = 0 AND doc_id % 11 = 0)"


@query(f"SELECT path, {ACTION} AS action FROM {FILES} WHERE {THERE}")
def r7_sync_actions(spark, sf_dir):
    return sync.actions(*states(spark, sf_dir))


@query(f"SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'changed' END AS state FROM {FILES} WHERE {THERE} AND {ACTION} IN ('drop', 'add', 'rechunk', 'refresh')")
def j12_changed_and_deleted(spark, sf_dir):
    """Semi and anti joins of scan and index; with Z7, equality of statistics."""
    scan, index = states(spark, sf_dir)
    same = E("s.path = i.path and s.size = i.size and abs(s.mtime_ms - i.mtime_ms) < 0.001D")
    changed = scan.alias("s").join(index.alias("i"), same, "left_anti").select("path", F.lit("changed").alias("state"))
    return changed.union(index.join(scan, "path", "left_anti").select("path", F.lit("deleted").alias("state")))


@query(f"SELECT path, CASE WHEN {ACTION} IN ('add', 'rechunk') THEN 2 ELSE 1 END AS version FROM {FILES} WHERE {THERE} AND doc_id % 13 <> 0")
def k3_incremental_upsert(spark, sf_dir):
    scan, index = states(spark, sf_dir)
    todo = sync.actions(scan, index)
    return sync.upsert(index.select("path", F.lit(1).alias("version")), scan.select("path", F.lit(2).alias("version")), todo)


@query(f"SELECT path, 'rechunk' AS action FROM {FILES} WHERE {THERE} AND starts_with(path, 'src1/en/') AND {ACTION} = 'rechunk' UNION ALL SELECT path, 'refresh' FROM {FILES} WHERE {THERE} AND starts_with(path, 'src1/en/') AND {ACTION} IN ('reuse', 'refresh')")
def r5_dirty_prefix(spark, sf_dir):
    """Files below a dirty prefix are verified though their statistics are equal."""
    scan, index = states(spark, sf_dir)
    return sync.actions(scan, index, sync.verify_below(["src1/en"])).where("startswith(path, 'src1/en/') and action in ('rechunk', 'refresh')")


@query(f"SELECT action, CAST(count(*) AS BIGINT) AS n FROM (SELECT {ACTION} AS action FROM {FILES} WHERE {THERE}) GROUP BY action")
def z20_sync_report(spark, sf_dir):
    """With Z5, counters carried by action."""
    return sync.actions(*states(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT user_id, epoch_us(ts) AS us, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN true ELSE false END AS verify FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def r6_verify_due(spark, sf_dir):
    """Checks that come later than the interval after the one before verify contents."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), E("true").alias("x"), (F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("interval '1' day"))).alias("verify")).drop("x")
