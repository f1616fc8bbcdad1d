"""Scan and sink queries: the given tables written and read back in each supported form."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.operators import validate as V
from watchfold.plans import bindings as B
from watchfold.plans.drives import LABEL_SQL, labelled
from watchfold.plans.registry import query
from watchfold.session import scratch_path
from watchfold.sources import tables as T, topology as G
from watchfold.sources.tables import load


@query("csv_event_scan", "SELECT event_id, epoch_us(ts) // 1000000 AS ts_s, user_id, event_type, value FROM events")
def csv_event_scan(spark, sf):
    path = scratch_path(spark, "csv")
    T.write_csv(load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "user_id", "event_type", "value"), path)
    schema = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE"
    return T.read_csv(spark, path, schema, ["event_id", "ts", "event_type"]).withColumn("ts_s", F.unix_seconds("ts")).drop("ts")


@query("coerced_timestamps", f"SELECT event_type, count(*) AS rows, count(*) FILTER ({B.K_SQL} >= 10) AS parsed, count(*) FILTER ({B.K_SQL} < 10) AS coerced FROM events GROUP BY 1")
def coerced_timestamps(spark, sf):
    e = load(spark, sf, "events").withColumn("k", B.k_value())
    raw = e.select("event_type", F.when(F.col("k") < 5, "not a time").when(F.col("k") < 10, "2024-13-45T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"))
    return T.timestamp_report(raw, "timestamp", ["event_type"])


@query("quarantined_timestamps", f"SELECT event_id, CASE WHEN {B.K_SQL} < 5 THEN 'not a time' ELSE '2024-13-45' END AS timestamp FROM events WHERE {B.K_SQL} < 10")
def quarantined_timestamps(spark, sf):
    e = load(spark, sf, "events").withColumn("k", B.k_value())
    raw = e.select("event_id", F.when(F.col("k") < 5, "not a time").when(F.col("k") < 10, "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"))
    return T.split_bad_timestamps(raw, "timestamp")[1]


def period_store(spark, sf):
    path = scratch_path(spark, "periods")
    labelled(spark, sf).write.partitionBy("period").parquet(path)
    return path


@query("labelled_period_scan", LABEL_SQL + " SELECT serial_number, strftime(date, '%Y-%m-%d') AS date, target FROM lab WHERE period IN ('1997H1', '1997H2') AND target IS NOT NULL")
def labelled_period_scan(spark, sf):
    df = T.labelled_scan(spark, period_store(spark, sf), ["serial_number", "date", "target"], "target", ["1997H1", "1997H2"], locked_periods=("2001H2",))
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("full_label_scan", LABEL_SQL + " SELECT target, count(*) AS rows, count(DISTINCT serial_number) AS drives FROM lab WHERE target IS NOT NULL GROUP BY 1")
def full_label_scan(spark, sf):
    df = T.labelled_scan(spark, period_store(spark, sf), ["serial_number", "target"], "target")
    return df.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("serial_number").alias("drives"))


@query("daily_file_inventory", "WITH " + B.ENTITY_DAYS_SQL + " SELECT period, count(*) AS rows, count(DISTINCT serial_number) AS serials, count(*) FILTER (failure = 1) AS failure_rows FROM days GROUP BY period")
def daily_file_inventory(spark, sf):
    """One CSV file per period, inventoried by file name."""
    path = scratch_path(spark, "daily")
    B.entity_days(spark, sf).select("serial_number", "failure", "period").repartition("period").write.option("header", True).partitionBy("period").csv(path)
    found = T.file_inventory(spark, path, "serial_number", "failure")
    return found.select(F.regexp_extract("file", "period=([^/]+)/", 1).alias("period"), "rows", "serials", "failure_rows")


@query("compact_extract", "WITH " + B.ENTITY_DAYS_SQL + " SELECT period, count(*) AS rows, round(sum(value), 2) AS total FROM days WHERE model IN ('MF', 'MO') GROUP BY 1")
def compact_extract(spark, sf):
    path = scratch_path(spark, "extract")
    keep = spark.createDataFrame([("MF",), ("MO",)], "model string")
    T.write_periods(B.entity_days(spark, sf), path, keep, "model", ["serial_number", "date", "value"])
    return spark.read.parquet(path).groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query("json_lines_round_trip", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def json_lines_round_trip(spark, sf):
    path = scratch_path(spark, "jsonl")
    d = load(spark, sf, "documents").select("doc_id", "lang", "text")
    T.write_json_lines(d, path)
    return T.read_json_lines(spark, path, d.schema).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("topology_tree_edges", """SELECT 'Zone' AS src_type, 'N' || n_nationkey AS src, 'PART_OF' AS rel, 'DataCenter' AS dst_type, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT DISTINCT 'Rack', 'K-' || c_nationkey || '-' || c_mktsegment, 'LOCATED_IN', 'Zone', 'N' || c_nationkey FROM customer
 UNION ALL SELECT 'Server', 'S' || min(c_custkey), 'LOCATED_IN', 'Rack', 'K-' || c_nationkey || '-' || c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment""")
def topology_tree_edges(spark, sf):
    """Nested site documents (data center > zone > rack > first server) written as JSON, read and flattened.

    A site document lists zones and racks, which are few by nature."""
    c = load(spark, sf, "customer")
    rack = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    racks = rack.groupBy("c_nationkey").agg(F.collect_list(F.struct(
        F.concat_ws("-", F.lit("K"), "c_nationkey", "c_mktsegment").alias("rack_id"),
        F.array(F.struct(F.concat(F.lit("S"), "first").alias("server_id"), F.lit("HIGH").alias("criticality"))).alias("servers"))).alias("racks"))
    z = load(spark, sf, "nation").join(racks, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = z.groupBy("r_name").agg(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("zone_id"), F.lit("HIGH").alias("criticality"), "racks")).alias("zones")) \
            .select(F.struct(F.col("r_name").alias("data_center_id"), "zones").alias("data_center"))
    path = scratch_path(spark, "tree")
    tree.write.json(path)
    return G.flatten_tree(spark.read.schema(G.TREE).json(path))["edges"]


PART_IDS = 1000  # a site document lists devices of a range of so many ids, so that none grows with the site

WHOLE_TREE = """WITH z AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS zone, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 servers AS (SELECT 'S' || c_custkey AS server, 'K-' || c_nationkey || '-' || c_mktsegment AS rack, zone FROM customer JOIN z ON c_nationkey = k),
 devices AS (SELECT s_suppkey AS d, zone FROM supplier JOIN z ON s_nationkey = k)
 SELECT 'Zone' AS src_type, zone AS src, 'PART_OF' AS rel, 'DataCenter' AS dst_type, r_name AS dst FROM z
 UNION ALL SELECT DISTINCT 'Rack', rack, 'LOCATED_IN', 'Zone', zone FROM servers
 UNION ALL SELECT 'Server', server, 'LOCATED_IN', 'Rack', rack FROM servers
 UNION ALL SELECT 'Equipment', 'EQUIPMENT' || d, 'LOCATED_IN', 'Zone', zone FROM devices
 UNION ALL SELECT 'Camera', 'CAMERA' || d, 'MONITORS', 'Target', zone FROM devices
 UNION ALL SELECT 'Camera', 'CAMERA' || d, 'MONITORS', 'Target', 'EQUIPMENT' || d FROM devices
 UNION ALL SELECT 'Sensor', 'SENSOR' || d, 'MONITORS', 'Target', 'EQUIPMENT' || d FROM devices
 UNION ALL SELECT 'Person', 'P' || c_custkey, 'AUTHORIZED_FOR', 'Zone', zone FROM customer JOIN z ON c_nationkey = k WHERE c_acctbal > 0"""


@query("topology_whole_tree", WHOLE_TREE)
def topology_whole_tree(spark, sf):
    """Every branch of the site: zones, racks with all servers, cameras, sensors, equipment, people with their grants.

    The site is written as many documents, each with a bounded part of one zone, and read back as JSON lines: no task holds a
    whole zone. Parts name their zone and rack again, so edges are made distinct.
    """
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key))
    part = lambda key: F.floor(F.col(key) / PART_IDS).alias("part")
    zones = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = load(spark, sf, "customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
    s = load(spark, sf, "supplier").join(zones, F.col("s_nationkey") == F.col("n_nationkey"))

    def documents(rows, *lists):
        zone = F.struct(name("N", "n_nationkey").alias("zone_id"), F.lit("HIGH").alias("criticality"), *lists)
        return rows.select(F.to_json(F.struct(F.struct(F.col("r_name").alias("data_center_id"), F.array(zone).alias("zones")).alias("data_center"))).alias("value"))

    server = F.struct(name("S", "c_custkey").alias("server_id"), F.lit("HIGH").alias("criticality"))
    rack_parts = c.groupBy("r_name", "n_nationkey", "c_mktsegment", part("c_custkey")).agg(F.collect_list(server).alias("servers"))
    rack = F.struct(F.concat(F.lit("K-"), "n_nationkey", F.lit("-"), "c_mktsegment").alias("rack_id"), "servers")
    equipment = name("EQUIPMENT", "s_suppkey")
    device_parts = s.groupBy("r_name", "n_nationkey", part("s_suppkey")).agg(
        F.collect_list(F.struct(name("CAMERA", "s_suppkey").alias("camera_id"), F.array(name("N", "n_nationkey"), equipment).alias("monitors"))).alias("cameras"),
        F.collect_list(F.struct(name("SENSOR", "s_suppkey").alias("sensor_id"), F.array(equipment).alias("monitors"))).alias("sensors"),
        F.collect_list(F.struct(equipment.alias("equipment_id"))).alias("equipment"))
    granted = F.when(F.col("c_acctbal") > 0, F.array(name("N", "c_nationkey"))).otherwise(F.array().cast("array<string>"))
    person = F.struct(name("P", "c_custkey").alias("person_id"), F.lit("STAFF").alias("role"), granted.alias("authorized_zones"))
    people_parts = c.groupBy(part("c_custkey")).agg(F.collect_list(person).alias("people")).select(F.to_json(F.struct("people")).alias("value"))
    path = scratch_path(spark, "whole_tree")
    (documents(zones).unionByName(documents(rack_parts, F.array(rack).alias("racks"))).unionByName(documents(device_parts, "cameras", "sensors", "equipment"))
     .unionByName(people_parts).write.text(path))
    return G.flatten_tree(G.read_tree(spark, path, lines=True))["edges"].distinct()


@query("union_of_event_kinds", "SELECT kind, count(*) AS n FROM (SELECT 'order' AS kind FROM orders UNION ALL SELECT 'event' FROM events UNION ALL SELECT 'document' FROM documents) GROUP BY 1")
def union_of_event_kinds(spark, sf):
    part = lambda t, k, key: load(spark, sf, t).select(F.lit(k).alias("kind"), F.col(key).alias("key"))
    u = part("orders", "order", "o_orderkey").unionByName(part("events", "event", "event_id")).unionByName(part("documents", "document", "doc_id"))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_sample_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sample_keys(spark, sf):
    return V.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
