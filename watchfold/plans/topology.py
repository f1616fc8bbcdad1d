"""Topology, envelope and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.functions import ids
from watchfold.operators import assess, bayes, envelope as E, integrity, validate as V
from watchfold.plans import bindings as B
from watchfold.plans.auth import READINGS_SQL, readings
from watchfold.plans.pairs import ABN_SQL, DOMAIN_SQL, NODES, scenario_events
from watchfold.operators import pairs as P
from watchfold.plans.registry import query
from watchfold.sources import topology as G
from watchfold.sources.tables import load

S = lambda c: F.col(c).cast("string")


def servers(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.concat(F.lit("S"), "c_custkey").alias("server_id"), F.concat_ws("-", F.lit("K"), "c_nationkey", "c_mktsegment").alias("rack_id"), F.concat(F.lit("N"), "c_nationkey").alias("zone_id"),
                    F.when(F.col("c_acctbal") > 5000, "HIGH").otherwise("MEDIUM").alias("criticality"))


def zones(spark, sf):
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("N"), "n_nationkey").alias("zone_id"), F.col("r_name").alias("data_center_id"), F.col("n_name").alias("zone_name"))


def devices(spark, sf, kind):
    s = load(spark, sf, "supplier")
    return s.select(F.concat(F.lit(kind), "s_suppkey").alias(f"{kind.lower()}_id"), F.concat(F.lit("N"), "s_nationkey").alias("zone_id"))


def people(spark, sf):
    return load(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("person_id"))


def grants(spark, sf):
    c = load(spark, sf, "customer").where("c_acctbal > 0")
    return c.select(F.concat(F.lit("P"), "c_custkey").alias("person_id"), F.concat(F.lit("N"), "c_nationkey").alias("zone_id"))


TOPO = """WITH servers AS (SELECT 'S' || c_custkey AS server_id, 'K-' || c_nationkey || '-' || c_mktsegment AS rack_id, 'N' || c_nationkey AS zone_id, CASE WHEN c_acctbal > 5000 THEN 'HIGH' ELSE 'MEDIUM' END AS criticality FROM customer),
zones AS (SELECT 'N' || n_nationkey AS zone_id, r_name AS data_center_id, n_name AS zone_name FROM nation JOIN region ON n_regionkey = r_regionkey),
sensors AS (SELECT 'SENSOR' || s_suppkey AS sensor_id, 'N' || s_nationkey AS zone_id FROM supplier), cameras AS (SELECT 'CAMERA' || s_suppkey AS camera_id, 'N' || s_nationkey AS zone_id FROM supplier),
equipment AS (SELECT 'EQUIPMENT' || s_suppkey AS equipment_id, 'N' || s_nationkey AS zone_id FROM supplier),
people AS (SELECT 'P' || c_custkey AS person_id FROM customer), grants AS (SELECT 'P' || c_custkey AS person_id, 'N' || c_nationkey AS zone_id FROM customer WHERE c_acctbal > 0), """ + B.NODES_SQL


def refs(spark, sf):
    """Events with one of five kinds of topology reference."""
    n = B.nodes(spark, sf)
    pick = lambda cond, prefix: F.when(cond, F.concat(F.lit(prefix), "user_id"))
    k = F.col("kind")
    return n.select(F.col("id").alias("event_id"), "kind", "state", "ts", "k", "user_id", pick((k == "ssh") & (F.col("k") >= 5), "S").alias("server_id"), pick(k == "maintenance", "D").alias("asset_id"),
                    pick((k == "environment") & (F.col("k") >= 50), "SENSOR").alias("sensor_id"), pick((k == "environment") & (F.col("k") < 50), "EQUIPMENT").alias("equipment_id"),
                    pick(k.isin("face", "ppe"), "CAMERA").alias("camera_id"),
                    F.when(k == "ssh", F.concat(F.lit("10.0.0."), F.col("user_id") % 256)).alias("source_ip"))


REFS = """, refs AS (SELECT id AS event_id, kind, state, ts, k, user_id, CASE WHEN kind='ssh' AND k >= 5 THEN 'S' || user_id END AS server_id, CASE WHEN kind='maintenance' THEN 'D' || user_id END AS asset_id,
 CASE WHEN kind='environment' AND k >= 50 THEN 'SENSOR' || user_id END AS sensor_id, CASE WHEN kind='environment' AND k < 50 THEN 'EQUIPMENT' || user_id END AS equipment_id, CASE WHEN kind IN ('face','ppe') THEN 'CAMERA' || user_id END AS camera_id,
 CASE WHEN kind='ssh' THEN '10.0.0.' || (user_id % 256) END AS source_ip FROM nodes), hosted AS (SELECT 'D' || c_custkey AS asset_id, 'S' || c_custkey AS server_id FROM customer)"""


def hosted(spark, sf):
    return load(spark, sf, "customer").select(F.concat(F.lit("D"), "c_custkey").alias("asset_id"), F.concat(F.lit("S"), "c_custkey").alias("server_id"))


@query("event_topology_resolution", TOPO + REFS + """ SELECT event_id, coalesce(d.server_id, a.server_id) AS resolved_server, coalesce(d.rack_id, a.rack_id) AS resolved_rack, coalesce(d.zone_id, a.zone_id, s.zone_id, e.zone_id, c.zone_id) AS resolved_zone,
 CASE WHEN d.zone_id IS NOT NULL THEN 'DIRECT_SERVER' WHEN a.zone_id IS NOT NULL THEN 'HOSTED_ASSET' WHEN s.zone_id IS NOT NULL THEN 'SENSOR' WHEN e.zone_id IS NOT NULL THEN 'EQUIPMENT' WHEN c.zone_id IS NOT NULL THEN 'CAMERA' END AS origin
 FROM refs r LEFT JOIN servers d ON d.server_id = r.server_id LEFT JOIN hosted h ON h.asset_id = r.asset_id LEFT JOIN servers a ON a.server_id = h.server_id LEFT JOIN sensors s ON s.sensor_id = r.sensor_id LEFT JOIN equipment e ON e.equipment_id = r.equipment_id LEFT JOIN cameras c ON c.camera_id = r.camera_id
 WHERE coalesce(d.zone_id, a.zone_id, s.zone_id, e.zone_id, c.zone_id) IS NOT NULL""")
def event_topology_resolution(spark, sf):
    return G.resolve_contexts(refs(spark, sf), servers(spark, sf), hosted(spark, sf), devices(spark, sf, "SENSOR"), devices(spark, sf, "EQUIPMENT"), devices(spark, sf, "CAMERA"))


@query("event_edges", TOPO + REFS + """, ed AS (SELECT event_id AS src, 'TARGETS' AS rel, 'Server' AS dst_type, server_id AS dst FROM refs UNION ALL SELECT event_id, 'TARGETS', 'Asset', asset_id FROM refs UNION ALL SELECT event_id, 'OBSERVED_BY', 'Sensor', sensor_id FROM refs
 UNION ALL SELECT event_id, 'TARGETS', 'Equipment', equipment_id FROM refs UNION ALL SELECT event_id, 'OBSERVED_BY', 'Camera', camera_id FROM refs UNION ALL SELECT event_id, 'ORIGINATED_FROM', 'SourceIP', source_ip FROM refs),
 known AS (SELECT 'Server' AS dst_type, server_id AS dst FROM servers UNION ALL SELECT 'Asset', asset_id FROM hosted UNION ALL SELECT 'Sensor', sensor_id FROM sensors UNION ALL SELECT 'Equipment', equipment_id FROM equipment UNION ALL SELECT 'Camera', camera_id FROM cameras UNION ALL SELECT DISTINCT 'SourceIP', source_ip FROM refs WHERE source_ip IS NOT NULL)
 SELECT 'Event' AS src_type, src, rel, ed.dst_type, ed.dst, EXISTS (SELECT 1 FROM known WHERE known.dst_type = ed.dst_type AND known.dst = ed.dst) AS accepted FROM ed WHERE ed.dst IS NOT NULL""")
def event_edges(spark, sf):
    r = refs(spark, sf)
    edges = G.emit_edges(r, {"server_id": ("TARGETS", "Server", ""), "asset_id": ("TARGETS", "Asset", ""), "sensor_id": ("OBSERVED_BY", "Sensor", ""), "equipment_id": ("TARGETS", "Equipment", ""),
                             "camera_id": ("OBSERVED_BY", "Camera", ""), "source_ip": ("ORIGINATED_FROM", "SourceIP", "")})
    known = lambda df, kind, key: df.select(F.lit(kind).alias("dst_type"), F.col(key).alias("dst"))
    k = known(servers(spark, sf), "Server", "server_id").unionByName(known(hosted(spark, sf), "Asset", "asset_id"))
    for name in ("Sensor", "Equipment", "Camera"):
        k = k.unionByName(known(devices(spark, sf, name.upper()), name, f"{name.lower()}_id"))
    k = k.unionByName(known(r.where("source_ip IS NOT NULL").select("source_ip").distinct(), "SourceIP", "source_ip"))
    good, bad = G.split_referential(edges, k)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query("topology_validation", TOPO + """ SELECT 'UNKNOWN_TARGET' AS rule, sensor_id AS item FROM sensors WHERE zone_id NOT IN (SELECT zone_id FROM zones) UNION ALL SELECT 'DUPLICATE_SEGMENT', c_mktsegment FROM customer GROUP BY c_mktsegment HAVING count(*) > 1 UNION ALL SELECT 'UNKNOWN_ZONE', person_id FROM grants WHERE zone_id NOT IN (SELECT zone_id FROM zones WHERE data_center_id <> 'ASIA')""")
def topology_validation(spark, sf):
    seg = load(spark, sf, "customer").select("c_mktsegment")
    known = zones(spark, sf).where("data_center_id <> 'ASIA'")
    sensors = devices(spark, sf, "SENSOR").select(F.col("sensor_id").alias("watcher"), F.col("zone_id").alias("target"))
    return G.validate_topology({"server": (servers(spark, sf), "server_id"), "segment": (seg, "c_mktsegment")}, known, grants(spark, sf), sensors, zones(spark, sf).select(F.col("zone_id").alias("target")))


@query("topology_hierarchy", TOPO + " SELECT data_center_id, zones.zone_id, rack_id, server_id FROM servers JOIN zones USING (zone_id)")
def topology_hierarchy(spark, sf):
    return servers(spark, sf).join(zones(spark, sf), "zone_id").select("data_center_id", "zone_id", "rack_id", "server_id")


@query("topology_node_counts", TOPO + """ SELECT 'Server' AS node_type, count(*) AS n FROM servers UNION ALL SELECT 'Rack', count(DISTINCT rack_id) FROM servers UNION ALL SELECT 'Zone', count(*) FROM zones UNION ALL SELECT 'DataCenter', count(DISTINCT data_center_id) FROM zones UNION ALL SELECT 'Sensor', count(*) FROM sensors UNION ALL SELECT 'Person', count(*) FROM people""")
def topology_node_counts(spark, sf):
    s, z = servers(spark, sf), zones(spark, sf)
    one = lambda df, name, c: df.agg(c.alias("n")).select(F.lit(name).alias("node_type"), "n")
    n = F.count(F.lit(1))
    parts = [one(s, "Server", n), one(s, "Rack", F.count_distinct("rack_id")), one(z, "Zone", n), one(z, "DataCenter", F.count_distinct("data_center_id")), one(devices(spark, sf, "SENSOR"), "Sensor", n), one(people(spark, sf), "Person", n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("topology_zone_contents", TOPO + " SELECT zone_id, 'Server' AS node_type, count(*) AS n FROM servers GROUP BY 1 UNION ALL SELECT zone_id, 'Sensor', count(*) FROM sensors GROUP BY 1 UNION ALL SELECT zone_id, 'Camera', count(*) FROM cameras GROUP BY 1")
def topology_zone_contents(spark, sf):
    t = lambda df, name: df.select("zone_id", F.lit(name).alias("node_type"))
    return t(servers(spark, sf), "Server").unionByName(t(devices(spark, sf, "SENSOR"), "Sensor")).unionByName(t(devices(spark, sf, "CAMERA"), "Camera")).groupBy("zone_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("topology_server_location", TOPO + " SELECT DISTINCT s.server_id, s.rack_id, s.zone_id, data_center_id FROM nodes n JOIN servers s ON s.server_id = 'S' || n.user_id JOIN zones z ON z.zone_id = s.zone_id")
def topology_server_location(spark, sf):
    wanted = B.nodes(spark, sf).select(F.concat(F.lit("S"), "user_id").alias("server_id")).distinct()
    return wanted.join(servers(spark, sf), "server_id").join(zones(spark, sf), "zone_id").select("server_id", "rack_id", "zone_id", "data_center_id")


@query("topology_monitors", TOPO + " SELECT 'Camera' AS kind, camera_id AS device, zone_id FROM cameras UNION ALL SELECT 'Sensor', sensor_id, zone_id FROM sensors")
def topology_monitors(spark, sf):
    t = lambda kind: devices(spark, sf, kind.upper()).select(F.lit(kind).alias("kind"), F.col(f"{kind.lower()}_id").alias("device"), "zone_id")
    return t("Camera").unionByName(t("Sensor"))


@query("topology_authorizations", TOPO + " SELECT person_id, zone_name, data_center_id FROM grants JOIN zones USING (zone_id)")
def topology_authorizations(spark, sf):
    return grants(spark, sf).join(zones(spark, sf), "zone_id").select("person_id", "zone_name", "data_center_id")


VISITS = """, visits AS (SELECT id, CASE WHEN k >= 3 THEN 'P' || (user_id * CASE WHEN k >= 95 THEN 1000000 ELSE 1 END) END AS person_id, 'N' || (k % 27) AS zone_id, state FROM nodes WHERE kind = 'face'),
 za AS (SELECT v.*, CASE WHEN g.person_id IS NOT NULL THEN 'AUTHORIZED' WHEN p.person_id IS NOT NULL AND z.zone_id IS NOT NULL THEN 'UNAUTHORIZED' ELSE 'UNKNOWN' END AS status,
  CASE WHEN v.person_id IS NULL THEN 'IDENTITY_NOT_RECOGNIZED' WHEN p.person_id IS NULL THEN 'PERSON_NOT_IN_TOPOLOGY' WHEN z.zone_id IS NULL THEN 'ZONE_NOT_IN_TOPOLOGY' ELSE 'GRAPH_RELATIONSHIP_CHECK' END AS reason
  FROM visits v LEFT JOIN people p ON p.person_id = v.person_id LEFT JOIN zones z ON z.zone_id = v.zone_id LEFT JOIN grants g ON g.person_id = v.person_id AND g.zone_id = v.zone_id)"""


def authorized_visits(spark, sf):
    v = B.nodes(spark, sf).where("kind = 'face'").select("id", F.when(F.col("k") >= 3, F.concat(F.lit("P"), F.col("user_id") * F.when(F.col("k") >= 95, 1000000).otherwise(1))).alias("person_id"),
                                                         F.concat(F.lit("N"), F.col("k") % 27).alias("zone_id"), "state")
    return G.zone_authorization(v, people(spark, sf), zones(spark, sf), grants(spark, sf))


@query("zone_authorization", TOPO + VISITS + " SELECT id, person_id, zone_id, status, reason FROM za")
def zone_authorization(spark, sf):
    return authorized_visits(spark, sf).select("id", "person_id", "zone_id", "status", "reason")


@query("face_states", TOPO + VISITS + """, fr AS (SELECT *, CASE WHEN state = 'UNKNOWN_PERSON' THEN 'UNKNOWN' ELSE 'RECOGNIZED' END AS rec FROM za) SELECT id, CASE WHEN rec = 'UNKNOWN' THEN 'UNKNOWN_PERSON' WHEN rec = 'RECOGNIZED' AND status = 'UNAUTHORIZED' THEN 'UNAUTHORIZED' ELSE rec END AS face_state FROM fr""")
def face_states(spark, sf):
    rec = F.when(F.col("state") == "UNKNOWN_PERSON", "UNKNOWN").otherwise("RECOGNIZED")
    return authorized_visits(spark, sf).select("id", assess.face_state(rec, F.col("status")).alias("face_state"))


PLACE = """, ev AS (SELECT id AS event_id, 'host-' || user_id AS target_name, CASE WHEN k < 10 THEN 'N99' END AS declared_zone FROM nodes WHERE kind = 'ssh'),
 mp AS (SELECT 'host-' || c_custkey AS target_name, 'S' || c_custkey AS server_id, 'K-' || c_nationkey || '-' || c_mktsegment AS rack_id, CASE WHEN c_acctbal < 0 THEN 'N77' ELSE 'N' || c_nationkey END AS zone_id FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@query("source_placement", TOPO + PLACE + """, j AS (SELECT event_id, mp.*, s.zone_id AS tz, declared_zone, CASE WHEN mp.server_id IS NULL THEN 'TARGET_NOT_MAPPED' WHEN s.zone_id IS NULL THEN 'SERVER_NOT_IN_TOPOLOGY' WHEN s.zone_id <> mp.zone_id OR s.rack_id <> mp.rack_id THEN 'MAPPING_CONTRADICTS_TOPOLOGY' WHEN declared_zone <> mp.zone_id THEN 'DECLARED_ZONE_MISMATCH' END AS rr
 FROM ev LEFT JOIN mp ON mp.target_name = ev.target_name LEFT JOIN servers s ON s.server_id = mp.server_id)
 SELECT event_id, CASE WHEN rr IS NULL THEN server_id END AS server_id, CASE WHEN rr IS NULL THEN rack_id END AS rack_id, CASE WHEN rr IS NULL THEN zone_id END AS zone_id, rr AS reject_reason FROM j""")
def source_placement(spark, sf):
    ev = B.nodes(spark, sf).where("kind = 'ssh'").select(F.col("id").alias("event_id"), F.concat(F.lit("host-"), "user_id").alias("target_name"), F.when(F.col("k") < 10, "N99").alias("declared_zone"))
    c = load(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    mp = c.select(F.concat(F.lit("host-"), "c_custkey").alias("target_name"), F.concat(F.lit("S"), "c_custkey").alias("server_id"), F.concat_ws("-", F.lit("K"), "c_nationkey", "c_mktsegment").alias("rack_id"),
                  F.when(F.col("c_acctbal") < 0, "N77").otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("zone_id"))
    return G.place(ev, mp, servers(spark, sf))


@query("capture_metadata_errors", TOPO + """, cm AS (SELECT id, 'CAMERA' || user_id AS camera_id, 'N' || (k % 25) AS zone_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k < 5 THEN '' WHEN k < 10 THEN ' x' ELSE 'Z' END AS captured_at, ts, k FROM nodes WHERE kind IN ('face','ppe'))
 SELECT id, concat_ws(',', CASE WHEN c.zone_id IS NULL THEN 'UNKNOWN_CAMERA' WHEN c.zone_id <> cm.zone_id THEN 'CAMERA_NOT_IN_ZONE' END, CASE WHEN k BETWEEN 5 AND 9 THEN 'INVALID_TIME' WHEN k < 5 THEN 'TIME_WITHOUT_OFFSET' WHEN ts > TIMESTAMP '2024-01-25 00:00:00' THEN 'TIME_IN_FUTURE' END) AS errors FROM cm LEFT JOIN cameras c ON c.camera_id = cm.camera_id""")
def capture_metadata_errors(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("k") < 5, "").when(F.col("k") < 10, " x").otherwise("Z"))
    cm = B.nodes(spark, sf).where("kind IN ('face', 'ppe')").select("id", F.concat(F.lit("CAMERA"), "user_id").alias("camera_id"), F.concat(F.lit("N"), F.col("k") % 25).alias("zone_id"), text.alias("captured_at"), F.date_trunc("second", "ts").alias("t"), "ts")
    j = cm.join(devices(spark, sf, "CAMERA").withColumnRenamed("zone_id", "camera_zone"), "camera_id", "left")
    return j.select("id", F.array_join(V.capture_metadata_errors(F.lit("2024-01-24 23:59:59").cast("timestamp")), ",").alias("errors"))


DEP_RULES = """, rules AS (SELECT 'N' || n_nationkey AS provider_zone, 'N' || ((n_nationkey + 1) % 25) AS dependent_zone FROM nation WHERE n_regionkey = 0)"""


@query("infrastructure_dependencies", TOPO + DEP_RULES + f" SELECT id, dependent_zone FROM (SELECT *, 'N' || (user_id % 25) AS z, {DOMAIN_SQL} AS domain FROM nodes) n JOIN rules ON provider_zone = z WHERE domain IN ('ENVIRONMENTAL','MAINTENANCE')")
def infrastructure_dependencies(spark, sf):
    n = load(spark, sf, "nation").where("n_regionkey = 0")
    rules = n.select(F.concat(F.lit("N"), "n_nationkey").alias("provider_zone"), F.array(F.lit("ENVIRONMENTAL"), F.lit("MAINTENANCE")).alias("provider_domains"),
                     F.array(F.concat(F.lit("N"), (F.col("n_nationkey") + 1) % 25)).alias("dependent_zones"))
    ev = B.nodes(spark, sf).select("id", F.concat(F.lit("N"), F.col("user_id") % 25).alias("zone_id"), assess.domain_of(F.col("kind")).alias("domain"))
    return bayes.dependency_pairs(ev, rules).select("id", "dependent_zone")


@query("granted_events", TOPO + f" SELECT id FROM (SELECT *, 'N' || (user_id % 25) AS z, {DOMAIN_SQL} AS domain FROM nodes) n WHERE z IN (SELECT zone_id FROM zones WHERE data_center_id IN ('AFRICA','EUROPE')) AND domain IN ('CYBERSECURITY','SAFETY')")
def granted_events(spark, sf):
    """Row filter of one principal: granted zones and permitted domains, as semi joins with grant tables."""
    ev = B.nodes(spark, sf).select("id", F.concat(F.lit("N"), F.col("user_id") % 25).alias("zone_id"), assess.domain_of(F.col("kind")).alias("domain"))
    granted = zones(spark, sf).where("data_center_id IN ('AFRICA', 'EUROPE')").select("zone_id")
    permitted = ev.sparkSession.createDataFrame([("CYBERSECURITY",), ("SAFETY",)], "domain string")
    return ev.join(granted, "zone_id", "left_semi").join(permitted, "domain", "left_semi").select("id")


# ---- envelopes ---------------------------------------------------------------------

def envelopes(spark, sf):
    """Assessments of all five domains as one envelope table."""
    n = B.nodes(spark, sf)
    ev = lambda **cols: F.struct(*[c.alias(k) for k, c in cols.items()])
    zone = F.col("zone_id")
    common = dict(event_id=F.col("id"), ts=F.col("ts"), zone=zone)
    ssh = n.where("kind = 'ssh'")
    a = E.adapt(ssh, "CYBERSECURITY", **common, state=F.col("state"), anomaly=F.col("state") != "NO_ANOMALY_EVIDENCE", confidence=F.when(F.col("value") >= 60, "HIGH").otherwise("LOW"), evidence=ev(detector_votes=(F.col("k") % 4)),
                window=(F.date_trunc("hour", "ts"), F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")), entities={"server_id": F.col("server_id"), "source_ip": F.concat(F.lit("10.0.0."), F.col("user_id") % 256)})
    m = E.adapt(n.where("kind = 'maintenance'"), "MAINTENANCE", **common, state=F.col("state"), anomaly=F.col("state") == "AT_RISK", score=F.col("failure_probability"), evidence=ev(failure_probability=F.col("failure_probability")), entities={"asset_id": F.concat(F.lit("D"), "user_id")})
    v = E.adapt(n.where("kind = 'environment'"), "ENVIRONMENTAL", **common, state=F.col("state"), anomaly=F.col("state") != "NORMAL", evidence=ev(source_class=F.col("source_class")), entities={"sensor_id": F.concat(F.lit("SENSOR"), "user_id")})
    face_state = assess.lookup(E.FACE_STATES, F.when(F.col("state") == "UNKNOWN_PERSON", "UNKNOWN").otherwise("RECOGNIZED"))
    f = E.adapt(n.where("kind = 'face'"), "PHYSICAL_SECURITY", **common, state=face_state, anomaly=F.col("state") == "UNKNOWN_PERSON", evidence=ev(status=F.col("state")), entities={"camera_id": F.concat(F.lit("CAMERA"), "user_id"), "person_id": F.concat(F.lit("P"), "user_id")})
    ppe_state = assess.lookup(E.PPE_STATES, F.when(F.col("state") == "PPE_NON_COMPLIANT", "NON_COMPLIANT").otherwise(F.col("state")))
    p = E.adapt(n.where("kind = 'ppe'"), "SAFETY", **common, state=ppe_state, anomaly=F.col("state") == "PPE_NON_COMPLIANT", confidence=F.col("confidence"), evidence=ev(status=F.col("state")), entities={"camera_id": F.concat(F.lit("CAMERA"), "user_id")})
    out = a
    for x in (m, v, f, p):
        out = out.unionByName(x)
    return out


@query("event_envelopes", NODES + f""" SELECT id AS event_id, '1.0' AS schema_version, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN kind='ssh' THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') END AS window_start, {DOMAIN_SQL} AS domain,
 CASE kind WHEN 'face' THEN CASE WHEN state='UNKNOWN_PERSON' THEN 'UNKNOWN_PERSON' ELSE 'RECOGNIZED_PERSON' END WHEN 'ppe' THEN CASE WHEN state='PPE_NON_COMPLIANT' THEN state ELSE 'PPE_COMPLIANT' END ELSE state END AS state,
 CASE WHEN kind='ssh' THEN CASE WHEN value >= 60 THEN 'HIGH' ELSE 'LOW' END END AS confidence_label, CASE WHEN kind='ppe' THEN confidence END AS confidence_num, CASE WHEN kind='maintenance' THEN failure_probability END AS score,
 CASE kind WHEN 'ssh' THEN state <> 'NO_ANOMALY_EVIDENCE' WHEN 'maintenance' THEN state = 'AT_RISK' WHEN 'environment' THEN state <> 'NORMAL' WHEN 'face' THEN state = 'UNKNOWN_PERSON' ELSE state = 'PPE_NON_COMPLIANT' END AS anomaly_detected,
 CASE WHEN kind='ssh' THEN server_id END AS server_id, CASE WHEN kind='face' THEN 'P' || user_id END AS person_id, zone_id FROM nodes""")
def event_envelopes(spark, sf):
    return E.flatten(envelopes(spark, sf)).select("event_id", "schema_version", "timestamp", "window_start", "domain", "state", "confidence_label", "confidence_num", "score", "anomaly_detected", "server_id", "person_id", "zone_id")


@query("maintenance_state_conflicts", NODES + " SELECT id, (state = 'AT_RISK') <> (failure_probability >= 0.45) AS conflict FROM nodes WHERE kind = 'maintenance'")
def maintenance_state_conflicts(spark, sf):
    return B.nodes(spark, sf).where("kind = 'maintenance'").select("id", E.maintenance_conflict(F.col("state"), F.col("failure_probability")).alias("conflict"))


JSON_SPARK = """concat('{"event_id":"', CASE WHEN k = 99 THEN '' ELSE id END, '","schema_version":"', CASE WHEN k BETWEEN 20 AND 24 THEN '2.0' ELSE '1.0' END, '","timestamp":"', CASE WHEN k = 98 THEN 'soon' ELSE '2024-01-01T00:00:00Z' END, '",',
 CASE WHEN k < 5 THEN '' ELSE concat('"domain":"', CASE WHEN k < 10 THEN 'WEATHER' ELSE 'SAFETY' END, '",') END, CASE WHEN k BETWEEN 10 AND 14 THEN '"extra":1,' ELSE '' END, CASE WHEN k BETWEEN 15 AND 19 THEN '"window":null,' WHEN k = 97 THEN '"window":{"start":"2024-01-01T00:00:00Z"},' ELSE '' END,
 '"event_type":"X","source":{"component":"c","component_version":"1"},"entities":{', CASE WHEN k = 96 THEN '"pet":"cat"' ELSE '' END, '},"location":{},"assessment":{"state":"', state, '"', CASE WHEN k BETWEEN 30 AND 34 THEN '' WHEN k < 60 THEN ',"confidence":0.5' ELSE ',"confidence":"HIGH"' END, '},"evidence":{},',
 '"provenance":{"source_type":"', CASE WHEN k = 95 THEN 'RUMOUR' ELSE 'LIVE' END, '","synthetic_mapping":false,"mapping_type":', CASE WHEN k = 94 THEN '"GUESS"' ELSE 'null' END, ',"original_timestamp":null,"scenario_id":null}}')"""


@query("envelope_validation", NODES + f""", j AS (SELECT id, {JSON_SPARK} AS t FROM nodes), kx AS (SELECT id, t, json_keys(t) AS ks, json_keys(t->'$.window') AS kw, json_keys(t->'$.entities') AS ke, json_keys(t->'$.assessment') AS ka FROM j)
 SELECT id, concat_ws('; ', CASE WHEN NOT list_contains(ks, 'domain') THEN 'domain: required' END, CASE WHEN list_contains(ks, 'extra') THEN '$: unexpected key' END, CASE WHEN t->>'$.event_id' = '' THEN 'event_id: empty' END, CASE WHEN t->>'$.schema_version' <> '1.0' THEN 'schema_version: not 1.0' END,
  CASE WHEN t->>'$.domain' NOT IN ('CYBERSECURITY','PHYSICAL_SECURITY','SAFETY','MAINTENANCE','ENVIRONMENTAL') THEN 'domain: not in enum' END, CASE WHEN TRY_CAST(t->>'$.timestamp' AS TIMESTAMPTZ) IS NULL THEN 'timestamp: not a date-time' END,
  CASE WHEN len(kw) > 0 AND NOT list_contains(kw, 'end') THEN 'window.end: required' END, CASE WHEN list_contains(ke, 'pet') THEN 'entities: unexpected key' END, CASE WHEN NOT list_contains(ka, 'confidence') THEN 'assessment.confidence: required' END,
  CASE WHEN t->>'$.provenance.source_type' NOT IN ('REAL_DATASET','PUBLIC_DATASET','SYNTHETIC','CONTROLLED_TEST','LIVE') THEN 'provenance.source_type: not in enum' END, CASE WHEN t->>'$.provenance.mapping_type' NOT IN ('NONE','SYNTHETIC_TOPOLOGY','SYNTHETIC_SCENARIO') THEN 'provenance.mapping_type: not in enum' END) AS errors FROM kx""")
def envelope_validation(spark, sf):
    from watchfold.functions.columns import evaluate_once
    j = evaluate_once(B.nodes(spark, sf).select("id", "k", "state"), {"t": F.expr(JSON_SPARK)})
    return j.select("id", F.array_join(E.envelope_errors(F.col("t")), "; ").alias("errors"))


EVIDENCE_JSON = """concat('{"failure_probability":', cast(k / 100.0 as double), ',"token":"secret","smart":{"smart_5_raw":', k, ',"owner":"someone"},"people":[', CASE WHEN k < 50 THEN '{"person_index":0,"image":"x"}' ELSE '{"person_index":0,"image":"x"},{"person_index":1,"landmarks":[1]}' END, ']}')"""


@query("denied_keys_removed", NODES + f""", j AS (SELECT id, k FROM nodes) SELECT id, '{{"failure_probability":' || (k / 100.0::DOUBLE) || ',"smart":{{"smart_5_raw":' || k || '}},"people":[{{"person_index":0}}' || CASE WHEN k < 50 THEN '' ELSE ',{{"person_index":1}}' END || ']}}' AS evidence FROM j""".replace("{{", "{").replace("}}", "}"))
def denied_keys_removed(spark, sf):
    t = B.nodes(spark, sf).select("id", F.expr(EVIDENCE_JSON).alias("t"))
    return t.select("id", E.minimize(F.col("t")).alias("evidence"))


@query("allowed_evidence", NODES + """ SELECT id, '{"smart":{"smart_5_raw":' || k || '},"people":[{"person_index":0}' || CASE WHEN k < 50 THEN '' ELSE ',{"person_index":1}' END || ']}' AS evidence FROM nodes""")
def allowed_evidence(spark, sf):
    allowed = spark.createDataFrame([], "smart STRUCT<smart_5_raw: INT>, people ARRAY<STRUCT<person_index: INT>>").schema
    t = B.nodes(spark, sf).select("id", F.expr(EVIDENCE_JSON).alias("t"))
    return t.select("id", E.project_evidence(F.col("t"), allowed).alias("evidence"))


@query("normalised_times", NODES + """, t AS (SELECT id, CASE WHEN k < 20 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN k < 30 THEN 'yesterday' WHEN k < 60 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') END AS raw, k, date_trunc('second', ts) AS s FROM nodes)
 SELECT id, CASE WHEN k >= 60 THEN strftime(s - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN k >= 30 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') END AS strict, CASE WHEN k >= 60 THEN strftime(s - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN k >= 30 OR k < 20 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') END AS assumed_utc FROM t""")
def normalised_times(spark, sf):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("k") < 20, base).when(F.col("k") < 30, "yesterday").when(F.col("k") < 60, F.concat(base, F.lit("Z"))).otherwise(F.concat(base, F.lit("+02:00")))
    t = B.nodes(spark, sf).select("id", raw.alias("raw"))
    return t.select("id", E.iso(E.normalize_time(F.col("raw"))).alias("strict"), E.iso(E.normalize_time(F.col("raw"), "utc")).alias("assumed_utc"))


@query("correlation_record_errors", NODES + f""", ev AS (SELECT strftime(ts, '%Y%m%d') AS scenario_id, *, {DOMAIN_SQL} AS domain FROM el), pr AS (SELECT a.id AS l, b.id AS r, a.domain AS ld, b.domain AS rd, CASE WHEN a.server_id = b.server_id THEN 'SERVER' WHEN a.rack_id = b.rack_id THEN 'RACK' ELSE 'ZONE' END AS scope
 FROM ev a JOIN ev b ON a.scenario_id = b.scenario_id AND a.zone_id = b.zone_id AND a.id < b.id AND a.domain <> b.domain AND abs(a.us - b.us) <= 900000000)
 SELECT l AS left_id, r AS right_id, concat_ws(',', CASE WHEN ld = 'SAFETY' THEN 'FEWER_THAN_TWO_EVENTS' END, CASE WHEN ld = 'SAFETY' THEN 'DUPLICATE_EVENTS' END, CASE WHEN rd = 'SAFETY' THEN 'FEWER_THAN_TWO_DOMAINS' END, CASE WHEN scope = 'RACK' THEN 'INVALID_SCOPE' END) AS errors FROM pr""")
def correlation_record_errors(spark, sf):
    """Pairs with faults put in by domain and scope, checked against the record contract."""
    p = P.cross_domain_pairs(scenario_events(spark, sf))
    ids_ = F.when(F.col("left_domain") == "SAFETY", F.array("left_id", "left_id")).otherwise(F.array("left_id", "right_id"))
    domains = F.when(F.col("right_domain") == "SAFETY", F.array("right_domain", "right_domain")).otherwise(F.array("left_domain", "right_domain"))
    scope = F.when(F.col("scope") == "RACK", "SHELF").otherwise(F.col("scope"))
    return p.select("left_id", "right_id", F.array_join(V.correlation_record_errors(ids_, domains, scope), ",").alias("errors"))


@query("sensor_batch_contract", "WITH " + READINGS_SQL + """, b AS (SELECT source_id || '-' || strftime(ts, '%Y%m%d') AS batch_id, date_trunc('hour', ts) AS t, temperature_c, humidity_pct FROM readings),
 g AS (SELECT batch_id, count(*) AS rows, count(DISTINCT t) AS times, count(*) FILTER (temperature_c IS NULL AND humidity_pct IS NULL) AS empty_rows FROM b GROUP BY 1)
 SELECT batch_id, rows, times, empty_rows, concat_ws(',', CASE WHEN rows > 500 THEN 'ROW_COUNT' END, CASE WHEN rows <> times THEN 'DUPLICATE_TIMESTAMPS' END, CASE WHEN empty_rows > 0 THEN 'ROW_WITHOUT_MEASUREMENT' END) AS errors FROM g""")
def sensor_batch_contract(spark, sf):
    r = readings(spark, sf).select(F.concat_ws("-", "source_id", F.date_format("timestamp", "yyyyMMdd")).alias("batch_id"), F.date_trunc("hour", "timestamp").alias("timestamp"), "temperature_c", "humidity_pct")
    return V.sensor_batch_contract(r, "batch_id").select("batch_id", "rows", "times", "empty_rows", "errors")


@query("drive_health", "WITH " + B.SCORED_SQL + """, g AS (SELECT serial_number, max({'d': date, 'p': probability}) AS o, count(*) AS observations FROM scored GROUP BY 1)
 SELECT serial_number, strftime(o.d, '%Y-%m-%d') AS observation_date, o.p AS failure_probability, observations, CASE WHEN o.p >= 0.45 THEN 'AT_RISK' ELSE 'NORMAL' END AS assessment FROM g""")
def drive_health(spark, sf):
    h = assess.drive_health(B.scored(spark, sf))
    return h.withColumn("observation_date", F.date_format("observation_date", "yyyy-MM-dd"))


# ---- named event queries -------------------------------------------------------------

CY = TOPO + REFS + """, cy AS (SELECT r.event_id, r.state, r.ts, r.source_ip, s.server_id, s.rack_id, s.zone_id, s.criticality, z.data_center_id FROM refs r JOIN servers s ON s.server_id = r.server_id JOIN zones z ON z.zone_id = s.zone_id WHERE r.kind = 'ssh')"""


def cyber_context(spark, sf):
    return refs(spark, sf).where("kind = 'ssh'").join(servers(spark, sf), "server_id").join(zones(spark, sf), "zone_id")


@query("ssh_events_listed", TOPO + REFS + " SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, state, source_ip FROM refs WHERE kind = 'ssh'")
def ssh_events_listed(spark, sf):
    return refs(spark, sf).where("kind = 'ssh'").select("event_id", E.iso(F.col("ts")).alias("timestamp"), "state", "source_ip")


@query("ssh_event_servers", CY + " SELECT event_id, state, server_id, criticality FROM cy")
def ssh_event_servers(spark, sf):
    return cyber_context(spark, sf).select("event_id", "state", "server_id", "criticality")


@query("ssh_full_context", CY + " SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, state, source_ip, server_id, rack_id, zone_id, data_center_id FROM cy")
def ssh_full_context(spark, sf):
    return cyber_context(spark, sf).select("event_id", E.iso(F.col("ts")).alias("timestamp"), "state", "source_ip", "server_id", "rack_id", "zone_id", "data_center_id")


@query("ssh_high_confidence_assets", CY + " SELECT event_id, server_id, criticality, rack_id, zone_id FROM cy WHERE state = 'HIGH_CONFIDENCE_ANOMALY'")
def ssh_high_confidence_assets(spark, sf):
    return cyber_context(spark, sf).where("state = 'HIGH_CONFIDENCE_ANOMALY'").select("event_id", "server_id", "criticality", "rack_id", "zone_id")


@query("event_provenance", NODES + " SELECT id AS event_id, 'PUBLIC_DATASET' AS source_type, 'NONE' AS mapping_type, id AS original_event_id FROM nodes")
def event_provenance(spark, sf):
    return E.flatten(envelopes(spark, sf)).select("event_id", "source_type", "mapping_type", "original_event_id")


@query("ssh_events_by_zone", CY + " SELECT zone_id, count(*) AS events, count(DISTINCT server_id) AS servers FROM cy GROUP BY 1")
def ssh_events_by_zone(spark, sf):
    return cyber_context(spark, sf).groupBy("zone_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("server_id").alias("servers"))


@query("graph_integrity", TOPO + REFS + """, ex AS (SELECT event_id FROM refs WHERE kind IN ('face','ppe')), ob AS (SELECT event_id FROM refs r JOIN cameras c ON c.camera_id = r.camera_id UNION SELECT event_id FROM refs WHERE kind = 'ssh' AND state = 'EXPLICIT_SECURITY_EVENT')
 SELECT event_id, 'MISSING' AS problem FROM ex WHERE event_id NOT IN (SELECT event_id FROM ob) UNION ALL SELECT event_id, 'UNEXPECTED' FROM ob WHERE event_id NOT IN (SELECT event_id FROM ex)""")
def graph_integrity(spark, sf):
    r = refs(spark, sf)
    expected = r.where("kind IN ('face', 'ppe')").select("event_id")
    linked = r.join(devices(spark, sf, "CAMERA"), "camera_id", "left_semi").select("event_id")
    return V.missing_and_unexpected(expected, linked.unionByName(r.where("kind = 'ssh' AND state = 'EXPLICIT_SECURITY_EVENT'").select("event_id")), ["event_id"])


# A graph with planted faults: every 23rd event missing, every 5th cyber event without its source, zones named twice, servers without
# a rack or with a second one, a zone without its site, a camera expected and not there.
FAULTY_SQL = """WITH ev AS (SELECT event_id, event_id // 10 AS scenario_id, CASE event_type WHEN 'error' THEN 'CYBERSECURITY' ELSE 'SAFETY' END AS domain FROM events),
 seen AS (SELECT * FROM ev WHERE event_id % 23 <> 0), members AS (SELECT DISTINCT 'C' || (event_id // 3) AS correlation_id, event_id FROM events),
 corr AS (SELECT DISTINCT 'C' || (event_id // 3) AS correlation_id, 'Zone' AS scope, 'N' || ((event_id // 3) % 27) AS entity FROM events UNION ALL SELECT 'X' || n_nationkey, 'Zone', 'N' || n_nationkey FROM nation),
 nodes AS (SELECT 'Zone' AS kind, 'N' || n_nationkey AS id FROM nation UNION ALL SELECT 'Zone', 'N' || n_nationkey FROM nation WHERE n_nationkey % 10 = 3
  UNION ALL SELECT 'DataCenter', r_name FROM region UNION ALL SELECT 'Server', 'S' || c_custkey FROM customer),
 racked AS (SELECT 'S' || c_custkey AS src, 'K-' || c_nationkey || '-' || c_mktsegment AS dst FROM customer WHERE c_custkey % 50 <> 0 UNION SELECT 'S' || c_custkey, 'K-EXTRA' FROM customer WHERE c_custkey % 70 = 1),
 zoned AS (SELECT DISTINCT 'K-' || c_nationkey || '-' || c_mktsegment AS src, 'N' || c_nationkey AS dst FROM customer UNION SELECT 'K-EXTRA', 'N0'),
 sited AS (SELECT 'N' || n_nationkey AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7),
 unlinked AS (SELECT * FROM seen WHERE domain = 'CYBERSECURITY' AND event_id % 5 = 0)"""
VIOLATIONS_SQL = FAULTY_SQL + """, division AS (SELECT correlation_id, count(*) AS listed, count(*) FILTER (event_id % 23 <> 0) AS found FROM members GROUP BY 1),
 zones AS (SELECT id, count(*) AS found FROM nodes WHERE kind = 'Zone' GROUP BY 1),
 reached AS (SELECT s.id, count(DISTINCT t.dst) AS found FROM nodes s LEFT JOIN racked r ON r.src = s.id LEFT JOIN zoned z ON z.src = r.dst LEFT JOIN sited t ON t.src = z.dst WHERE s.kind = 'Server' GROUP BY 1)
 SELECT 'MISSING_EVENT' AS rule, correlation_id AS subject, CAST(event_id AS VARCHAR) AS related, found, listed AS expected FROM members JOIN division USING (correlation_id) WHERE event_id % 23 = 0
 UNION ALL SELECT 'NO_EVENTS', 'X' || n_nationkey, NULL, 0, 1 FROM nation
 UNION ALL SELECT 'SHARED_ENTITY_NOT_UNIQUE', correlation_id, 'Zone:' || entity, coalesce(found, 0), 1 FROM corr LEFT JOIN zones ON zones.id = entity WHERE coalesce(found, 0) <> 1
 UNION ALL SELECT 'MISSING_SOURCE_LINK', CAST(event_id AS VARCHAR), 'ORIGINATED_FROM:SourceIP', 0, 1 FROM unlinked
 UNION ALL SELECT 'MISSING_RELATIONSHIP', 'S' || c_custkey, 'LOCATED_IN:Rack:K-' || c_nationkey || '-' || c_mktsegment, 0, 1 FROM customer WHERE c_custkey % 50 = 0
 UNION ALL SELECT 'FORBIDDEN_RELATIONSHIP', 'S' || c_custkey, 'LOCATED_IN:Rack:K-EXTRA', 1, 0 FROM customer WHERE c_custkey % 70 = 1
 UNION ALL SELECT 'BROKEN_PLACEMENT', id, 'DataCenter', found, 1 FROM reached WHERE found <> 1
 UNION ALL SELECT 'NODE_COUNT', 'Zone', NULL, 28, 25 UNION ALL SELECT 'NODE_COUNT', 'Camera', NULL, 0, 1"""


def faulty_graph(spark, sf):
    """(correlations, members, all events, observed events, nodes, edges, declared, expected counts) of the faulty graph."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c) if " " in c else F.col(c))
    ev = load(spark, sf, "events").select("event_id", F.expr("event_id div 10").alias("scenario_id"), F.when(F.col("event_type") == "error", "CYBERSECURITY").otherwise("SAFETY").alias("domain"))
    seen = ev.where("event_id % 23 <> 0")
    members = ev.select(named("C", "event_id div 3").alias("correlation_id"), "event_id")
    nation, customer = load(spark, sf, "nation"), load(spark, sf, "customer")
    shared = ev.select(named("C", "event_id div 3").alias("correlation_id"), F.lit("Zone").alias("scope"), named("N", "event_id div 3 % 27").alias("shared_entity_id")).distinct()
    correlations = shared.unionByName(nation.select(named("X", "n_nationkey").alias("correlation_id"), F.lit("Zone").alias("scope"), named("N", "n_nationkey").alias("shared_entity_id")))
    node = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), c.alias("id"))
    zone, server, rack = named("N", "n_nationkey"), named("S", "c_custkey"), F.concat_ws("-", F.lit("K"), "c_nationkey", "c_mktsegment")
    nodes = (node(nation, "Zone", zone).unionByName(node(nation.where("n_nationkey % 10 = 3"), "Zone", zone))
             .unionByName(node(load(spark, sf, "region"), "DataCenter", F.col("r_name"))).unionByName(node(customer, "Server", server)))
    edge = lambda df, st, src, rel, dt, dst: df.select(F.lit(st).alias("src_type"), src.alias("src"), F.lit(rel).alias("rel"), F.lit(dt).alias("dst_type"), dst.alias("dst"))
    moved, extra = customer.where("c_custkey % 70 = 1"), F.lit("K-EXTRA")
    site = nation.where("n_nationkey <> 7").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    racks = edge(customer, "Server", server, "LOCATED_IN", "Rack", rack)
    second = edge(moved, "Server", server, "LOCATED_IN", "Rack", extra)
    parts = [edge(seen.where("domain = 'CYBERSECURITY' AND event_id % 5 <> 0"), "Event", S("event_id"), "ORIGINATED_FROM", "SourceIP", F.lit("10.0.0.1")),
             edge(customer.where("c_custkey % 50 <> 0"), "Server", server, "LOCATED_IN", "Rack", rack), second,
             edge(customer, "Rack", rack, "LOCATED_IN", "Zone", named("N", "c_nationkey")), edge(nation.limit(1), "Rack", extra, "LOCATED_IN", "Zone", F.lit("N0")),
             edge(site, "Zone", zone, "PART_OF", "DataCenter", F.col("r_name"))]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    declared = racks.withColumn("expected", F.lit(True)).unionByName(second.withColumn("expected", F.lit(False)))
    counts = spark.createDataFrame([("Zone", 25), ("DataCenter", 5), ("Camera", 1)], "kind string, expected long")
    return correlations, members, ev, seen, nodes, edges, declared, counts


@query("graph_violations", VIOLATIONS_SQL)
def graph_violations(spark, sf):
    correlations, members, _, seen, nodes, edges, declared, counts = faulty_graph(spark, sf)
    return integrity.graph_violations(correlations, members, seen, nodes, edges, declared, counts)


@query("scenario_integrity", FAULTY_SQL + """, g AS (SELECT scenario_id, count(*) AS expected_events, count(*) FILTER (event_id % 23 = 0) AS missing_events, count(*) FILTER (event_id % 23 <> 0) AS observed_events,
  count(*) FILTER (event_id % 23 <> 0 AND domain = 'CYBERSECURITY' AND event_id % 5 = 0) AS unlinked_events FROM ev GROUP BY 1)
 SELECT *, CASE WHEN missing_events = 0 AND unlinked_events = 0 THEN 'PASS' ELSE 'INCOMPLETE' END AS status FROM g""")
def scenario_integrity(spark, sf):
    _, _, ev, seen, _, edges, _, _ = faulty_graph(spark, sf)
    return integrity.scenario_status(ev, seen, edges)
