"""Site topology: nested JSON to dimension and edge tables, lookups and named queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TREE = """data_center STRUCT<data_center_id: STRING, zones: ARRAY<STRUCT<zone_id: STRING, criticality: STRING,
 cameras: ARRAY<STRUCT<camera_id: STRING, monitors: ARRAY<STRING>>>, sensors: ARRAY<STRUCT<sensor_id: STRING, monitors: ARRAY<STRING>>>,
 equipment: ARRAY<STRUCT<equipment_id: STRING>>, racks: ARRAY<STRUCT<rack_id: STRING, servers: ARRAY<STRUCT<server_id: STRING, criticality: STRING>>>>>>>,
 people ARRAY<STRUCT<person_id: STRING, role: STRING, authorized_zones: ARRAY<STRING>>>"""


def read_tree(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Site documents: one for each file or, with `lines`, one for each line, which lets Spark split the files.

    Several documents may describe parts of one site; a data center or zone is named again in each of them.
    """
    return spark.read.schema(TREE).option("multiLine", not lines).json(path)


def flatten_tree(tree: DataFrame) -> dict[str, DataFrame]:
    """Dimension tables and one edge table of a nested topology."""
    z = tree.select(F.col("data_center.data_center_id").alias("data_center_id"), F.explode_outer("data_center.zones").alias("z"))
    zones = z.select("data_center_id", F.col("z.zone_id").alias("zone_id"), F.col("z.criticality").alias("criticality"))
    of = lambda name, key: z.select(F.col("z.zone_id").alias("zone_id"), F.explode(f"z.{name}").alias("x")).select("zone_id", F.col(f"x.{key}").alias(key), "x")
    racks = of("racks", "rack_id")
    servers = racks.select("zone_id", "rack_id", F.explode("x.servers").alias("s")).select("zone_id", "rack_id", F.col("s.server_id").alias("server_id"), F.col("s.criticality").alias("criticality"))
    cameras, sensors, equipment = of("cameras", "camera_id"), of("sensors", "sensor_id"), of("equipment", "equipment_id").drop("x")
    people = tree.select(F.explode("people").alias("p")).select("p.person_id", "p.role", "p.authorized_zones")
    edge = lambda df, st, s, rel, dt, d: df.select(F.lit(st).alias("src_type"), F.col(s).alias("src"), F.lit(rel).alias("rel"), F.lit(dt).alias("dst_type"), F.col(d).alias("dst"))
    watch = lambda df, key: df.select(key, F.explode("x.monitors").alias("target"))
    edges = reduce(DataFrame.unionByName, [
        edge(zones.where("zone_id IS NOT NULL"), "Zone", "zone_id", "PART_OF", "DataCenter", "data_center_id"), edge(racks, "Rack", "rack_id", "LOCATED_IN", "Zone", "zone_id"),
        edge(servers, "Server", "server_id", "LOCATED_IN", "Rack", "rack_id"), edge(equipment, "Equipment", "equipment_id", "LOCATED_IN", "Zone", "zone_id"),
        edge(watch(cameras, "camera_id"), "Camera", "camera_id", "MONITORS", "Target", "target"), edge(watch(sensors, "sensor_id"), "Sensor", "sensor_id", "MONITORS", "Target", "target"),
        edge(people.select("person_id", F.explode("authorized_zones").alias("zone_id")), "Person", "person_id", "AUTHORIZED_FOR", "Zone", "zone_id")])
    return {"zones": zones, "racks": racks.drop("x"), "servers": servers, "cameras": cameras.drop("x"), "sensors": sensors.drop("x"), "equipment": equipment, "people": people, "edges": edges}


def resolve_contexts(events: DataFrame, servers: DataFrame, hosted: DataFrame, monitors: DataFrame, equipment: DataFrame, cameras: DataFrame) -> DataFrame:
    """Server, rack and zone of each event through five alternative references, first that resolves wins.

    The dimension sides grow with the site and are merge joined: judged by its compressed file, a large table would still be
    broadcast, five times. An event without a reference gets a key of its own, so that such events do not meet in one task."""
    s = servers.select("server_id", "rack_id", "zone_id")
    via = lambda p: s.select(*[F.col(c).alias(f"{p}_{c}") for c in s.columns])
    h = hosted.select(F.col("asset_id"), F.col("server_id").alias("a_server_id")).join(via("a").hint("merge"), "a_server_id")
    ref = lambda df, key, p: df.select(F.col(key), F.col("zone_id").alias(f"{p}_zone_id"))
    keys = ["server_id", "asset_id", "sensor_id", "equipment_id", "camera_id"]
    j = events.select("event_id", *[F.coalesce(F.col(k), F.concat(F.lit("\0"), F.col("event_id").cast("string"))).alias(k) for k in keys])
    j = j.join(via("d").hint("merge"), F.col("server_id") == F.col("d_server_id"), "left")
    for dim, key in ((h, "asset_id"), (ref(monitors, "sensor_id", "s"), "sensor_id"), (ref(equipment, "equipment_id", "e"), "equipment_id"), (ref(cameras, "camera_id", "c"), "camera_id")):
        j = j.join(dim.hint("merge"), key, "left")
    origin = (F.when(F.col("d_zone_id").isNotNull(), "DIRECT_SERVER").when(F.col("a_zone_id").isNotNull(), "HOSTED_ASSET").when(F.col("s_zone_id").isNotNull(), "SENSOR")
              .when(F.col("e_zone_id").isNotNull(), "EQUIPMENT").when(F.col("c_zone_id").isNotNull(), "CAMERA"))
    return j.select("event_id", F.coalesce("d_server_id", "a_server_id").alias("resolved_server"), F.coalesce("d_rack_id", "a_rack_id").alias("resolved_rack"),
                    F.coalesce("d_zone_id", "a_zone_id", "s_zone_id", "e_zone_id", "c_zone_id").alias("resolved_zone"), origin.alias("origin")) \
            .where("resolved_zone IS NOT NULL").distinct()


def zone_authorization(requests: DataFrame, people: DataFrame, zones: DataFrame, grants: DataFrame) -> DataFrame:
    """AUTHORIZED with an edge, UNAUTHORIZED when person and zone exist without one, UNKNOWN otherwise."""
    p = people.select("person_id").distinct().withColumn("__p", F.lit(True))
    z = zones.select("zone_id").distinct().withColumn("__z", F.lit(True))
    g = grants.select("person_id", "zone_id").distinct().withColumn("__g", F.lit(True))
    j = requests.join(p, "person_id", "left").join(z, "zone_id", "left").join(g, ["person_id", "zone_id"], "left")
    return j.withColumn("status", F.when(F.col("__g"), "AUTHORIZED").when(F.col("__p") & F.col("__z"), "UNAUTHORIZED").otherwise("UNKNOWN")) \
            .withColumn("reason", F.when(F.col("person_id").isNull(), "IDENTITY_NOT_RECOGNIZED").when(F.col("__p").isNull(), "PERSON_NOT_IN_TOPOLOGY")
                        .when(F.col("__z").isNull(), "ZONE_NOT_IN_TOPOLOGY").otherwise("GRAPH_RELATIONSHIP_CHECK")).drop("__p", "__z", "__g")


def place(events: DataFrame, mapping: DataFrame, servers: DataFrame) -> DataFrame:
    """Target name to location through the mapping, checked against topology and the declared zone."""
    truth = servers.select(F.col("server_id"), F.col("rack_id").alias("t_rack"), F.col("zone_id").alias("t_zone"))
    j = events.join(mapping, "target_name", "left").join(truth, "server_id", "left")
    reason = (F.when(F.col("server_id").isNull(), "TARGET_NOT_MAPPED").when(F.col("t_zone").isNull(), "SERVER_NOT_IN_TOPOLOGY")
              .when((F.col("t_zone") != F.col("zone_id")) | (F.col("t_rack") != F.col("rack_id")), "MAPPING_CONTRADICTS_TOPOLOGY")
              .when(F.col("declared_zone").isNotNull() & (F.col("declared_zone") != F.col("zone_id")), "DECLARED_ZONE_MISMATCH"))
    return j.select("event_id", F.when(reason.isNull(), F.col("server_id")).alias("server_id"), F.when(reason.isNull(), F.col("rack_id")).alias("rack_id"),
                    F.when(reason.isNull(), F.col("zone_id")).alias("zone_id"), reason.alias("reject_reason"))


def emit_edges(events: DataFrame, references: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Event edges from flat rows: references = column -> (relation, node type, id prefix check name)."""
    items = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(rel).alias("rel"), F.lit(kind).alias("dst_type"), F.col(c).alias("dst")))
                                      for c, (rel, kind, _) in references.items()]))
    return events.select(F.lit("Event").alias("src_type"), F.col("event_id").alias("src"), F.explode(items).alias("e")).select("src_type", "src", "e.*")


def split_referential(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose target exists, rejected edges). `known`: dst_type, dst."""
    return edges.join(known, ["dst_type", "dst"], "left_semi"), edges.join(known, ["dst_type", "dst"], "left_anti")


def validate_topology(dims: dict[str, tuple[DataFrame, str]], zones: DataFrame, grants: DataFrame, watched: DataFrame, targets: DataFrame) -> DataFrame:
    """Violations: duplicate IDs per kind, grants to unknown zones, monitors of unknown targets."""
    parts = [df.groupBy(F.col(key).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"DUPLICATE_{name.upper()}").alias("rule"), "item")
             for name, (df, key) in dims.items()]
    parts.append(grants.join(zones.select("zone_id"), "zone_id", "left_anti").select(F.lit("UNKNOWN_ZONE").alias("rule"), F.col("person_id").cast("string").alias("item")))
    parts.append(watched.join(targets, "target", "left_anti").select(F.lit("UNKNOWN_TARGET").alias("rule"), F.col("watcher").cast("string").alias("item")))
    return reduce(DataFrame.unionByName, parts)
