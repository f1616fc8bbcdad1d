"""Cross-domain pair correlation: generic rule and the three dedicated matchers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchfold.functions.ids import pair_id
from watchfold.operators.assess import detector_abnormal
from watchfold.operators.bandjoin import band_join, side, time_cell
from watchfold.operators.matching import greedy_one_to_one

WINDOW_US = 900 * 1_000_000
HASH_BLOCKS = 10
# Length of a block of a zone's time line, in windows. Changes no result.
BLOCK_WINDOWS = 96
# Kind combinations with a dedicated matcher.
SPECIALIZED = [("environment", "maintenance"), ("face", "ppe"), ("face", "ssh")]


def eligible(nodes: DataFrame) -> DataFrame:
    """Nodes that may be linked: abnormal by detector, or escalated by a human."""
    human = F.col("human_abnormal") if "human_abnormal" in nodes.columns else F.lit(None).cast("boolean")
    return nodes.where(F.coalesce(human, F.lit(False)) | detector_abnormal(F.col("state")))


def compatible(a: Column, b: Column) -> Column:
    """Different kinds that the generic rule owns."""
    special = F.lit(False)
    for x, y in SPECIALIZED:
        special = special | ((F.least(a, b) == x) & (F.greatest(a, b) == y))
    return (a != b) & ~special


def instants(nodes: DataFrame) -> DataFrame:
    """One row per node and observation time, as microseconds; nodes without a time drop out."""
    return nodes.withColumn("us", F.explode(F.transform("times", lambda t: F.unix_micros(t)))).drop("times")


def cross_domain_pairs(events: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Abnormal events of one scenario and zone, different domains, close in time; deepest shared scope.

    Event ids are unique within a scenario, and the band join meets each pair once, so no pair comes twice.
    """
    keys = ["scenario_id", "zone_id"]
    cols = events.where("abnormal").select(*keys, "id", "domain", "server_id", "rack_id", "us")
    both = band_join(side(cols, "left", keys), side(cols, "right", keys), keys, "left_us", "right_us", window_us)
    kept = both.where((F.col("left_id") < F.col("right_id")) & (F.col("left_domain") != F.col("right_domain")))
    scope = (F.when(F.col("left_server_id") == F.col("right_server_id"), "SERVER")
             .when(F.col("left_rack_id") == F.col("right_rack_id"), "RACK").otherwise("ZONE"))
    entity = F.when(scope == "SERVER", F.col("left_server_id")).when(scope == "RACK", F.col("left_rack_id")).otherwise(F.col("zone_id"))
    return kept.select(*keys, "left_id", "right_id", "left_domain", "right_domain", scope.alias("scope"), entity.alias("shared_entity"),
                       (F.abs(F.col("left_us") - F.col("right_us")) / 1e6).alias("time_difference_seconds"))


def generic_pairs(nodes: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Pairs of the generic rule over nodes with several times: smallest time difference within the window."""
    keys = ["zone_id"]
    n = instants(eligible(nodes).select("zone_id", "kind", "id", "server_id", "times"))
    both = band_join(side(n, "left", keys), side(n, "right", keys), keys, "left_us", "right_us", window_us)
    ends = ["zone_id", "left_kind", "left_id", "right_kind", "right_id"]
    close = (both.where((F.col("left_kind") < F.col("right_kind")) & compatible(F.col("left_kind"), F.col("right_kind")))
             .groupBy(*ends, "left_server_id", "right_server_id")
             .agg((F.min(F.abs(F.col("left_us") - F.col("right_us"))) / 1e6).alias("time_difference_seconds")))
    return close.select(*ends, F.when(F.col("left_server_id") == F.col("right_server_id"), "SERVER").otherwise("ZONE").alias("scope"),
                        "time_difference_seconds",
                        pair_id(F.col("zone_id"), F.col("left_kind"), F.col("left_id"), F.col("right_kind"), F.col("right_id")).alias("source_id"),
                        F.lit("REASONING_CONTEXT").alias("type"))


def operational_candidates(nodes: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    keys = ["zone_id"]
    m = instants(nodes.where("kind = 'maintenance' AND state = 'AT_RISK'").select("zone_id", "id", "times"))
    e = instants(nodes.where(F.col("kind") == "environment").where(detector_abnormal(F.col("state"))).select("zone_id", "id", "times"))
    both = band_join(side(m, "left", keys), side(e, "right", keys), keys, "left_us", "right_us", window_us)
    return (both.groupBy("zone_id", "left_id", "right_id").agg((F.min(F.abs(F.col("left_us") - F.col("right_us"))) / 1e6).alias("time_difference_seconds"))
            .withColumn("source_id", F.concat(F.lit("OP-"), "left_id", F.lit("-"), "right_id")))


def operational_pairs(nodes: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Drive at risk x abnormal reading, one to one, closest first."""
    return greedy_one_to_one(operational_candidates(nodes, window_us), "left_id", "right_id", ["time_difference_seconds", "source_id"])


def image_candidates(observations: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """PPE x face of one camera and zone. `observations`: kind, id, zone_id, camera_id, us, received_us, source_sha256."""
    keys = ["zone_id", "camera_id"]
    cols = ["id", "us", "received_us", "source_sha256"]
    of = lambda kind: observations.where(F.col("kind") == kind).select(*keys, *cols)
    both = band_join(side(of("ppe"), "left", keys), side(of("face"), "right", keys), keys, "left_us", "right_us", window_us)
    same = F.coalesce(F.col("left_source_sha256") == F.col("right_source_sha256"), F.lit(False))
    return both.select(*keys, "left_id", "right_id", F.when(same, 0).otherwise(1).alias("not_same_source"),
                       (F.abs(F.col("left_us") - F.col("right_us")) / 1e6).alias("time_difference_seconds"),
                       (F.abs(F.col("left_received_us") - F.col("right_received_us")) / 1e6).alias("receipt_difference_seconds"),
                       (-F.greatest("left_received_us", "right_received_us")).alias("newest_first"))


def image_pairs(observations: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Same source bytes first, then time, receipt gap, newest, ids; one to one."""
    return greedy_one_to_one(image_candidates(observations, window_us), "left_id", "right_id",
                             ["not_same_source", "time_difference_seconds", "receipt_difference_seconds", "newest_first"])


def face_ssh_instants(faces: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zone_id, id, us) of both sides. A declared time replaces the log time; an uncertain or pre-2020 log time is not used."""
    trusted = F.when(F.col("declared_ts").isNotNull(), F.col("declared_ts")) \
               .when(~F.coalesce(F.col("timestamp_uncertain"), F.lit(False)) & (F.year("log_ts") >= 2020), F.col("log_ts"))
    l = logs.where("state <> 'NO_ANOMALY_EVIDENCE'").select("zone_id", "id", F.unix_micros(trusted).alias("us")).where("us IS NOT NULL")
    return faces.select("zone_id", "id", F.unix_micros("ts").alias("us")), l


def face_ssh_candidates(faces: DataFrame, logs: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Face x log evidence of one zone within the window: every candidate; how many to show is up to the reader."""
    f, l = face_ssh_instants(faces, logs)
    keys = ["zone_id"]
    both = band_join(side(f, "left", keys), side(l, "right", keys), keys, "left_us", "right_us", window_us)
    return (both.select("zone_id", "left_id", "right_id", (F.abs(F.col("left_us") - F.col("right_us")) / 1e6).alias("time_difference_seconds"),
                        F.concat(F.lit("FACE-SSH-"), "left_id", F.lit("-"), "right_id").alias("source_id")))


def as_edges(pairs: DataFrame, kind: str, left_kind: str, right_kind: str) -> DataFrame:
    """Dedicated matcher output in the shape of generic pairs."""
    return pairs.select("zone_id", F.lit(left_kind).alias("left_kind"), "left_id", F.lit(right_kind).alias("right_kind"), "right_id",
                        F.lit("ZONE").alias("scope"), "time_difference_seconds", "source_id", F.lit(kind).alias("type"))


def neighbour_links(rows: DataFrame, kinds: list[str], meet: Callable[[Column, Column], Column], window_us: int = WINDOW_US) -> DataFrame:
    """Links with the components of all pairs of one zone whose kinds meet and whose instants lie within the window.

    `rows`: zone_id, kind, id, us. Each instant links to the last instant before it and the first one after it of every kind that it
    meets. Between the two ends of a pair, of all instants of both kinds those next to each other with different kinds are
    linked, and an instant among its own kind shares its link with its neighbour; so the ends are connected, and a dense burst
    needs no quadratic number of links. Zones are cut into blocks of `BLOCK_WINDOWS` windows, so that a hot zone spreads over tasks; an instant
    within a window of the next block is copied there, which keeps all instants between the ends of a pair together.
    """
    block = lambda us: time_cell(us, BLOCK_WINDOWS * window_us)
    us, at = F.col("us"), F.struct("us", "id")
    placed = rows.where(us.isNotNull()).select("zone_id", "kind", "id", "us", F.explode(F.sequence(block(us - window_us), block(us + window_us))).alias("block"))
    order, by = ["us", "kind", "id"], Window.partitionBy("zone_id", "block")
    # most instants of a quiet zone have no other near them, of whatever kind
    alone = [F.coalesce(F.abs(us - f("us").over(by.orderBy(*order))) > window_us, F.lit(True)) for f in (F.lag, F.lead)]
    placed = placed.withColumn("alone", alone[0] & alone[1]).where("NOT alone")
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind, side: F.last(F.when(F.col("kind") == kind, at), ignorenulls=True).over(side)
    seen = placed.withColumns({f"{name}{k}": last(kind, side) for name, side in (("before", before), ("after", after)) for k, kind in enumerate(kinds)})
    end = lambda kind, c: F.when(meet(F.col("kind"), F.lit(kind)) & (F.abs(us - F.col(c)["us"]) <= window_us), F.struct(F.lit(kind).alias("right_kind"), F.col(c)["id"].alias("right_id")))
    ends = F.array(*[end(kind, f"{name}{k}") for name in ("before", "after") for k, kind in enumerate(kinds)])
    return seen.select("zone_id", F.col("kind").alias("left_kind"), F.col("id").alias("left_id"), F.inline(F.array_compact(F.array_distinct(ends))))


def spanning_links(nodes: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """At most two links per instant and kind with the same connected components as all generic pairs. A link may come more than once."""
    n = instants(eligible(nodes).select("zone_id", "kind", "id", "times"))
    kinds = sorted(r.kind for r in nodes.select("kind").distinct().collect() if r.kind is not None)
    return neighbour_links(n, kinds, compatible, window_us)


def face_ssh_links(faces: DataFrame, logs: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Links with the same connected components as all face x log candidates."""
    f, l = face_ssh_instants(faces, logs)
    rows = f.withColumn("kind", F.lit("face")).unionByName(l.withColumn("kind", F.lit("ssh")))
    return neighbour_links(rows, ["face", "ssh"], lambda a, b: a != b, window_us)


def containing(pairs: DataFrame, published: DataFrame) -> DataFrame:
    """Pairs with at least one end in the published set (kind, id)."""
    members = pairs.select("source_id", F.explode(F.array(
        F.struct(F.col("left_kind").alias("kind"), F.col("left_id").alias("id")),
        F.struct(F.col("right_kind").alias("kind"), F.col("right_id").alias("id")))).alias("m")).select("source_id", "m.*")
    hit = members.join(published, ["kind", "id"], "left_semi").select("source_id").distinct()
    return pairs.join(hit, "source_id", "left_semi")


def without_cleared(pairs: DataFrame, cleared: DataFrame) -> DataFrame:
    """Drop pairs with an end that a human cleared (kind, id)."""
    for end in ("left", "right"):
        named = cleared.select(F.col("kind").alias(f"{end}_kind"), F.col("id").alias(f"{end}_id"))
        pairs = pairs.join(named, [f"{end}_kind", f"{end}_id"], "left_anti")
    return pairs


def hash_candidates(left: DataFrame, right: DataFrame, limit: int = 6, hash_column: str = "phash", blocks: int = HASH_BLOCKS) -> DataFrame:
    """(left_hash, right_hash, right_id): distinct 64-bit hashes that agree on all of some choice of blocks, among them all pairs within `limit` bits.

    A hash is cut into `blocks` blocks of nearly equal length. Within `limit` differing bits at least blocks - limit of them are equal, so
    that every choice of that many blocks is one equi join. More blocks give longer keys: for limit 6, 10 blocks give 210 keys of 24 to 28 bits
    (about 4 chance meetings for a million pairs), 8 blocks 28 keys of 16 bits (about 430), for 7.5 times as many rows. A pair may come more than once.
    Equal hashes are collapsed first, so a hot hash costs one row per side and key. The planner does not see that a hash is dealt out many
    times and would broadcast all its rows: a merge join keeps them in shuffled, spillable partitions.
    """
    if not 0 <= limit < blocks <= 64:
        raise ValueError("limit must be between 0 and blocks - 1, blocks at most 64")
    h, edges = F.col(hash_column), [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - limit)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where(h.isNotNull()).groupBy(hash_column).agg(F.min("id").alias(f"{name}_id"))
        dealt = distinct.select(h.alias(f"{name}_hash"), f"{name}_id", F.posexplode(signed).alias("choice", "mask"))
        return dealt.select(f"{name}_hash", f"{name}_id", "choice", F.col(f"{name}_hash").bitwiseAND(F.col("mask")).alias("v"))

    return keyed(left, "left").join(keyed(right, "right").hint("merge"), ["choice", "v"]).select("left_hash", "right_hash", "right_id")


def near_duplicates(left: DataFrame, right: DataFrame, limit: int = 6, hash_column: str = "phash", blocks: int = HASH_BLOCKS) -> DataFrame:
    """Smallest Hamming distance <= limit between 64-bit hashes of two collections, nearest match kept (ties: smallest id)."""
    cand = hash_candidates(left, right, limit, hash_column, blocks)
    dist = F.bit_count(F.col("left_hash").bitwiseXOR(F.col("right_hash")))
    best = (cand.withColumn("distance", dist).where(F.col("distance") <= limit).groupBy("left_hash")
            .agg(F.min(F.struct("distance", "right_id")).alias("m")))
    return left.join(best, left[hash_column] == best["left_hash"]).select(left["id"], F.col("m.distance").alias("distance"), F.col("m.right_id").alias("nearest_id"))
