"""Connected components per zone and stable group records."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from watchfold.functions.ids import short_sha
from watchfold.session import Scratch

MIN_GROUP_MEMBERS = 3
# Edges that are contracted together in a task; bounds its memory, changes no result.
CHUNK_EDGES = 100_000


def _codes(array: pa.Array) -> np.ndarray:
    """Numbers with the order and equality that Spark gives the values: structs field by field, nulls inside them first."""
    if pa.types.is_struct(array.type):
        codes = np.zeros(len(array), np.int64)
        for field in map(_codes, array.flatten()):
            codes = np.unique(codes * (field.max() + 1) + field, return_inverse=True)[1]
        return codes
    coded = array.dictionary_encode()
    rank = np.zeros(len(coded.dictionary) + 1, np.int64)  # the last place is that of null
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
    return rank[coded.indices.fill_null(len(rank) - 1).to_numpy()]


def _nullable(array: pa.Array) -> pa.Array:
    """The array with fields that may be null: the two ends of an edge can differ in that."""
    if not pa.types.is_struct(array.type):
        return array
    return pa.StructArray.from_arrays([_nullable(child) for child in array.flatten()], names=[field.name for field in array.type], mask=array.is_null())


def _contracted(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(node, root) for every end of the edges of a chunk; the root is the smallest node connected to it inside the chunk."""
    ends = pa.concat_arrays([_nullable(batch.column(k)) for k in (0, 1) for batch in chunk])
    _, place, node = np.unique(_codes(ends), return_index=True, return_inverse=True)
    parent = list(range(len(place)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    half = len(node) // 2
    for a, b in zip(node[:half].tolist(), node[half:].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(place))])
    return pa.RecordBatch.from_arrays([ends.take(pa.array(place)), ends.take(pa.array(place[roots]))], ["node", "root"])


def _contract(batches, chunk_edges: int):
    """Edges of a task, chunk by chunk: a forest of stars with the same components inside each chunk."""
    chunk, rows = [], 0
    for batch in batches:
        chunk.append(batch)
        rows += batch.num_rows
        if rows >= chunk_edges:
            yield _contracted(chunk)
            chunk, rows = [], 0
    if rows:
        yield _contracted(chunk)


def local_components(edges: DataFrame, near: list[str], left: str = "src", right: str = "dst", chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """`connected_components` of edges whose components mostly lie within one value of the columns `near`.

    Tasks hold whole values of `near` where these are small (a large one is split), and contract their edges, a bounded chunk at a time, to one star
    for each component that the chunk sees. Whatever `near` is, a node in two chunks links their stars: only these links, usually few, go
    through the rounds of star contraction over the cluster, and the stars take over the result.
    """
    scratch = Scratch(edges.sparkSession, "lc")
    dealt = edges.where(F.col(left) != F.col(right)).hint("rebalance", *near).sortWithinPartitions(*near).select(left, right)
    kind = dealt.schema[left].dataType
    if isinstance(kind, T.StructType):
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
    stars = scratch.table(dealt.mapInArrow(partial(_contract, chunk_edges=chunk_edges), T.StructType([T.StructField("node", kind), T.StructField("root", kind)])))
    links, (open_links,) = scratch.table(stars.withColumn("least", F.min("root").over(Window.partitionBy("node"))).where("root <> least")
                                         .select(F.col("root").alias("src"), F.col("least").alias("dst")), F.count(F.lit(1)))
    if not open_links:
        return stars.withColumnRenamed("root", "component")
    joined = connected_components(links).withColumnRenamed("node", "root")
    return stars.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("component")).distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each component, by alternating star contraction.

    Large-star links every larger neighbour to the smallest one, small-star links the smaller
    ones; both are a `min` aggregate (partial before the shuffle) and one join. The number of
    rounds grows with the logarithm of the component size. Each round is written to the
    shared folder and the round before is dropped, so plans and disk stay small and lost
    executors cost one round. Null ends and self loops are left out.
    """
    scratch = Scratch(edges.sparkSession, "cc")
    state = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    pairs, before = scratch.table(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), *state)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every u > v here: the smaller neighbours of u all meet in its smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after, seen = scratch.table(small, *state)
        scratch.drop(pairs)
        pairs = after
        if seen == before:
            break
        before = seen
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def node_key(zone: Column, kind: Column, oid: Column) -> Column:
    return F.concat_ws("|", zone, F.concat_ws(":", kind, oid))


def group_members(edges: DataFrame) -> DataFrame:
    """(zone_id, kind, id, component) for every end of every edge; zones never mix.

    Nodes stay structs throughout, so any character may stand in a zone, kind or id. `component` is the smallest member.
    """
    end = lambda side: F.struct("zone_id", F.col(f"{side}_kind").alias("kind"), F.col(f"{side}_id").alias("id"))
    labels = local_components(edges.select("zone_id", end("left").alias("src"), end("right").alias("dst")), ["zone_id"])
    return labels.select("node.*", "component")


def with_group_ids(members: DataFrame, min_members: int = MIN_GROUP_MEMBERS, prefix: str = "GROUP-") -> DataFrame:
    """Members of groups with at least `min_members`, with a group ID that depends only on membership.

    The ID is a hash of zone, member count, and the sum and exclusive or of 60-bit hashes of the members: partial
    aggregates that need no order, so groups of any size get theirs the same way and none is gathered in one row.
    """
    ref = F.to_json(F.array("kind", "id"))
    by = ["zone_id", "component"]
    h = F.conv(F.substring(F.sha2(ref, 256), 1, 15), 16, 10).cast("long")
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("member_count"), F.sum(h.cast("decimal(38,0)")).alias("s1"), F.bit_xor(h).alias("s2"))
    ids = sizes.where(F.col("member_count") >= min_members).select(
        *by, "member_count", F.concat(F.lit(prefix), short_sha(F.concat_ws("|", "zone_id", "member_count", "s1", "s2"))).alias("group_id"))
    return members.join(ids, by)


def group_edges(edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """Edges of the kept groups, each with its group ID."""
    ends = grouped.select("zone_id", F.col("kind").alias("left_kind"), F.col("id").alias("left_id"), "group_id")
    return edges.join(ends, ["zone_id", "left_kind", "left_id"])


def multi_domain_correlations(events: DataFrame, window_us: int, minimum_domains: int = 2) -> DataFrame:
    """Per scenario and zone: all abnormal events together, kept when they span at most the window
    and cover enough domains; scope SERVER or RACK only when every event shares it."""
    same = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    g = events.where("abnormal").groupBy("scenario_id", "zone_id").agg(
        F.count_distinct("id").alias("event_count"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"),
        F.count_distinct("domain").alias("domain_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        same("server_id").alias("one_server"), same("rack_id").alias("one_rack"), F.min("server_id").alias("server"), F.min("rack_id").alias("rack"))
    kept = g.where((F.col("domain_count") >= minimum_domains) & (F.col("last_us") - F.col("first_us") <= window_us))
    scope = F.when(F.col("one_server"), "SERVER").when(F.col("one_rack"), "RACK").otherwise("ZONE")
    return kept.select("scenario_id", "zone_id", "event_count", "domains", scope.alias("scope"),
                       F.when(F.col("one_server"), F.col("server")).when(F.col("one_rack"), F.col("rack")).otherwise(F.col("zone_id")).alias("shared_entity"),
                       ((F.col("last_us") - F.col("first_us")) / 1e6).alias("span_seconds"))
