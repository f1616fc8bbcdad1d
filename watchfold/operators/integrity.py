"""Referential integrity of an event graph: one row for every violated rule.

All checks are grouped counts and anti-joins over edge tables. Counts are taken before tables meet, so a shared entity that a third of the
correlations name is one row on its side of the join, and no group is gathered.

Edges are (src_type, src, rel, dst_type, dst); nodes are (kind, id). Repeated edges count once, repeated nodes are what a rule looks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

EDGE = ["src_type", "src", "rel", "dst_type", "dst"]
# What an event of a domain must be linked to, and the way from a server to its site.
SOURCE_LINKS = {"CYBERSECURITY": ("ORIGINATED_FROM", "SourceIP")}
PLACEMENT = [("Server", "LOCATED_IN", "Rack"), ("Rack", "LOCATED_IN", "Zone"), ("Zone", "PART_OF", "DataCenter")]


def _violation(df: DataFrame, rule: str, subject: str, related: Column, found: Column, expected: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), related.cast("string").alias("related"),
                     found.cast("long").alias("found"), expected.cast("long").alias("expected"))


def contributing_events(correlations: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Relational division: every listed event of a correlation exists, and it lists at least one.

    correlations: correlation_id; members: correlation_id, event_id; events: event_id. One row per missing event,
    with the correlation's existing and listed events, and one per correlation without any."""
    listed = members.select("correlation_id", "event_id").distinct()
    known = events.select("event_id").distinct().withColumn("__there", F.lit(1))
    met = listed.join(known, "event_id", "left")
    counted = met.groupBy("correlation_id").agg(F.count("__there").alias("found"), F.count(F.lit(1)).alias("listed"))
    incomplete = counted.where("found < listed")
    missing = met.where("__there IS NULL").select("correlation_id", "event_id").join(incomplete, "correlation_id")
    none = correlations.select("correlation_id").distinct().join(counted, "correlation_id", "left_anti")
    return _violation(missing, "MISSING_EVENT", "correlation_id", F.col("event_id"), F.col("found"), F.col("listed")).unionByName(
        _violation(none, "NO_EVENTS", "correlation_id", F.lit(None), F.lit(0), F.lit(1)))


def shared_entities(correlations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entity a correlation shares exists exactly once. correlations: correlation_id, scope (a node kind), shared_entity_id."""
    counted = nodes.groupBy(F.col("kind").alias("scope"), F.col("id").alias("shared_entity_id")).agg(F.count(F.lit(1)).alias("found"))
    bad = correlations.join(counted, ["scope", "shared_entity_id"], "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found <> 1")
    return _violation(bad, "SHARED_ENTITY_NOT_UNIQUE", "correlation_id", F.concat_ws(":", "scope", "shared_entity_id"), F.col("found"), F.lit(1))


def source_links(events: DataFrame, edges: DataFrame, rules: dict[str, tuple[str, str]] = SOURCE_LINKS) -> DataFrame:
    """Events of a domain with a source rule that have no such edge. events: event_id, domain; rules: domain -> (relation, node type)."""
    parts = []
    for domain, (rel, dst_type) in rules.items():
        linked = edges.where((F.col("src_type") == "Event") & (F.col("rel") == rel) & (F.col("dst_type") == dst_type)).select(F.col("src").alias("event_id"))
        bare = events.where(F.col("domain") == domain).select(F.col("event_id").cast("string")).distinct().join(linked, "event_id", "left_anti")
        parts.append(_violation(bare, "MISSING_SOURCE_LINK", "event_id", F.lit(f"{rel}:{dst_type}"), F.lit(0), F.lit(1)))
    return reduce(DataFrame.unionByName, parts)


def relationships(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared edges that are absent, and edges declared absent (expected = false) that are there. declared: EDGE columns, expected."""
    there = edges.select(*EDGE).distinct().withColumn("__there", F.lit(True))
    met = declared.select(*EDGE, "expected").distinct().join(there, EDGE, "left").withColumn("__there", F.coalesce("__there", F.lit(False)))
    bad = met.where(F.col("__there") != F.col("expected"))
    what = F.concat_ws(":", "rel", "dst_type", "dst")
    part = lambda rule, keep: _violation(bad.where(keep), rule, "src", what, F.col("__there").cast("int"), F.col("expected").cast("int"))
    return part("MISSING_RELATIONSHIP", F.col("expected")).unionByName(part("FORBIDDEN_RELATIONSHIP", ~F.col("expected")))


def placements(nodes: DataFrame, edges: DataFrame, chain: list[tuple[str, str, str]] = PLACEMENT) -> DataFrame:
    """Nodes of the chain's first kind that do not reach exactly one node at its end. One equi-join for each step."""
    first = chain[0][0]
    reached = nodes.where(F.col("kind") == first).select(F.col("id").alias("start")).distinct().withColumn("at", F.col("start"))
    for src_type, rel, dst_type in chain:
        hop = edges.where((F.col("src_type") == src_type) & (F.col("rel") == rel) & (F.col("dst_type") == dst_type)).select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
        reached = reached.join(hop, "at", "left").select("start", F.col("next").alias("at")).distinct()
    counted = reached.groupBy("start").agg(F.count("at").alias("found")).where("found <> 1")
    return _violation(counted, "BROKEN_PLACEMENT", "start", F.lit(chain[-1][2]), F.col("found"), F.lit(1))


def node_counts(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Kinds whose number of nodes is not the expected one. expected: kind, expected."""
    counted = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("found"))
    met = expected.join(counted, "kind", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return _violation(met.where("found <> expected"), "NODE_COUNT", "kind", F.lit(None), F.col("found"), F.col("expected"))


def graph_violations(correlations: DataFrame, members: DataFrame, events: DataFrame, nodes: DataFrame, edges: DataFrame, declared: DataFrame, expected: DataFrame) -> DataFrame:
    """All rules as one table (rule, subject, related, found, expected); an empty result is a sound graph."""
    return reduce(DataFrame.unionByName, [contributing_events(correlations, members, events), shared_entities(correlations, nodes), source_links(events, edges),
                                          relationships(declared, edges), placements(nodes, edges), node_counts(nodes, expected)])


def scenario_status(expected: DataFrame, events: DataFrame, edges: DataFrame, rules: dict[str, tuple[str, str]] = SOURCE_LINKS) -> DataFrame:
    """Per scenario: PASS or INCOMPLETE, expected and observed events, missing events and events without their source link.

    expected: scenario_id, event_id; events: scenario_id, event_id, domain. A scenario without observed events is listed, one
    that nothing is expected of is not."""
    wanted, seen = expected.select("scenario_id", "event_id").distinct(), events.select("scenario_id", "event_id").distinct()
    here = seen.withColumn("__seen", F.lit(1))
    missing = wanted.join(here, ["scenario_id", "event_id"], "left").groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("expected_events"), F.count_if(F.col("__seen").isNull()).alias("missing_events"))
    bare = source_links(events, edges, rules).select(F.col("subject").alias("event_id")).distinct()
    unlinked = seen.withColumn("event_id", F.col("event_id").cast("string")).join(bare, "event_id").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("unlinked_events"))
    observed = seen.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("observed_events"))
    all_of = missing.join(observed, "scenario_id", "left").join(unlinked, "scenario_id", "left").na.fill(0, ["observed_events", "unlinked_events"])
    sound = (F.col("missing_events") == 0) & (F.col("unlinked_events") == 0)
    return all_of.withColumn("status", F.when(sound, "PASS").otherwise("INCOMPLETE"))
