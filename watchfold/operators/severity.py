"""Rule severities for events, incidents and groups, with human verdicts laid over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.operators import bayes, ranks
from watchfold.operators.assess import detector_abnormal, domain_of
from watchfold.session import materialize

LEVELS = ["LOW", "MEDIUM", "HIGH"]
# Severity and rule name of one abnormal event by (domain, state).
SINGLE_EVENT_RULES = [
    ("CYBERSECURITY", ["EXPLICIT_SECURITY_EVENT", "HIGH_CONFIDENCE_ANOMALY", "ANOMALY_CANDIDATE", "ANOMALOUS"], "MEDIUM", "CYBERSECURITY_ANOMALY_EVIDENCE"),
    ("PHYSICAL_SECURITY", ["UNKNOWN_PERSON"], "MEDIUM", "UNKNOWN_PERSON_IN_ZONE"),
    ("SAFETY", ["PPE_NON_COMPLIANT", "NON_COMPLIANT"], "LOW", "PPE_NON_COMPLIANCE"),
    ("MAINTENANCE", ["AT_RISK"], "LOW", "DRIVE_FAILURE_RISK"),
]
UNAUTHORIZED_RULE = ("MEDIUM", "UNAUTHORIZED_PHYSICAL_ACCESS_EVIDENCE")
ENVIRONMENTAL_RULE = ("LOW", "ENVIRONMENTAL_CONDITION")
LINKAGE_RULES = ["L1_SERVER_OR_UNAUTHORIZED_CYBER", "L2_KNOWN_MECHANISM_WITHIN_10_MIN", "L3_ANY_MECHANISM_WITHIN_10_MIN", "L4_ANY_MECHANISM_WITHIN_5_MIN"]
SELECTED_RULE = "L2_KNOWN_MECHANISM_WITHIN_10_MIN"


def level_name(rank: Column) -> Column:
    return F.when(rank == 1, "LOW").when(rank == 2, "MEDIUM").when(rank == 3, "HIGH")


def event_rules(domain: Column, state: Column, authorization: Column) -> Column:
    """Array of (rank, rule) that one event triggers; empty when it is not abnormal."""
    hit = lambda level, rule: F.struct(F.lit(LEVELS.index(level) + 1).alias("rank"), F.lit(rule).alias("rule"))
    no = lambda c: F.coalesce(c, F.lit(False))
    unauthorized = no(authorization == "UNAUTHORIZED") | no((domain == "PHYSICAL_SECURITY") & (state == "UNAUTHORIZED"))
    table = None
    for d, states, level, rule in SINGLE_EVENT_RULES:
        cond = (domain == d) & state.isin(*states)
        table = F.when(cond, hit(level, rule)) if table is None else table.when(cond, hit(level, rule))
    table = table.when((domain == "ENVIRONMENTAL") & ~state.isin("NORMAL", "NO_ANOMALY"), hit(*ENVIRONMENTAL_RULE))
    return F.array_compact(F.array(F.when(unauthorized, hit(*UNAUTHORIZED_RULE)), table))


def with_event_severity(events: DataFrame) -> DataFrame:
    rules = event_rules(F.col("domain"), F.col("state"), F.col("authorization"))
    return events.withColumn("event_rules", rules).withColumn("severity_rank", F.array_max(F.transform("event_rules", lambda r: r["rank"]))) \
                 .withColumn("severity", level_name(F.col("severity_rank")))


def incident_severity(events: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Earlier domain policy: unauthorized, cyber, maintenance + environment are MEDIUM; confirmed compromise or three domains HIGH."""
    g = events.groupBy(key).agg(F.collect_set("domain").alias("ds"),
                                F.bool_or(F.coalesce(F.col("authorization") == "UNAUTHORIZED", F.lit(False))).alias("unauthorized"),
                                F.bool_or(F.coalesce("confirmed_compromise", F.lit(False))).alias("compromise"),
                                F.bool_or(F.coalesce(F.col("grounding_status") == "INSUFFICIENT", F.lit(False))).alias("insufficient"))
    cyber = F.array_contains("ds", "CYBERSECURITY")
    operational = F.array_contains("ds", "MAINTENANCE") & F.array_contains("ds", "ENVIRONMENTAL")
    many = F.size("ds") >= 3
    rules = F.array_compact(F.array(
        F.when(F.col("unauthorized"), "UNAUTHORIZED_PHYSICAL_ACCESS_EVIDENCE"), F.when(cyber, "CYBERSECURITY_ANOMALY_EVIDENCE"),
        F.when(operational, "CORRELATED_OPERATIONAL_RISK"), F.when(F.col("compromise"), "CONFIRMED_COMPROMISE"), F.when(many, "MULTI_DOMAIN_CORRELATED_RISK")))
    return g.select(key, F.when(F.col("insufficient"), "EVIDENCE_REVIEW_REQUIRED").otherwise("REVIEW_REQUIRED").alias("incident_status"),
                    F.when(many | F.col("compromise"), "HIGH").when(F.col("unauthorized") | cyber | operational, "MEDIUM").otherwise("LOW").alias("severity"),
                    F.array_join(rules, ",").alias("rules_triggered"))


def linkage(concern: DataFrame, key: str) -> DataFrame:
    """Observable signs that the members of a group belong together; plain aggregates, no gathered member list."""
    physical = F.col("domain") == "PHYSICAL_SECURITY"
    unauthorized = physical & F.coalesce((F.col("authorization") == "UNAUTHORIZED") | (F.col("state") == "UNAUTHORIZED"), F.lit(False))
    g = concern.groupBy(key).agg(
        F.count(F.lit(1)).alias("concern_members"),
        (F.count("server_id") > F.count_distinct("server_id")).alias("same_server"),
        (F.count("rack_id") > F.count_distinct("rack_id")).alias("same_rack"),
        F.bool_or(unauthorized).alias("unauthorized"), F.collect_set("domain").alias("ds"),
        F.max("severity_rank").alias("base_rank"),
        ((F.max("us") - F.min("us")) / 60e6).alias("spread"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("event_rules", lambda r: r["rule"]))))), ",").alias("rules_triggered"))
    has = lambda d: F.array_contains("ds", d)
    known = reduce(lambda a, b: a | b, [has(x) & has(y) for x, y in (p.split("|") for p in bayes.KNOWN)])
    return g.withColumns({"unauthorized_with_cyber": F.col("unauthorized") & has("CYBERSECURITY"), "known_mechanism": known,
                          "time_spread_minutes": F.bround("spread", 1)}).drop("unauthorized", "ds", "spread")


def linked(rule: str) -> Column:
    any_mechanism = F.col("same_server") | F.col("unauthorized_with_cyber") | F.col("known_mechanism")
    within = lambda m: F.coalesce(F.col("time_spread_minutes") <= m, F.lit(False))
    return {
        "L1_SERVER_OR_UNAUTHORIZED_CYBER": F.col("same_server") | F.col("unauthorized_with_cyber"),
        "L2_KNOWN_MECHANISM_WITHIN_10_MIN": F.col("known_mechanism") & within(10),
        "L3_ANY_MECHANISM_WITHIN_10_MIN": any_mechanism & within(10),
        "L4_ANY_MECHANISM_WITHIN_5_MIN": any_mechanism & within(5),
    }[rule]


def decide_groups(events: DataFrame, key: str = "group_id", rule: str = SELECTED_RULE) -> DataFrame:
    """Most severe concern member, one level up when the linkage rule holds for two or more; HIGH is the top."""
    concern = with_event_severity(events).where("severity_rank IS NOT NULL")
    d = linkage(concern, key).withColumn("escalated", (F.col("concern_members") >= 2) & linked(rule))
    rank = F.when(F.col("escalated"), F.least(F.col("base_rank") + 1, F.lit(3))).otherwise(F.col("base_rank"))
    return d.select(key, level_name(F.col("base_rank")).alias("base_severity"), level_name(rank).alias("severity"), "escalated",
                    F.when(F.col("escalated"), F.concat("rules_triggered", F.lit(",LINKED_GROUP_ESCALATION"))).otherwise(F.col("rules_triggered")).alias("rules_triggered"),
                    "same_server", "same_rack", "unauthorized_with_cyber", "known_mechanism", "time_spread_minutes", "concern_members")


# Human verdict vocabulary that counts as normal.
CLEARED_STATES = ["NO_ANOMALY_EVIDENCE", "NORMAL", "COMPLIANT", "AUTHORIZED", "NO_PERSON", "NO_FACE", "NO_ANOMALY"]


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Newest verdict per item; an override also says whether the item is abnormal."""
    last = verdicts.groupBy("kind", F.col("evidence_id").alias("id")).agg(
        F.max_by(F.struct("verdict", "corrected_status", "recorded_at"), F.struct("recorded_at", "verdict")).alias("v"))
    over = F.col("v.verdict") == "OVERRIDDEN"
    return last.select("kind", "id", "v.verdict", "v.recorded_at", F.when(over, F.col("v.corrected_status")).alias("effective_status"),
                       F.when(over, ~F.col("v.corrected_status").isin(*CLEARED_STATES)).alias("human_abnormal"))


def members_with_review(members: DataFrame, nodes: DataFrame, latest: DataFrame) -> DataFrame:
    """Group members with detector state, verdict, cleared flag and active concern."""
    joined = members.join(nodes.select("kind", "id", "state", "server_id", "rack_id", "us"), ["kind", "id"]).join(latest, ["kind", "id"], "left")
    human = F.col("human_abnormal")
    return joined.withColumns({
        "domain": domain_of(F.col("kind")), "detector_abnormal": detector_abnormal(F.col("state")),
        "effective_state": F.coalesce("effective_status", "state"),
        "cleared_by_human": F.coalesce(~human, F.lit(False)),
    }).withColumn("active_concern", ~F.col("cleared_by_human") & (F.coalesce(human, F.lit(False)) | F.col("detector_abnormal")))


def group_severity_by_domain(reviewed: DataFrame) -> DataFrame:
    """Provisional policy: the earlier domain rules over active-concern members."""
    a = reviewed.where("active_concern").withColumns({
        "authorization": F.when((F.col("kind") == "face") & (F.col("effective_state") == "UNAUTHORIZED"), "UNAUTHORIZED"),
        "confirmed_compromise": F.lit(False), "grounding_status": F.lit(None).cast("string")})
    return incident_severity(a, "group_id").drop("incident_status")


def decision_events(reviewed: DataFrame) -> DataFrame:
    """Active-concern members in the shape the group rule reads: a face verdict of UNAUTHORIZED is an authorization."""
    unauthorized = (F.col("kind") == "face") & (F.col("effective_state") == "UNAUTHORIZED")
    return reviewed.where("active_concern").withColumns({
        "authorization": F.when(unauthorized, "UNAUTHORIZED"),
        "state": F.when(unauthorized, "RECOGNIZED").otherwise(F.col("effective_state"))})


def annotate_groups(reviewed: DataFrame, rule: str = SELECTED_RULE) -> DataFrame:
    """Groups with at least two members left, with their decision (none when no active concern is left)."""
    alive = reviewed.groupBy("group_id", "zone_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("cleared_by_human")).alias("uncleared")) \
                    .where("uncleared >= 2")
    return alive.join(decide_groups(decision_events(reviewed), "group_id", rule), "group_id", "left")


def standalone_decisions(nodes: DataFrame, latest: DataFrame) -> DataFrame:
    """One decision per event: a cleared event has none, an overridden one uses the human state."""
    j = nodes.join(latest, ["kind", "id"], "left")
    over = F.coalesce(F.col("verdict") == "OVERRIDDEN", F.lit(False))
    cleared = over & F.coalesce(~F.col("human_abnormal"), F.lit(False))
    j = j.withColumns({"domain": domain_of(F.col("kind")), "state": F.when(over, F.col("effective_status")).otherwise(F.col("state")),
                       "authorization": F.lit(None).cast("string"), "input_source": F.when(over, "HUMAN_OVERRIDE").otherwise("DETECTOR")})
    s = with_event_severity(j)
    rules = F.array_join(F.transform("event_rules", lambda r: r["rule"]), ",")
    return s.select("kind", "id", F.col("state").alias("effective_state"), "input_source",
                    F.when(~cleared, F.col("severity")).alias("severity"),
                    F.when(cleared, "INPUT_CLEARED_BY_HUMAN_VERDICT").otherwise(rules).alias("rules_triggered"),
                    F.when(~cleared & F.col("severity").isNotNull(), "REVIEW_REQUIRED").otherwise("NO_ACTIVE_CONCERN").alias("incident_status"))


def group_review_reasons(reviewed: DataFrame, edge_types: DataFrame, severities: DataFrame) -> DataFrame:
    """Reasons a group needs source review, and its disposition. Only flags are aggregated per group."""
    live = ~F.col("cleared_by_human")
    open_review = live & (F.col("verdict").isNull() | (F.col("verdict") == "INCONCLUSIVE"))
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    kind = lambda k: F.col("kind") == k
    override = F.col("verdict") == "OVERRIDDEN"
    flags = reviewed.groupBy("group_id").agg(
        any_of(F.col("cleared_by_human")).alias("cleared"),
        any_of(live & F.col("active_concern") & F.col("verdict").isin("CONFIRMED", "OVERRIDDEN")).alias("verified"),
        any_of(live & kind("ssh")).alias("ssh"), any_of(open_review & kind("ppe")).alias("ppe"), any_of(open_review & kind("face")).alias("face"),
        any_of(live & kind("face") & override & (F.col("effective_status") == "UNAUTHORIZED")).alias("face_human"),
        any_of(live & kind("face") & (F.col("state") == "UNAUTHORIZED") & ~F.coalesce(F.col("effective_status").isin("AUTHORIZED", "NO_FACE"), F.lit(False))).alias("face_zone"),
        any_of(open_review & kind("maintenance")).alias("maintenance"), any_of(open_review & kind("environment")).alias("environment"))
    types = edge_types.groupBy("group_id").agg(any_of(F.col("type") == "FACE_SSH_CONTEXT").alias("face_ssh"))
    j = flags.join(types, "group_id", "left").join(severities.select("group_id", "severity"), "group_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("cleared"), "HUMAN_CLEARED_MEMBERS_PRESENT"), F.when(F.col("verified"), "HUMAN_VERIFIED_CONCERNS_PRESENT"),
        F.when(F.col("ssh"), "CYBERSECURITY_EVIDENCE_PRESENT"), F.when(F.col("ppe"), "PPE_EVIDENCE_REQUIRES_SOURCE_REVIEW"),
        F.when(F.col("face"), "FACE_IDENTITY_CONTEXT_UNVERIFIED"), F.when(F.col("face_human"), "UNAUTHORIZED_BY_HUMAN_VERDICT"),
        F.when(F.col("face_zone"), "RECOGNIZED_IDENTITY_NOT_AUTHORIZED_FOR_DECLARED_ZONE"),
        F.when(F.col("maintenance"), "MAINTENANCE_RISK_REQUIRES_SOURCE_REVIEW"), F.when(F.col("environment"), "ENVIRONMENTAL_CONDITION_REQUIRES_SOURCE_REVIEW"),
        F.when(F.col("face_ssh"), "FACE_SSH_CONTEXTUAL_ASSOCIATION_UNVERIFIED")))
    return j.select("group_id", F.array_join(reasons, ",").alias("review_reasons"), "severity",
                    F.when(F.size(reasons) > 0, "EVIDENCE_REVIEW_REQUIRED").when(F.col("severity").isin("MEDIUM", "HIGH"), "REVIEW_REQUIRED")
                     .otherwise("OBSERVATION_RECORDED").alias("status"))


def physical_review(pairs: DataFrame) -> DataFrame:
    """Review reasons of a PPE x face pair (ppe_status, ppe_override, face_status)."""
    used = F.coalesce("ppe_override", "ppe_status")
    over = F.col("ppe_override").isNotNull()
    reasons = F.array_compact(F.array(
        F.when((used == "NON_COMPLIANT") & over, "PPE_NON_COMPLIANT_HUMAN_VERDICT").when(used == "NON_COMPLIANT", "PPE_NON_COMPLIANT_DETECTOR_ASSESSMENT"),
        F.when(F.col("face_status") != "RECOGNIZED", "FACE_RECOGNITION_NOT_ESTABLISHED")))
    return pairs.withColumns({"ppe_status_used": used, "reasons": F.array_join(reasons, ","),
                              "status": F.when(F.size(reasons) > 0, "EVIDENCE_REVIEW_REQUIRED").otherwise("OBSERVATION_RECORDED")})


def _dyadic(first, end, levels):
    """(level, block) of the aligned blocks of 2^level places that make up the places first..end-1; two for each level at most."""
    def at(i):
        size = F.pow(F.lit(2.0), i).cast("long")
        low, high = F.floor((first + size - 1) / size), F.floor(end / size)
        taken = low < high
        return F.array(F.when(taken & (low % 2 == 1), F.struct(i.alias("level"), low.alias("block"))),
                       F.when(taken & (high % 2 == 1), F.struct(i.alias("level"), (high - 1).alias("block"))))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def tightest_times(members: DataFrame) -> DataFrame:
    """Per group member the observation time that keeps the group tightest (group_id, kind, id, times).

    Every member time is an anchor; each member answers with its nearest time (of two equally near the
    earlier), and the anchor with the smallest spread (then the earliest) wins.

    Anchors stand on one sorted time line. A member's answer changes half-way between two of its times only, so each of its times
    answers for one run of anchors, and no member meets the anchors one by one: a run is cut into aligned blocks of 2^k anchors,
    least and greatest answer are kept for each block (a partial aggregate), and an anchor looks at the blocks it lies
    in. Work is (times x log anchors), all of it keyed by group and block or place, so a large group spreads over tasks.
    Members with one time answer the same everywhere and enter as one pair of bounds."""
    us = F.array_sort(F.array_distinct(F.transform(F.filter("times", lambda t: t.isNotNull()), lambda t: F.unix_micros(t))))
    m = materialize(members.select("group_id", "kind", "id", us.alias("us")).where(F.size("us") > 0), "group-times")  # read in five places below
    fixed = m.where(F.size("us") == 1).groupBy("group_id").agg(F.min(F.col("us")[0]).alias("lo"), F.max(F.col("us")[0]).alias("hi"))
    # twice the time, so that the middle of two times is a whole number
    halves = F.transform(F.sequence(F.lit(1), F.size("us") - 1), lambda j: F.get("us", j) + F.get("us", j - 1))
    several = m.where(F.size("us") > 1).withColumn("mid", halves)
    last = F.size("us") - 1
    pieces = several.select("group_id", F.posexplode("us").alias("j", "answer"), "mid", last.alias("last")).select(
        "group_id", "answer", F.when(F.col("j") > 0, F.get("mid", F.col("j") - 1)).alias("after"), F.when(F.col("j") < F.col("last"), F.get("mid", F.col("j"))).alias("upto"))
    anchors = m.select("group_id", F.explode("us").alias("anchor")).distinct()
    line = anchors.select("group_id", (F.col("anchor") * 2).alias("x"), F.lit(1).alias("anchors")).unionByName(
        several.select("group_id", F.explode("mid").alias("x"), F.lit(0).alias("anchors")))
    placed = ranks.cumulative(line, ["group_id"], "x", {"n": F.sum("anchors")})
    places = placed.select("group_id", "x", "n_cum")
    totals = anchors.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))
    of = lambda name, place: places.select("group_id", F.col("x").alias(name), F.col("n_cum").alias(place))
    runs = pieces.join(of("after", "first"), ["group_id", "after"], "left").join(of("upto", "end"), ["group_id", "upto"], "left").join(totals, "group_id")
    runs = runs.select("group_id", "answer", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("end", "total").alias("end"), _levels("total").alias("levels")).where("first < end")
    blocks = (runs.select("group_id", "answer", F.inline(_dyadic(F.col("first"), F.col("end"), F.col("levels"))))
              .groupBy("group_id", "level", "block").agg(F.min("answer").alias("nlo"), F.max("answer").alias("nhi")))
    at = placed.where("n > 0").select("group_id", F.expr("x div 2").alias("anchor"), (F.col("n_cum") - 1).alias("place"), _levels("n_total").alias("levels"))
    seen = at.select("group_id", "anchor", F.inline(F.transform(F.sequence(F.lit(0), F.col("levels")), lambda i: F.struct(i.alias("level"), F.floor(F.col("place") / F.pow(F.lit(2.0), i).cast("long")).alias("block")))))
    answers = seen.join(blocks, ["group_id", "level", "block"]).groupBy("group_id", "anchor").agg(F.min("nlo").alias("nlo"), F.max("nhi").alias("nhi"))
    spread = (anchors.join(fixed, "group_id", "left").join(answers, ["group_id", "anchor"], "left")
              .select("group_id", "anchor", (F.greatest("hi", "nhi") - F.least("lo", "nlo")).alias("spread")))
    best = spread.groupBy("group_id").agg(F.min(F.struct("spread", "anchor")).alias("b"))
    nearest = lambda a: F.aggregate("us", F.col("us")[0], lambda best, x: F.when(F.abs(x - a) < F.abs(best - a), x).otherwise(best))
    return (m.join(best, "group_id").select("group_id", "kind", "id", (nearest(F.col("b.anchor"))).alias("chosen_us"),
                                            (F.col("b.spread") / 1e6).alias("spread_seconds")))


def _levels(total: str):
    """Block sizes 1, 2, 4, ... up to the smallest that holds all places."""
    return F.ceil(F.log2(F.greatest(F.col(total), F.lit(1)).cast("double"))).cast("int")
