"""Group queries: components, severities, review overlays, operator views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from watchfold.functions import ids
from watchfold.operators import assess, bayes, graph, metrics, pairs as P, severity as S
from watchfold.plans import bindings as B
from watchfold.plans.pairs import (ABN_SQL, CAND_SQL, CLEARED_SQL, DOMAIN_SQL, EDGES_SQL, GENERIC_CTE, NODES, all_edges, candidates, face_ssh, face_ssh_links, image_matches,
                                   live_nodes, model_events, one_to_one_matchers, scenario_events, written_nodes)
from watchfold.plans.registry import query
from watchfold.session import materialize

# Connected components by transitive closure, for the SQL check only.
REACH = """, sym AS (SELECT zone_id || '|' || left_kind || ':' || left_id AS a, zone_id || '|' || right_kind || ':' || right_id AS b FROM {edges}
  UNION SELECT zone_id || '|' || right_kind || ':' || right_id, zone_id || '|' || left_kind || ':' || left_id FROM {edges}),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"""
GROUPS = REACH + """, mem AS (SELECT node, component, split_part(node, '|', 1) AS zone_id, split_part(split_part(node, '|', 2), ':', 1) AS kind, split_part(split_part(node, '|', 2), ':', 2) AS id,
  count(*) OVER (PARTITION BY component) AS member_count FROM comp),
mh AS (SELECT *, ('0x' || substr(sha256('["' || kind || '","' || id || '"]'), 1, 15))::BIGINT AS h FROM mem),
gid AS (SELECT component, 'GROUP-' || upper(substr(sha256(min(zone_id) || '|' || count(*) || '|' || sum(h) || '|' || bit_xor(h)), 1, 20)) AS group_id FROM mh WHERE member_count >= 3 GROUP BY 1),
grp AS (SELECT zone_id, kind, id, mem.component, member_count, group_id FROM mem JOIN gid ON gid.component = mem.component)"""
GROUPED_SQL = EDGES_SQL + GROUPS.format(edges="edges")


def node_facts(spark, sf, nodes=None):
    return (B.nodes(spark, sf) if nodes is None else nodes).withColumn("us", F.unix_micros("ts"))


def group_links(spark, sf, nodes):
    """Links with the components of all edges: spanning links of the generic rule and of the face and log pairs, and the pairs that the one-to-one matchers pick.

    The four do not read each other, and each is a chain of short jobs, so they are written side by side."""
    n = live_nodes(spark, sf, nodes)
    ends = ["zone_id", "left_kind", "left_id", "right_kind", "right_id"]
    parts = [lambda: P.spanning_links(n), *one_to_one_matchers(spark, sf, n), lambda: face_ssh_links(spark, sf, n)]
    with ThreadPoolExecutor(len(parts)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(lambda part=part: materialize(part().select(*ends), "links"))) for part in parts]
        return reduce(DataFrame.unionByName, [r.result() for r in running])


def grouped(spark, sf, nodes=None):
    nodes = written_nodes(spark, sf) if nodes is None else nodes
    return materialize(graph.with_group_ids(graph.group_members(group_links(spark, sf, nodes))), "groups")


def reviewed(spark, sf, nodes=None, members=None):
    nodes = written_nodes(spark, sf) if nodes is None else nodes
    g = grouped(spark, sf, nodes) if members is None else members
    mine = materialize(nodes.join(g.select("kind", "id"), ["kind", "id"], "left_semi"), "members")  # read for the facts and for the verdicts
    return S.members_with_review(g.select("group_id", "zone_id", "kind", "id"), node_facts(spark, sf, mine), S.latest_verdicts(B.verdicts(spark, sf, mine)))


@query("correlation_groups", GROUPED_SQL + " SELECT group_id, zone_id, kind, id, member_count FROM grp")
def correlation_groups(spark, sf):
    return grouped(spark, sf).select("group_id", "zone_id", "kind", "id", "member_count")


@query("correlation_group_edges", GROUPED_SQL + " SELECT group_id, type, source_id, left_kind, left_id, right_kind, right_id FROM edges JOIN grp ON grp.zone_id = edges.zone_id AND kind = left_kind AND id = left_id")
def correlation_group_edges(spark, sf):
    edges = materialize(all_edges(spark, sf), "edges")
    return graph.group_edges(edges, graph.with_group_ids(graph.group_members(edges))).select(
        "group_id", "type", "source_id", "left_kind", "left_id", "right_kind", "right_id")


@query("generic_components", NODES + GENERIC_CTE + REACH.format(edges="generic") + " SELECT node, component FROM comp")
def generic_components(spark, sf):
    """Components of the generic rule from linear-size spanning links; the check uses all pairs."""
    m = graph.group_members(P.spanning_links(live_nodes(spark, sf)))
    key = lambda c: graph.node_key(F.col(f"{c}zone_id"), F.col(f"{c}kind"), F.col(f"{c}id"))
    return m.select(key("").alias("node"), key("component.").alias("component"))


@query("published_groups", GROUPED_SQL + """ SELECT DISTINCT group_id FROM grp JOIN nodes USING (kind, id) WHERE state IN ('EXPLICIT_SECURITY_EVENT','SMOKE_DETECTED')""")
def published_groups(spark, sf):
    published = B.nodes(spark, sf).where("state IN ('EXPLICIT_SECURITY_EVENT', 'SMOKE_DETECTED')").select("kind", "id")
    return grouped(spark, sf).join(published, ["kind", "id"], "left_semi").select("group_id").distinct()


SLOT_SQL = f""", ev AS (SELECT CAST(us // 900000000 AS VARCHAR) AS scenario_id, zone_id, id, {DOMAIN_SQL} AS domain, server_id, rack_id, us FROM el),
md0 AS (SELECT scenario_id, zone_id, count(DISTINCT id) AS event_count, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, count(DISTINCT domain) AS dc, min(us) AS f, max(us) AS l,
 count(server_id) = count(*) AND min(server_id) = max(server_id) AS os, count(rack_id) = count(*) AND min(rack_id) = max(rack_id) AS orr, min(server_id) AS s, min(rack_id) AS r, list(id ORDER BY id) AS ids FROM ev GROUP BY 1, 2),
md AS (SELECT scenario_id, zone_id, event_count, domains, CASE WHEN os THEN 'SERVER' WHEN orr THEN 'RACK' ELSE 'ZONE' END AS scope, CASE WHEN os THEN s WHEN orr THEN r ELSE zone_id END AS shared_entity, round((l - f) / 1e6::DOUBLE, 6) AS span_seconds, ids
 FROM md0 WHERE dc >= 2 AND l - f <= 900000000)"""


def slot_events(spark, sf):
    return scenario_events(spark, sf).withColumn("scenario_id", F.floor(F.col("us") / 900_000_000).cast("string"))


@query("multi_domain_correlations", NODES + SLOT_SQL + " SELECT scenario_id, zone_id, event_count, domains, scope, shared_entity, span_seconds FROM md")
def multi_domain_correlations(spark, sf):
    return graph.multi_domain_correlations(slot_events(spark, sf), 900_000_000).withColumn("span_seconds", F.round("span_seconds", 6))


@query("correlation_ids", NODES + f""", ev AS (SELECT strftime(ts, '%Y%m%d') AS scenario_id, *, {DOMAIN_SQL} AS domain FROM el)
 SELECT 'CORR-' || a.scenario_id || '-' || CASE WHEN a.server_id = b.server_id THEN 'SERVER-' || a.server_id WHEN a.rack_id = b.rack_id THEN 'RACK-' || a.rack_id ELSE 'ZONE-' || a.zone_id END || '-' || a.id || '-' || b.id AS correlation_id
 FROM ev a JOIN ev b ON a.scenario_id = b.scenario_id AND a.zone_id = b.zone_id AND a.id < b.id AND a.domain <> b.domain AND abs(a.us - b.us) <= 900000000""")
def correlation_ids(spark, sf):
    p = P.cross_domain_pairs(scenario_events(spark, sf))
    return p.select(ids.correlation_id(F.col("scenario_id"), F.col("scope"), F.col("shared_entity"), F.array("right_id", "left_id")).alias("correlation_id"))


# ---- severity ------------------------------------------------------------------------

EVENT_SEV = """CASE WHEN cyber OR unknown OR unauth THEN 2 WHEN ppe OR risk OR env THEN 1 END"""
SEVN = "CASE {r} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END"


def event_flags(src, auth="NULL"):
    """SQL rule flags of events with kind, state (and an authorization expression)."""
    return f"""(SELECT *, coalesce(kind = 'ssh' AND state IN ('EXPLICIT_SECURITY_EVENT','HIGH_CONFIDENCE_ANOMALY','ANOMALY_CANDIDATE','ANOMALOUS'), false) AS cyber, coalesce(kind = 'face' AND state = 'UNKNOWN_PERSON', false) AS unknown,
 coalesce({auth} = 'UNAUTHORIZED', false) OR coalesce(kind = 'face' AND state = 'UNAUTHORIZED', false) AS unauth, coalesce(kind = 'ppe' AND state IN ('PPE_NON_COMPLIANT','NON_COMPLIANT'), false) AS ppe, coalesce(kind = 'maintenance' AND state = 'AT_RISK', false) AS risk,
 coalesce(kind = 'environment' AND state NOT IN ('NORMAL','NO_ANOMALY'), false) AS env FROM {src})"""


RULES_TXT = """concat_ws(',', CASE WHEN unauth THEN 'UNAUTHORIZED_PHYSICAL_ACCESS_EVIDENCE' END, CASE WHEN cyber THEN 'CYBERSECURITY_ANOMALY_EVIDENCE' END, CASE WHEN unknown THEN 'UNKNOWN_PERSON_IN_ZONE' END,
 CASE WHEN ppe THEN 'PPE_NON_COMPLIANCE' END, CASE WHEN risk THEN 'DRIVE_FAILURE_RISK' END, CASE WHEN env THEN 'ENVIRONMENTAL_CONDITION' END)"""


@query("event_severity", NODES + f", sv AS (SELECT *, {EVENT_SEV} AS r FROM {event_flags('nodes')}) SELECT kind, id, {SEVN.format(r='r')} AS severity, {RULES_TXT} AS rules FROM sv")
def event_severity(spark, sf):
    n = B.nodes(spark, sf).withColumns({"domain": assess.domain_of(F.col("kind")), "authorization": F.lit(None).cast("string")})
    return S.with_event_severity(n).select("kind", "id", "severity", F.array_join(F.transform("event_rules", lambda r: r["rule"]), ",").alias("rules"))


@query("incident_severity", NODES + f""", ev AS (SELECT CAST(us // 900000000 AS VARCHAR) || zone_id AS scenario_id, {DOMAIN_SQL} AS domain, state, k FROM el),
 g AS (SELECT scenario_id, bool_or(domain='PHYSICAL_SECURITY' AND state='UNAUTHORIZED') AS u, bool_or(domain='CYBERSECURITY') AS c, bool_or(domain='MAINTENANCE') AND bool_or(domain='ENVIRONMENTAL') AS o, bool_or(k = 99) AS cc, bool_or(k < 3) AS ins, count(DISTINCT domain) >= 3 AS m FROM ev GROUP BY 1)
 SELECT scenario_id, CASE WHEN ins THEN 'EVIDENCE_REVIEW_REQUIRED' ELSE 'REVIEW_REQUIRED' END AS incident_status, CASE WHEN m OR cc THEN 'HIGH' WHEN u OR c OR o THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 concat_ws(',', CASE WHEN u THEN 'UNAUTHORIZED_PHYSICAL_ACCESS_EVIDENCE' END, CASE WHEN c THEN 'CYBERSECURITY_ANOMALY_EVIDENCE' END, CASE WHEN o THEN 'CORRELATED_OPERATIONAL_RISK' END, CASE WHEN cc THEN 'CONFIRMED_COMPROMISE' END, CASE WHEN m THEN 'MULTI_DOMAIN_CORRELATED_RISK' END) AS rules_triggered FROM g""")
def incident_severity(spark, sf):
    n = node_facts(spark, sf).where(assess.detector_abnormal(F.col("state")))
    ev = n.select(F.concat(F.floor(F.col("us") / 900_000_000).cast("string"), "zone_id").alias("scenario_id"), assess.domain_of(F.col("kind")).alias("domain"),
                  F.when((F.col("kind") == "face") & (F.col("state") == "UNAUTHORIZED"), "UNAUTHORIZED").alias("authorization"),
                  (F.col("k") == 99).alias("confirmed_compromise"), F.when(F.col("k") < 3, "INSUFFICIENT").alias("grounding_status"))
    return S.incident_severity(ev)


REV_SQL = GROUPED_SQL + CLEARED_SQL + f""", rv AS (SELECT grp.group_id, grp.zone_id, grp.kind, grp.id, n.state AS detector_state, n.server_id, n.rack_id, n.us, lv.verdict, lv.effective_status, lv.human_abnormal,
  coalesce(lv.effective_status, n.state) AS effective_state, coalesce(NOT lv.human_abnormal, false) AS cleared_by_human, {ABN_SQL.replace('state', 'n.state')} AS detector_abnormal
  FROM grp JOIN nodes n ON n.kind = grp.kind AND n.id = grp.id LEFT JOIN lv ON lv.kind = grp.kind AND lv.id = grp.id),
rv2 AS (SELECT *, NOT cleared_by_human AND (coalesce(human_abnormal, false) OR detector_abnormal) AS active_concern FROM rv)"""


@query("members_with_review", REV_SQL + " SELECT group_id, kind, id, detector_state, effective_state, cleared_by_human, active_concern FROM rv2")
def members_with_review(spark, sf):
    return reviewed(spark, sf).select("group_id", "kind", "id", F.col("state").alias("detector_state"), "effective_state", "cleared_by_human", "active_concern")


@query("provisional_group_severity", REV_SQL + f""", a AS (SELECT *, {DOMAIN_SQL} AS domain FROM rv2 WHERE active_concern),
 g AS (SELECT group_id, bool_or(kind='face' AND effective_state='UNAUTHORIZED') AS u, bool_or(domain='CYBERSECURITY') AS c, bool_or(domain='MAINTENANCE') AND bool_or(domain='ENVIRONMENTAL') AS o, count(DISTINCT domain) >= 3 AS m FROM a GROUP BY 1)
 SELECT group_id, CASE WHEN m THEN 'HIGH' WHEN u OR c OR o THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 concat_ws(',', CASE WHEN u THEN 'UNAUTHORIZED_PHYSICAL_ACCESS_EVIDENCE' END, CASE WHEN c THEN 'CYBERSECURITY_ANOMALY_EVIDENCE' END, CASE WHEN o THEN 'CORRELATED_OPERATIONAL_RISK' END, CASE WHEN m THEN 'MULTI_DOMAIN_CORRELATED_RISK' END) AS rules_triggered FROM g""")
def provisional_group_severity(spark, sf):
    return S.group_severity_by_domain(reviewed(spark, sf))


def decide_sql(src):
    """Linkage and decision over rows (group_id, kind, state, auth, server_id, rack_id, us)."""
    return f""", dsv AS (SELECT *, {EVENT_SEV} AS r FROM {event_flags(src, 'auth')}), con AS (SELECT * FROM dsv WHERE r IS NOT NULL),
 crule AS (SELECT group_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (SELECT group_id, unnest(string_split({RULES_TXT}, ',')) AS rule FROM con) GROUP BY 1),
 lk AS (SELECT group_id, count(*) AS concern_members, count(server_id) > count(DISTINCT server_id) AS same_server, count(rack_id) > count(DISTINCT rack_id) AS same_rack,
  bool_or(kind='face' AND (coalesce(auth='UNAUTHORIZED', false) OR coalesce(state='UNAUTHORIZED', false))) AND bool_or(kind='ssh') AS unauthorized_with_cyber,
  (bool_or(kind='environment') AND bool_or(kind='maintenance')) OR (bool_or(kind='ssh') AND bool_or(kind='face')) OR (bool_or(kind='face') AND bool_or(kind='ppe')) AS known_mechanism,
  round_even((max(us) - min(us)) / 60e6::DOUBLE, 1) AS time_spread_minutes, max(r) AS base FROM con GROUP BY 1)"""


DECIDE_OUT = f"""SELECT lk.group_id, {SEVN.format(r='base')} AS base_severity, {SEVN.format(r='CASE WHEN esc THEN least(base + 1, 3) ELSE base END')} AS severity, esc AS escalated,
 rules || CASE WHEN esc THEN ',LINKED_GROUP_ESCALATION' ELSE '' END AS rules_triggered, same_server, same_rack, unauthorized_with_cyber, known_mechanism, time_spread_minutes, concern_members
 FROM (SELECT *, concern_members >= 2 AND known_mechanism AND time_spread_minutes <= 10 AS esc FROM lk) lk JOIN crule USING (group_id)"""
DEV_SQL = REV_SQL + """, dev AS (SELECT group_id, kind, CASE WHEN kind='face' AND effective_state='UNAUTHORIZED' THEN 'RECOGNIZED' ELSE effective_state END AS state, CASE WHEN kind='face' AND effective_state='UNAUTHORIZED' THEN 'UNAUTHORIZED' END AS auth,
 server_id, rack_id, us FROM rv2 WHERE active_concern)""" + decide_sql("dev")
DECISIONS_SQL = DEV_SQL + f", dec AS ({DECIDE_OUT})"


@query("linkage_signals", DEV_SQL + " SELECT group_id, concern_members, same_server, same_rack, unauthorized_with_cyber, known_mechanism, time_spread_minutes FROM lk")
def linkage_signals(spark, sf):
    concern = S.with_event_severity(S.decision_events(reviewed(spark, sf))).where("severity_rank IS NOT NULL")
    return S.linkage(concern, "group_id").select("group_id", "concern_members", "same_server", "same_rack", "unauthorized_with_cyber", "known_mechanism", "time_spread_minutes")


@query("group_decisions", DECISIONS_SQL + " SELECT * FROM dec")
def group_decisions(spark, sf):
    return S.decide_groups(S.decision_events(reviewed(spark, sf)))


@query("annotated_groups", DECISIONS_SQL + """, al AS (SELECT group_id, zone_id, count(*) AS members, count(*) FILTER (NOT cleared_by_human) AS uncleared FROM rv2 GROUP BY 1, 2)
 SELECT al.group_id, zone_id, members, uncleared, base_severity, severity, escalated FROM al LEFT JOIN dec ON dec.group_id = al.group_id WHERE uncleared >= 2""")
def annotated_groups(spark, sf):
    return S.annotate_groups(materialize(reviewed(spark, sf), "reviewed")).select("group_id", "zone_id", "members", "uncleared", "base_severity", "severity", "escalated")


@query("standalone_decisions", NODES + CLEARED_SQL + f""", j AS (SELECT n.kind, n.id, CASE WHEN verdict='OVERRIDDEN' THEN effective_status ELSE state END AS state, coalesce(verdict='OVERRIDDEN', false) AS ov, coalesce(verdict='OVERRIDDEN' AND NOT human_abnormal, false) AS cl FROM nodes n LEFT JOIN lv ON lv.kind = n.kind AND lv.id = n.id),
 sv AS (SELECT *, {EVENT_SEV} AS r FROM {event_flags('j')})
 SELECT kind, id, state AS effective_state, CASE WHEN ov THEN 'HUMAN_OVERRIDE' ELSE 'DETECTOR' END AS input_source, CASE WHEN NOT cl THEN {SEVN.format(r='r')} END AS severity,
 CASE WHEN cl THEN 'INPUT_CLEARED_BY_HUMAN_VERDICT' ELSE {RULES_TXT} END AS rules_triggered, CASE WHEN NOT cl AND r IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE 'NO_ACTIVE_CONCERN' END AS incident_status FROM sv""")
def standalone_decisions(spark, sf):
    return S.standalone_decisions(B.nodes(spark, sf), S.latest_verdicts(B.verdicts(spark, sf)))


@query("group_review_reasons", DECISIONS_SQL + """, fl AS (SELECT group_id, bool_or(cleared_by_human) AS c, bool_or(NOT cleared_by_human AND active_concern AND verdict IN ('CONFIRMED','OVERRIDDEN')) AS v, bool_or(NOT cleared_by_human AND kind='ssh') AS ssh,
  bool_or(op AND kind='ppe') AS ppe, bool_or(op AND kind='face') AS face, bool_or(NOT cleared_by_human AND kind='face' AND verdict='OVERRIDDEN' AND effective_status='UNAUTHORIZED') AS fh,
  bool_or(NOT cleared_by_human AND kind='face' AND detector_state='UNAUTHORIZED' AND coalesce(effective_status NOT IN ('AUTHORIZED','NO_FACE'), true)) AS fz, bool_or(op AND kind='maintenance') AS mt, bool_or(op AND kind='environment') AS en
  FROM (SELECT *, NOT cleared_by_human AND (verdict IS NULL OR verdict = 'INCONCLUSIVE') AS op FROM rv2) GROUP BY 1 HAVING count(*) FILTER (NOT cleared_by_human) >= 2),
 ty AS (SELECT group_id, bool_or(type='FACE_SSH_CONTEXT') AS fs FROM edges JOIN grp ON grp.zone_id = edges.zone_id AND kind = left_kind AND id = left_id GROUP BY 1),
 rs AS (SELECT fl.group_id, concat_ws(',', CASE WHEN c THEN 'HUMAN_CLEARED_MEMBERS_PRESENT' END, CASE WHEN v THEN 'HUMAN_VERIFIED_CONCERNS_PRESENT' END, CASE WHEN ssh THEN 'CYBERSECURITY_EVIDENCE_PRESENT' END, CASE WHEN ppe THEN 'PPE_EVIDENCE_REQUIRES_SOURCE_REVIEW' END,
  CASE WHEN face THEN 'FACE_IDENTITY_CONTEXT_UNVERIFIED' END, CASE WHEN fh THEN 'UNAUTHORIZED_BY_HUMAN_VERDICT' END, CASE WHEN fz THEN 'RECOGNIZED_IDENTITY_NOT_AUTHORIZED_FOR_DECLARED_ZONE' END, CASE WHEN mt THEN 'MAINTENANCE_RISK_REQUIRES_SOURCE_REVIEW' END,
  CASE WHEN en THEN 'ENVIRONMENTAL_CONDITION_REQUIRES_SOURCE_REVIEW' END, CASE WHEN fs THEN 'FACE_SSH_CONTEXTUAL_ASSOCIATION_UNVERIFIED' END) AS review_reasons, severity FROM fl LEFT JOIN ty USING (group_id) LEFT JOIN dec USING (group_id))
 SELECT group_id, review_reasons, severity, CASE WHEN review_reasons <> '' THEN 'EVIDENCE_REVIEW_REQUIRED' WHEN severity IN ('MEDIUM','HIGH') THEN 'REVIEW_REQUIRED' ELSE 'OBSERVATION_RECORDED' END AS status FROM rs""")
def group_review_reasons(spark, sf):
    """Of the edge types only FACE_SSH_CONTEXT gives a reason, so its pairs alone are looked up in the groups."""
    nodes = written_nodes(spark, sf)
    members = grouped(spark, sf, nodes)
    r = materialize(reviewed(spark, sf, nodes, members), "reviewed")
    decided = materialize(S.annotate_groups(r), "decided")  # read twice below
    r = r.join(decided.select("group_id"), "group_id", "left_semi")
    contexts = P.as_edges(face_ssh(spark, sf, nodes), "FACE_SSH_CONTEXT", "face", "ssh")
    return S.group_review_reasons(r, graph.group_edges(contexts, members).select("group_id", "type"), decided)


@query("physical_pair_review", EDGES_SQL + CLEARED_SQL + """, pr AS (SELECT im.left_id, im.right_id, p.state AS ps, lv.effective_status AS ov, f.state AS fstate FROM im JOIN nodes p ON p.kind='ppe' AND p.id = im.left_id JOIN nodes f ON f.kind='face' AND f.id = im.right_id LEFT JOIN lv ON lv.kind='ppe' AND lv.id = im.left_id),
 u AS (SELECT *, coalesce(ov, CASE WHEN ps='PPE_NON_COMPLIANT' THEN 'NON_COMPLIANT' ELSE ps END) AS used, CASE WHEN fstate IN ('UNAUTHORIZED','RECOGNIZED') THEN 'RECOGNIZED' ELSE 'UNKNOWN' END AS fs FROM pr),
 rr AS (SELECT *, concat_ws(',', CASE WHEN used='NON_COMPLIANT' AND ov IS NOT NULL THEN 'PPE_NON_COMPLIANT_HUMAN_VERDICT' WHEN used='NON_COMPLIANT' THEN 'PPE_NON_COMPLIANT_DETECTOR_ASSESSMENT' END, CASE WHEN fs <> 'RECOGNIZED' THEN 'FACE_RECOGNITION_NOT_ESTABLISHED' END) AS reasons FROM u)
 SELECT left_id, right_id, used AS ppe_status_used, reasons, CASE WHEN reasons <> '' THEN 'EVIDENCE_REVIEW_REQUIRED' ELSE 'OBSERVATION_RECORDED' END AS status FROM rr""")
def physical_pair_review(spark, sf):
    n = B.nodes(spark, sf)
    ppe = n.where("kind = 'ppe'").select(F.col("id").alias("left_id"), F.expr("CASE WHEN state = 'PPE_NON_COMPLIANT' THEN 'NON_COMPLIANT' ELSE state END").alias("ppe_status"))
    face = n.where("kind = 'face'").select(F.col("id").alias("right_id"), F.expr("CASE WHEN state IN ('UNAUTHORIZED','RECOGNIZED') THEN 'RECOGNIZED' ELSE 'UNKNOWN' END").alias("face_status"))
    over = S.latest_verdicts(B.verdicts(spark, sf)).where("kind = 'ppe'").select(F.col("id").alias("left_id"), F.col("effective_status").alias("ppe_override"))
    j = image_matches(spark, sf).select("left_id", "right_id").join(ppe, "left_id").join(face, "right_id").join(over, "left_id", "left")
    return S.physical_review(j).select("left_id", "right_id", "ppe_status_used", "reasons", "status")


@query("tightest_group_times", GROUPED_SQL + """, mt AS (SELECT group_id, g.kind, g.id, CASE WHEN n.k >= 60 THEN [n.us, n.us + 420000000] ELSE [n.us] END AS times FROM grp g JOIN nodes n ON n.kind = g.kind AND n.id = g.id),
 an AS (SELECT DISTINCT group_id, unnest(times) AS anchor FROM mt),
 ne AS (SELECT a.group_id, a.anchor, m.kind, m.id, CASE WHEN len(times) = 2 AND abs(times[2] - anchor) < abs(times[1] - anchor) THEN times[2] ELSE times[1] END AS t FROM an a JOIN mt m ON m.group_id = a.group_id),
 sp AS (SELECT group_id, anchor, max(t) - min(t) AS spread FROM ne GROUP BY 1, 2), be AS (SELECT group_id, arg_min(anchor, {'s': spread, 'a': anchor}) AS anchor, min(spread) AS spread FROM sp GROUP BY 1)
 SELECT ne.group_id, kind, id, t AS chosen_us, round(spread / 1e6::DOUBLE, 6) AS spread_seconds FROM ne JOIN be ON be.group_id = ne.group_id AND be.anchor = ne.anchor""")
def tightest_group_times(spark, sf):
    n = B.nodes(spark, sf).select("kind", "id", F.when(F.col("k") >= 60, F.array("ts", F.expr("ts + INTERVAL 7 MINUTES"))).otherwise(F.array("ts")).alias("times"))
    return S.tightest_times(grouped(spark, sf).select("group_id", "kind", "id").join(n, ["kind", "id"])).withColumn("spread_seconds", F.round("spread_seconds", 6))


# ---- evaluation over groups ------------------------------------------------------------

LINK_REACH = """, lsym AS (SELECT left_id AS a, right_id AS b FROM sc WHERE p >= 0.5 UNION SELECT right_id, left_id FROM sc WHERE p >= 0.5),
lreach(a, b) AS (SELECT a, b FROM lsym UNION SELECT r.a, s.b FROM lreach r JOIN lsym s ON r.b = s.a),
lcomp AS (SELECT mev.id AS node, coalesce(min(b), mev.id) AS component, mev.incident, mev.scenario_id, any_value(mev.us) AS us, any_value(mev.domain) AS domain FROM mev LEFT JOIN lreach ON a = mev.id GROUP BY mev.id, mev.incident, mev.scenario_id)"""


def alert_members(spark, sf):
    """Every abnormal event with its alert: the component of the pairs the model calls related, or itself."""
    links = bayes.score(candidates(spark, sf)).where("correlated").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    labels = graph.connected_components(links).withColumnRenamed("node", "id")
    ev = model_events(spark, sf).where(assess.is_abnormal(F.col("domain"), F.col("state"), F.col("authorization")))
    return materialize(ev.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "alerts")


@query("operator_view", CAND_SQL + LINK_REACH + """, inc AS (SELECT incident, count(*) AS n, count(DISTINCT component) AS comps, min(component) AS c FROM lcomp WHERE incident IS NOT NULL GROUP BY 1), sz AS (SELECT component, count(*) AS n FROM lcomp GROUP BY 1)
 SELECT (SELECT count(*) FROM sz) AS alerts_shown, count(*) AS incidents, count(*) FILTER (comps = 1) AS incidents_fully_linked, count(*) FILTER (comps = 1 AND inc.n = sz.n) AS incidents_linked_cleanly FROM inc JOIN sz ON sz.component = inc.c""")
def operator_view(spark, sf):
    return metrics.operator_view(alert_members(spark, sf), "component", "incident")


@query("alert_queue_order", CAND_SQL + LINK_REACH + """, al AS (SELECT component, count(*) AS n, count(DISTINCT domain) AS dn FROM lcomp GROUP BY 1)
 SELECT component, dn AS severity_rank, row_number() OVER (ORDER BY dn DESC, md5(component || '|5'), component) AS place FROM al""")
def alert_queue_order(spark, sf):
    return alert_queue(spark, sf).select("component", "severity_rank", "place")


def alert_queue(spark, sf):
    a = alert_members(spark, sf).groupBy("component").agg(F.count_distinct("domain").alias("severity_rank"), F.bool_or(F.col("incident").isNotNull()).alias("genuine"))
    return metrics.queue_order(a, "component", "severity_rank", 5)


@query("alert_queue_metrics", CAND_SQL + LINK_REACH + """, al AS (SELECT component, count(DISTINCT domain) AS dn, bool_or(incident IS NOT NULL) AS genuine FROM lcomp GROUP BY 1),
 qq AS (SELECT component, genuine, row_number() OVER (ORDER BY dn DESC, md5(component || '|5'), component) AS place FROM al),
 fi AS (SELECT incident, min(place) AS first_place, max(place) AS last_place FROM lcomp JOIN qq USING (component) WHERE incident IS NOT NULL GROUP BY 1),
 ap AS (SELECT avg(hits / place::DOUBLE) AS ap FROM (SELECT place, genuine, sum(genuine::INT) OVER (ORDER BY place) AS hits FROM qq) WHERE genuine)
 SELECT round((SELECT ap FROM ap), 6) AS average_precision, max(first_place) AS alerts_until_all_incidents, max(last_place) AS alerts_until_all_events, round(avg(first_place), 6) AS mean_first_rank FROM fi""")
def alert_queue_metrics(spark, sf):
    truth = alert_members(spark, sf).where("incident IS NOT NULL").select("component", "incident").distinct()
    m = metrics.queue_metrics(alert_queue(spark, sf), truth, "component")
    return m.select(F.round("average_precision", 6).alias("average_precision"), "alerts_until_all_incidents", "alerts_until_all_events", F.round("mean_first_rank", 6).alias("mean_first_rank"))


MGROUP_SQL = CAND_SQL + LINK_REACH + """, gsz AS (SELECT component FROM lcomp GROUP BY 1 HAVING count(*) >= 2),
 gev AS (SELECT l.component AS group_id, CASE m.domain WHEN 'CYBERSECURITY' THEN 'ssh' WHEN 'PHYSICAL_SECURITY' THEN 'face' WHEN 'SAFETY' THEN 'ppe' WHEN 'MAINTENANCE' THEN 'maintenance' ELSE 'environment' END AS kind, m.state, m.auth, m.server_id, m.rack_id, m.us, m.incident
 FROM lcomp l JOIN gsz USING (component) JOIN mev m ON m.id = l.node)""" + decide_sql("gev") + """, gi AS (SELECT group_id, count(DISTINCT incident) = 1 AND count(incident) = count(*) AS genuine FROM gev GROUP BY 1),
 gl AS (SELECT lk.*, genuine, concern_members >= 2 AND (same_server OR unauthorized_with_cyber) AS l1, concern_members >= 2 AND known_mechanism AND time_spread_minutes <= 10 AS l2,
  concern_members >= 2 AND (same_server OR unauthorized_with_cyber OR known_mechanism) AND time_spread_minutes <= 10 AS l3, concern_members >= 2 AND (same_server OR unauthorized_with_cyber OR known_mechanism) AND time_spread_minutes <= 5 AS l4 FROM lk JOIN gi USING (group_id))"""


def model_groups(spark, sf):
    a = alert_members(spark, sf).withColumnRenamed("component", "group_id")
    many = a.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), ((F.count_distinct("incident") == 1) & (F.count("incident") == F.count(F.lit(1)))).alias("genuine")).where("n >= 2")
    return a.join(many, "group_id"), many.select("group_id", "genuine")


@query("escalation_separation", MGROUP_SQL + """, es AS (""" + " UNION ALL ".join(f"SELECT '{r}' AS rule, l{i} AS esc, genuine FROM gl" for i, r in enumerate(S.LINKAGE_RULES, 1)) + """)
 SELECT rule, count(*) FILTER (esc) AS escalated, count(*) AS groups, round(avg(genuine::INT) FILTER (esc), 6) AS genuine_escalated, round(avg(genuine::INT) FILTER (NOT esc), 6) AS genuine_rest, round(avg(genuine::INT) FILTER (esc) - avg(genuine::INT) FILTER (NOT esc), 6) AS separation FROM es GROUP BY 1""")
def escalation_separation(spark, sf):
    events, truth = model_groups(spark, sf)
    sig = S.linkage(S.with_event_severity(events).where("severity_rank IS NOT NULL"), "group_id").join(truth, "group_id")
    out = metrics.escalation_separation(sig, {r: (F.col("concern_members") >= 2) & S.linked(r) for r in S.LINKAGE_RULES}, "genuine")
    return out.select("rule", "escalated", "groups", *[F.round(c, 6).alias(c) for c in ("genuine_escalated", "genuine_rest", "separation")])


@query("selected_linkage_rule", MGROUP_SQL + """, es AS (""" + " UNION ALL ".join(f"SELECT {i} AS o, '{r}' AS rule, l{i} AS esc, genuine FROM gl" for i, r in enumerate(S.LINKAGE_RULES, 1)) + """),
 sp AS (SELECT o, rule, avg(genuine::INT) FILTER (esc) - avg(genuine::INT) FILTER (NOT esc) AS separation FROM es GROUP BY 1, 2) SELECT rule FROM sp ORDER BY coalesce(separation, -9) DESC, o LIMIT 1""")
def selected_linkage_rule(spark, sf):
    events, truth = model_groups(spark, sf)
    sig = S.linkage(S.with_event_severity(events).where("severity_rank IS NOT NULL"), "group_id").join(truth, "group_id")
    return metrics.select_rule(metrics.escalation_separation(sig, {r: (F.col("concern_members") >= 2) & S.linked(r) for r in S.LINKAGE_RULES}, "genuine"))


@query("severity_against_incidents", MGROUP_SQL + f""", sv AS (SELECT {SEVN.format(r='CASE WHEN l2 THEN least(base + 1, 3) ELSE base END')} AS severity, genuine FROM gl)
 SELECT severity, count(*) AS groups, count(*) FILTER (genuine) AS genuine_groups, round(avg(genuine::INT), 6) AS genuine_share FROM sv GROUP BY 1""")
def severity_against_incidents(spark, sf):
    events, truth = model_groups(spark, sf)
    d = S.decide_groups(events).join(truth, "group_id")
    return d.groupBy("severity").agg(F.count(F.lit(1)).alias("groups"), F.count_if("genuine").alias("genuine_groups"), F.round(F.avg(F.col("genuine").cast("int")), 6).alias("genuine_share"))
